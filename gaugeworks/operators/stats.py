"""Stats rows of Python files and functions: lines, counts and complexities in one table.

A line has code if a token other than a comment is on it, all lines of a string included;
a line without code but with a comment is a comment; the rest is blank. Functions count the
lines from their first to their last; nested functions are rows of their own and count in
the outer one too. What ``excluded`` patterns capture (test code, say) counts nowhere but in
the total of lines: its lines are blank, its functions have no rows.

Files are told apart by a number of their own, so a path may occur more than once, or be
null. A file is parsed, matched with patterns and told its lines in one pass; what leaves it are
the nodes that metrics read, with the lines of each function.

Defined cases: null contents give no rows; a source that doesn't parse has lines but no
counts (null); an empty file has no line; lines end at line feeds only; functions of equal
names are separate rows.
"""

from __future__ import annotations

import io
import tokenize
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.trees import NAMES, NODES, nodes, per_text, python_nodes
from ..storage import stored
from . import patterns, trees
from .matching import Nodes, Pattern, Ranges

SKIPPED = (tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER, tokenize.ENCODING)
LINES = ("lines", "code_lines", "comment_lines", "blank_lines")


def token_marks(text: str) -> list[tuple[int, int, int, bool]]:
    """(line, first byte, byte after, comment) of each token on each of its lines."""
    rows = text.split("\n")
    starts = [0]
    for row in rows:
        starts.append(starts[-1] + len(row.encode("utf-8", "surrogatepass")) + 1)

    def at(line, column):
        return starts[line - 1] + len(rows[line - 1][:column].encode("utf-8", "surrogatepass"))

    try:
        tokens = [t for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type not in SKIPPED]
        return [(line, at(*t.start), at(*t.end), t.type == tokenize.COMMENT) for t in tokens for line in range(t.start[0], min(t.end[0], len(rows)) + 1)]
    except (tokenize.TokenError, SyntaxError, IndexError):  # by their look
        return [(k, starts[k - 1], starts[k] - 1, x.strip().startswith("#")) for k, x in enumerate(rows, 1) if x.strip()]


def line_kinds(text: str) -> list[str]:
    """'code', 'comment' or 'blank' for each line."""
    count = text.count("\n") + (text != "" and not text.endswith("\n"))
    kinds = ["blank"] * count
    for line, _, _, comment in token_marks(text):
        if not comment:
            kinds[line - 1] = "code"
        elif kinds[line - 1] == "blank":
            kinds[line - 1] = "comment"
    return kinds


def _kept_lines(text: str, ranges: Ranges) -> tuple[list[int], list[int]]:
    """Numbers of the lines with code and of those with comments alone, without what lies in ``ranges``."""
    marks = [(m[0], m[3]) for m in token_marks(text) if not ranges.hold(m[1], m[2])]
    code = {line for line, comment in marks if not comment}
    return sorted(code), sorted({line for line, comment in marks if comment} - code)


def _line_count(text: str) -> int:
    return text.count("\n") + (text != "" and not text.endswith("\n"))


def _lines(total, code, comment) -> list:
    values = (total, code, comment, F.greatest(total - code - comment, F.lit(0)))
    return [v.cast("bigint").alias(n) for v, n in zip(values, LINES, strict=True)]


#: Columns of the node table that metrics read, and those that are known of a file and of a function besides: the innermost class, the first parameter, lines.
COLUMNS = ("enter", "leave", "parent", "depth", "kind", "class", "name", "note", "caller", "start_line", "end_line")
MORE = "whole boolean, owner string, first string, total int, code int, comment int"
ENTER, PARENT, DEPTH, KIND, CLASS, NAME, FIRST, LAST, START, END = (NAMES.index(c) for c in ("enter", "parent", "depth", "kind", "class", "name", "start_line", "end_line", "start_byte", "end_byte"))


def _numbered(files: DataFrame) -> DataFrame:
    """Files by number (``path``) with their own path (``named``)."""
    return files.where("contents IS NOT NULL").select(F.monotonically_increasing_id().cast("string").alias("path"), F.col("path").alias("named"), "contents")


def _ranged(keyed: DataFrame, excluded: list[str]) -> tuple[DataFrame, list[str]]:
    """Files with ``ranges`` of what those patterns capture that can't be matched while parsing, and the patterns that can."""
    here, there = patterns.split(excluded)
    if not there:
        return keyed.withColumn("ranges", F.lit("")), excluded
    keyed = stored(keyed, "stats-files")
    table = stored(patterns.pattern_nodes(nodes(keyed, "python", digests=False, columns=patterns.COLUMNS), keyed), "pattern-nodes")
    found = patterns.all_captured(table, [excluded[k] for k in there]).groupBy("path").agg(F.concat_ws(" ", F.sort_array(F.collect_list(F.concat_ws("-", "start_byte", "end_byte")))).alias("ranges"))
    return keyed.join(found.hint("merge"), "path", "left").withColumn("ranges", F.coalesce("ranges", F.lit(""))), [excluded[k] for k in here]


def _table(files: DataFrame, excluded: list[str], metrics: bool = True) -> DataFrame:
    """A row for each file (``kind`` is null; ``whole`` if it parses), and its nodes that metrics or names read, without what is excluded.

    One pass reads a file, matches patterns in it and drops what they capture, so that neither
    tokens nor other nodes leave the task. Without ``metrics`` only functions are listed, and no lines.
    """
    files, here = _ranged(_numbered(files), excluded)
    parts, ready = [patterns.read(f"{p} @the-capture") for p in here], []
    chosen = [NAMES.index(c) for c in COLUMNS]

    def make(text, given):
        rows = python_nodes("", text, None)
        if not ready:
            ready.extend(Pattern(*p) for p in parts)
        tree = Nodes(rows, text) if ready and rows else None
        ranges = Ranges([tuple(map(int, r.split("-"))) for r in given.split()] + [(x[4], x[5]) for p in ready if tree for _, _, x in p.matches(tree) if x[4] is not None])
        code, comment = _kept_lines(text, ranges) if metrics else ([], [])
        out = [(-1, *[None] * (len(COLUMNS) - 1), bool(rows), None, None, _line_count(text), len(code), len(comment))]
        owners, firsts, lists = {}, {}, {}
        for r in rows:
            owners[r[ENTER]] = r[NAME] if r[CLASS] == "class" else owners.get(r[PARENT])
            if r[KIND] == "arguments":
                lists[r[ENTER]] = r[PARENT]
            elif r[KIND] == "arg" and r[PARENT] in lists:
                firsts.setdefault(lists[r[PARENT]], r[NAME])
        for r in rows:
            function = r[CLASS] == "function"
            # what metrics read: classed nodes, the root, self
            if not (function or metrics and (r[CLASS] is not None or r[DEPTH] == 0 or r[KIND] == "Name" and r[NAME] == "self")) or ranges.starts and ranges.hold(r[START], r[END]):
                continue
            lines = [r[LAST] - r[FIRST] + 1, *(bisect_right(x, r[LAST]) - bisect_left(x, r[FIRST]) for x in (code, comment))] if function else [None] * 3
            out.append((*(r[c] for c in chosen), None, owners[r[ENTER]] if function else None, firsts.get(r[ENTER]) if function else None, *lines))
        return list(zip(*out, strict=True))

    types = dict(c.split() for c in NODES.split(", "))
    return per_text(files, make, ", ".join(f"{c} {types[c]}" for c in COLUMNS) + ", " + MORE, ("path", "named"), ("ranges",))


def file_lines(files: DataFrame) -> DataFrame:
    """(path, lines, code_lines, comment_lines, blank_lines) of each file; no tree is built."""

    def make(text):
        return [[_line_count(text)], *([len(x)] for x in _kept_lines(text, Ranges([])))]

    counted = per_text(files, make, "total int, code int, comment int")
    return counted.select("path", *_lines(*(F.col(c) for c in ("total", "code", "comment"))))


def file_stats(files: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """(kind, fully_qualified_name, path, files, classes, functions, fields, cyclomatic, complexity, lcom4, lines ...) of each file.

    A file's counts are null only if it doesn't parse; one whose nodes are all excluded has none of each.
    """
    table = stored(_table(files, excluded or []), "stats-nodes")
    tree = table.where("kind IS NOT NULL")
    rows = table.where("kind IS NULL").select("path", "named", F.when(F.col("whole"), F.lit(0)).cast("bigint").alias("parsed"), *_lines(*(F.col(c) for c in ("total", "code", "comment"))))
    for part in (trees.counts(tree), trees.cyclomatic(tree), trees.cognitive(tree), trees.lcom4(tree)):
        rows = rows.join(part.hint("merge"), "path", "left")  # sizes of compressed tables say little, so nothing is broadcast
    # a file that parses has its own minimum of each even if all of it is excluded
    counts = [F.coalesce(c, F.col("parsed") + (1 if c == "cyclomatic" else 0)).alias(c) for c in ("classes", "functions", "fields", "cyclomatic", "complexity", "lcom4")]
    return rows.select(F.lit("FILE").alias("kind"), F.col("named").alias("fully_qualified_name"), F.col("named").alias("path"), F.lit(1).cast("bigint").alias("files"), *counts, *LINES)


def _full_name():
    return F.when(F.col("owner").isNull(), F.col("name")).otherwise(F.concat("owner", F.when(F.coalesce(F.col("first") == "self", F.lit(False)), F.lit("#")).otherwise(F.lit("::")), "name"))


def names(files: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """(kind, fully_qualified_name, path, start_line) of the rows of ``file_stats`` (without a line) and ``function_stats``; no metric is computed."""
    rows = _table(files, excluded or [], metrics=False)
    of_file = F.col("kind").isNull()
    kind, full = F.when(of_file, F.lit("FILE")).otherwise(F.lit("FUNCTION")), F.when(of_file, F.col("named")).otherwise(_full_name())
    return rows.select(kind.alias("kind"), full.alias("fully_qualified_name"), F.col("named").alias("path"), "start_line")


def function_stats(files: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """(kind, name, fully_qualified_name, path, start_line, fields, cyclomatic, complexity, lines ...) of each function.

    The name is qualified by the innermost class that holds the function, with ``#`` if its first parameter is self.
    """
    table = stored(_table(files, excluded or []), "stats-nodes")
    rows = table.where("class = 'function'").select("path", F.col("enter").alias("function"), "name", _full_name().alias("full"), "named", "start_line", "total", "code", "comment")
    inside = table.where("class IS NOT NULL").select("path", "enter", "leave", "depth", "class", "name", "note", "caller")
    inside = stored(trees.enclosing(inside, "function", "function"), "stats-inside")
    fields = F.count_distinct(F.when((F.col("class") == "field") & ~F.col("note").eqNullSafe("called"), F.col("name")))
    for part in (inside.groupBy("path", "function").agg(fields.alias("fields")), trees.cyclomatic(inside, "path", "function"), trees.cognitive(inside, "path", "function")):
        rows = rows.join(part.hint("merge"), ["path", "function"], "left")
    some = [F.coalesce(c, F.lit(least).cast("bigint")).alias(c) for c, least in (("fields", 0), ("cyclomatic", 1), ("complexity", 0))]  # deeper than metrics look
    return rows.select(F.lit("FUNCTION").alias("kind"), "name", F.col("full").alias("fully_qualified_name"), F.col("named").alias("path"), "start_line", *some, *_lines(F.col("total"), F.col("code"), F.col("comment")))


def stats_order(rows: DataFrame, *ties: str) -> DataFrame:
    """By kind, then full name; then path and ``ties``."""
    return rows.orderBy("kind", "fully_qualified_name", "path", *ties)
