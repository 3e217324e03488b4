"""In-source suppressions: comments that switch rules off for ranges of lines of their file.

A directive is a line of a comment that begins with a word, which the caller names, and rules
after a colon, a blank or in brackets, parted by commas or blanks:

* ``+rule`` from here on, ``-rule`` no longer, ``>rule`` up to the next line of code;
* ``rule`` for the block that the next line of code begins: up to the first later line of
  code that isn't indented further than the directive, nor is anything from the line of code
  before it on;
* behind code, on a line of its own code only: ``-rule`` spares the line, all others cover it.

Every directive becomes a range of lines, found by windows over the file's lines: from a sign
to the rule's next one, to the next line of code, or to the end of a block, which is looked up
for each indent that directives of the file have. Ranges are unfolded into the lines that
carry text.

Defined cases: a file without the word, or null, has no suppressions; files that share a path
suppress together; blank lines, and all but the first of a comment of several, are never
covered; an issue without a path or start line stays. Python comments are told by its
tokenizer; of other languages comments are known by their look where they fill a line (``//``,
``#``, ``/* */``) or begin one and go on over several (``/*``).
"""

from __future__ import annotations

import io
import tokenize

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

BLANKS = " \t\r\x0b\x0c"
# Fixed value: what may open a comment's line before the word.
OPENERS = r"^(/?\*+|/+|#+)\s*"
FILE = ("path", "h")


def directive_rules(text: Column, word: str) -> Column:
    """Array of the rules, signs included, that a comment's line names; null if it is no directive."""
    line = F.btrim(text, F.lit(BLANKS))
    body = F.regexp_replace(line, OPENERS, "")
    rest = F.substring(body, len(word) + 1, 1 << 30)
    close = F.length(rest) - F.instr(F.reverse(rest), ")")  # characters before the last bracket
    listed = rest.startswith("(") & rest.contains(")")
    plain = F.regexp_replace(F.regexp_replace(rest, r"^(:\s*|\s+)", ""), r"\*/$", "")
    names = F.when(listed, F.substring(rest, F.lit(2), close - 1)).otherwise(plain)
    return F.when(line.rlike(OPENERS) & body.startswith(word), F.filter(F.split(names, "[ ,]"), lambda x: x != ""))


def _lines(files: DataFrame, word: str) -> DataFrame:
    """(path, h, line, text, indent, blank) of files that hold the word."""
    some = files.where(F.col("contents").contains(word) & F.col("path").isNotNull())
    rows = some.select("path", F.xxhash64("contents").alias("h"), F.posexplode(F.split("contents", "\n")).alias("at", "text")).distinct()
    bare = F.btrim("text", F.lit(BLANKS))
    indent = F.length(F.rtrim(F.col("text"), F.lit(BLANKS))) - F.length(bare)
    return rows.select("path", "h", (F.col("at") + 1).alias("line"), "text", indent.alias("indent"), (bare == "").alias("blank"))


def _comments_by_look(lines: DataFrame) -> DataFrame:
    """(path, h, line, of, full, text): lines of comments, and the line ``of`` where each comment begins."""
    order = Window.partitionBy(*FILE).orderBy("line")
    bare = F.btrim("text", F.lit(BLANKS))
    closes = bare.contains("*/")
    opens = bare.startswith("/*") & ~closes
    open_before = F.coalesce(F.last(F.when(closes, 0).when(opens, 1), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    rows = lines.withColumn("inside", open_before).withColumn("opens", opens)
    begun = F.last(F.when(F.col("opens") & ~F.col("inside"), F.col("line")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    fills = bare.startswith("//") | bare.startswith("#") | (bare.contains("/*") & bare.endswith("*/")) | F.col("opens")
    rows = rows.withColumn("begun", begun).where(F.col("inside") | fills)
    return rows.select(*FILE, "line", F.when(F.col("inside"), F.col("begun")).otherwise(F.col("line")).alias("of"), F.lit(True).alias("full"), "text")


def _comments_of_python(files: DataFrame, word: str) -> DataFrame:
    """The same, as Python's tokenizer sees it; a file that it can't read has the comments that fill a line."""

    def run(frames):
        for frame in frames:
            out = []
            for path, h, text in zip(frame["path"], frame["h"], frame["contents"], strict=True):
                lines = text.split("\n")
                try:
                    found = [(t.start[0], t.line.strip() == t.string.strip(), t.string) for t in tokenize.generate_tokens(io.StringIO(text + "\n").readline) if t.type == tokenize.COMMENT]
                except (tokenize.TokenError, SyntaxError):
                    found = [(k, True, x.strip()) for k, x in enumerate(lines, 1) if x.strip().startswith("#")]
                out += [(path, h, line, line, full, comment) for line, full, comment in found]
            yield pd.DataFrame(out, columns=["path", "h", "line", "of", "full", "text"])

    some = files.where(F.col("contents").contains(word)).select("path", F.xxhash64("contents").alias("h"), "contents")
    return some.mapInPandas(run, "path string, h bigint, line int, of int, full boolean, text string")


def suppressed_ranges(files: DataFrame, word: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines that carry text (path, h, line), ranges (path, h, rule, first, last), and lines spared (path, h, rule, line)."""
    python = F.col("path").endswith(".py")
    lines = stored(_lines(files, word), "suppression-lines")
    comments = stored(_comments_by_look(lines.where(~python)).unionByName(_comments_of_python(files.where(python), word)), "suppression-comments")
    heads = comments.where("line = of").groupBy(*FILE, "line").agg(F.max("full").alias("full"))
    inner = comments.where("line <> of").select(*FILE, "line").distinct()
    carrying = lines.where("NOT blank").join(inner, [*FILE, "line"], "left_anti").join(heads, [*FILE, "line"], "left").select(*FILE, "line", "indent", (~F.coalesce("full", F.lit(False))).alias("code"))
    order = Window.partitionBy(*FILE).orderBy("line")
    upto, onward = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    rows = carrying.withColumn("next_code", F.min(F.when(F.col("code"), F.col("line"))).over(onward)).withColumn("run", F.sum(F.col("code").cast("int")).over(upto))
    rows = rows.withColumn("widest", F.max("indent").over(Window.partitionBy(*FILE, "run").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    rows = stored(rows.withColumn("reach", F.greatest("indent", F.lag("widest").over(order))), "suppression-rows")

    named = comments.select(*FILE, F.col("of").alias("line"), F.col("line").alias("at"), "full", F.posexplode(directive_rules(F.col("text"), word)).alias("nth", "name"))
    sign = F.when(F.substring("name", 1, 1).isin("+", "-", ">"), F.substring("name", 1, 1)).otherwise("")
    marks = named.select(*FILE, "line", "at", "nth", "full", sign.alias("sign"), F.substring("name", F.length(sign) + 1, F.length("name")).alias("rule"))
    marks = stored(marks.join(rows.select(*FILE, "line", "indent", "next_code"), [*FILE, "line"]), "suppression-marks")

    switches = Window.partitionBy(*FILE, "rule").orderBy("line", "at", "nth")
    on = marks.where("full AND sign IN ('+', '-')").withColumn("last", F.lead("line").over(switches) - 1).where("sign = '+'").select(*FILE, "rule", F.col("line").alias("first"), "last")
    once = marks.where("(full AND sign = '>') OR (NOT full AND sign <> '-')").select(*FILE, "rule", F.col("line").alias("first"), F.col("next_code").alias("last"))
    blocks = marks.where("full AND sign = ''")
    indents = blocks.select(*FILE, F.col("indent").alias("at_indent")).distinct()
    later = Window.partitionBy(*FILE, "at_indent").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    ends = rows.where("code").join(indents, [*FILE]).withColumn("end", F.min(F.when(F.col("reach") <= F.col("at_indent"), F.col("line"))).over(later))
    ends = ends.select(*FILE, F.col("line").alias("next_code"), F.col("at_indent").alias("indent"), "end")
    block = blocks.join(ends, [*FILE, "next_code", "indent"], "left").select(*FILE, "rule", F.col("line").alias("first"), (F.col("end") - 1).alias("last"))
    spared = marks.where("NOT full AND sign = '-'").select(*FILE, "rule", "line").distinct()
    return rows.select(*FILE, "line"), on.unionByName(once).unionByName(block), spared


def suppressions(files: DataFrame, word: str) -> DataFrame:
    """(path, line, rule) of files (path, contents)."""
    rows, ranges, spared = suppressed_ranges(files, word)
    sizes = rows.groupBy(*FILE).agg(F.max("line").alias("size"))
    closed = ranges.join(sizes, [*FILE]).select(*FILE, "rule", "first", F.coalesce("last", "size").alias("last")).where("first <= last")
    each = closed.select(*FILE, "rule", F.explode(F.sequence("first", "last")).alias("line")).distinct()
    covered = each.join(rows, [*FILE, "line"], "left_semi").join(spared, [*FILE, "rule", "line"], "left_anti")
    return covered.select("path", F.col("line").cast("bigint").alias("line"), "rule").distinct()


def unsuppressed(issues: DataFrame, covered: DataFrame) -> DataFrame:
    """Issues that no suppression covers by tool, tool/rule or tool:rule; all their columns."""
    marks = covered.select(F.col("path").alias("_path"), F.col("line").alias("_line"), F.col("rule").alias("_rule")).distinct()
    names = F.array(F.col("tool"), F.concat_ws("/", "tool", "rule_key"), F.concat_ws(":", "tool", "rule_key"))
    gathered = marks.groupBy("_path", "_line").agg(F.collect_set("_rule").alias("_rules"))
    rows = issues.join(gathered, (F.col("path") == F.col("_path")) & (F.col("start_line") == F.col("_line")), "left")
    return rows.where(F.col("_rules").isNull() | ~F.arrays_overlap("_rules", names)).drop("_path", "_line", "_rules")
