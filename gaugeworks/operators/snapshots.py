"""Differences of two snapshots of files: which files changed, and which of their lines.

Lines that occur once on either side of a path are anchors, found by an equi-join; the longest
run of anchors that rises on both sides stays in place. What lies between two of them is a gap.
A gap with lines on one side only is added or deleted as it is; the others are compared in
batches, each by itself, so no comparison grows with more than one gap.

A file is renamed if its text is that of a file that is gone; copies are paired in the order of
their paths. Texts end lines at line feeds; a last line without one differs from the same line
with one.

Defined cases: null contents are no file; paths are distinct and not null on each side; an
empty file has no lines; files equal on both sides have no rows.
"""

from __future__ import annotations

import difflib
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

LINE = ("text", "open")


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, old_path, status): A added, D deleted, M modified, R renamed to ``path``."""
    one, two = (x.where("contents IS NOT NULL").select("path", F.md5(F.col("contents").cast("binary")).alias(d), F.octet_length("contents").alias(f"{d}_size")) for x, d in ((before, "old"), (after, "new")))
    both = one.join(two, "path", "full_outer")
    modified = both.where("old <> new OR old_size <> new_size").select("path", F.col("path").alias("old_path"), F.lit("M").alias("status"))
    gone, made = both.where("new IS NULL"), both.where("old IS NULL")
    keyed = [x.select(F.col("path").alias(p), F.col(d).alias("digest"), F.col(f"{d}_size").alias("size"), F.row_number().over(Window.partitionBy(d, f"{d}_size").orderBy("path")).alias("nth")) for x, d, p in ((gone, "old", "old_path"), (made, "new", "path"))]
    paired = keyed[0].join(keyed[1], ["digest", "size", "nth"], "full_outer")
    status = F.when(F.col("old_path").isNull(), "A").when(F.col("path").isNull(), "D").otherwise("R")
    return modified.unionByName(paired.select(F.coalesce("path", "old_path").alias("path"), "old_path", status.alias("status")))


def _lines(files: DataFrame) -> DataFrame:
    """(path, at, text, open) of each line, numbered from 0; ``open``: it has no line feed."""
    parts = F.split("contents", "\n")
    rows = files.where("contents IS NOT NULL").select("path", F.size(parts).alias("n"), F.posexplode(parts).alias("at", "text"))
    last = F.col("at") == F.col("n") - 1
    return rows.where(~(last & (F.col("text") == ""))).select("path", "at", "text", last.alias("open"))


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of (old, new) in which both rise."""
    pairs = sorted(pairs)
    ends, tops, back = [], [], []  # the least end of a run of each length, its row, and each row's predecessor
    for i, (_, x) in enumerate(pairs):
        k = bisect_left(ends, x)
        back.append(tops[k - 1] if k else -1)
        ends[k : k + 1], tops[k : k + 1] = [x], [i]
    keep, i = [], tops[-1] if tops else -1
    while i >= 0:
        keep.append(i)
        i = back[i]
    return [pairs[i] for i in reversed(keep)]


def _rising(frames):
    """Pairs of many paths, a row of lists each."""
    for frame in frames:
        out = [(p, rising([(x["old"], x["new"]) for x in pairs])) for p, pairs in zip(frame["path"], frame["pairs"], strict=True)]
        rows = [(p, old, new) for p, kept in out for old, new in kept]
        yield pd.DataFrame(rows, columns=["path", "old", "new"]).astype({"old": "Int32", "new": "Int32"})


def _anchors(one: DataFrame, two: DataFrame) -> DataFrame:
    once = [x.groupBy("path", *LINE).agg(F.count("*").alias("n"), F.min("at").alias(name)).where("n = 1").drop("n") for x, name in ((one, "old"), (two, "new"))]
    pairs = once[0].join(once[1], ["path", *LINE]).select("path", "old", "new")
    lists = pairs.groupBy("path").agg(F.collect_list(F.struct("old", "new")).alias("pairs"))
    return lists.mapInPandas(_rising, "path string, old int, new int")


def _gaps(lines: DataFrame, anchors: DataFrame, side: str) -> DataFrame:
    """Lines that are no anchors, with the number of anchors before them."""
    marks = anchors.select("path", F.col(side).alias("at"), F.lit(1).alias("anchor"))
    upto = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.join(marks, ["path", "at"], "left").withColumn("gap", F.sum(F.coalesce("anchor", F.lit(0))).over(upto))
    return rows.where("anchor IS NULL").select("path", "gap", F.lit(side).alias("side"), "at", *LINE)


CHANGES = "path string, op string, old_line int, new_line int"


def _compared(frames):
    """Opcodes of each gap's two lists of lines."""
    for frame in frames:
        out = []
        for path, old, new in zip(frame["path"], frame["old"], frame["new"], strict=True):
            a, b = ([(x["text"], x["open"]) for x in side] for side in (old, new))
            for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
                if tag == "equal":
                    out += [(path, " ", old[i + d]["at"] + 1, new[k + d]["at"] + 1) for d in range(j - i)]
                else:
                    out += [(path, "-", old[d]["at"] + 1, None) for d in range(i, j)] + [(path, "+", None, new[d]["at"] + 1) for d in range(k, m)]
        yield pd.DataFrame(out, columns=["path", "op", "old_line", "new_line"]).astype({"old_line": "Int32", "new_line": "Int32"})


def line_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, op, old_line, new_line) of every line of files that differ: `` `` kept, ``-`` deleted, ``+`` added; from 1."""
    differ = file_changes(before, after)
    paths = stored(differ.where("status <> 'R'").select("path").union(differ.where("status = 'R'").select("old_path")).union(differ.where("status = 'R'").select("path")).distinct(), "changed-paths")
    one, two = (stored(_lines(x.join(paths, "path", "left_semi")), "snapshot-lines") for x in (before, after))
    anchors = stored(_anchors(one, two), "anchors")
    line = F.struct("at", *LINE)
    gaps = _gaps(one, anchors, "old").unionByName(_gaps(two, anchors, "new")).groupBy("path", "gap")
    gaps = stored(gaps.agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == s, line))).alias(s) for s in ("old", "new")]), "gaps")
    kept = anchors.select("path", F.lit(" ").alias("op"), (F.col("old") + 1).alias("old_line"), (F.col("new") + 1).alias("new_line"))
    none = F.lit(None).cast("int")
    gone = gaps.where("size(new) = 0").select("path", F.explode("old").alias("x")).select("path", F.lit("-").alias("op"), (F.col("x.at") + 1).alias("old_line"), none.alias("new_line"))
    made = gaps.where("size(old) = 0").select("path", F.explode("new").alias("x")).select("path", F.lit("+").alias("op"), none.alias("old_line"), (F.col("x.at") + 1).alias("new_line"))
    mixed = gaps.where("size(old) > 0 AND size(new) > 0").select("path", "old", "new").mapInPandas(_compared, CHANGES)
    return kept.unionByName(gone).unionByName(made).unionByName(mixed)


def added_lines(changes: DataFrame) -> DataFrame:
    """(path, line): lines that ``line_changes`` adds, by their number in the new file."""
    return changes.where("op = '+'").select("path", F.col("new_line").cast("bigint").alias("line"))
