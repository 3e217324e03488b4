"""Patches from replacements, and files with patches applied.

A replacement is a range of bytes, or of lines and columns from 1 where no bytes are given;
these are looked up in the file's line index, as it was before any replacement.
Building: sorted by end, the last first, each put into the file's bytes by one SQL fold, then
a unified diff with three lines of context; a range that leaves the file, splits a character
or is turned round makes the whole patch empty. A range that ends with the file leaves out
its last byte. Applying: the patches of a file one after the other in the order given, each
where its lines are found nearest to the place it names; one that doesn't fit or changes
nothing is left out.

Defined cases: no replacements, or a null file, give an empty patch; a path without issues
gives no row; files and patches over null paths are left out. Files without a last line end
keep it so.
"""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .offsets import line_index, with_bytes

CONTEXT = 3
REPLACEMENT = "struct<start_byte:bigint,end_byte:bigint,start_line:bigint,start_column:bigint,end_line:bigint,end_column:bigint,data:string>"
RANGE = ("start_byte", "end_byte", "start_line", "start_column", "end_line", "end_column", "data")
NO_END = "\\ No newline at end of file\n"
# Rules whose fixes are never safe.
UNSAFE_RULES = ("eslint:@typescript-eslint/no-explicit-any", "eslint:@typescript-eslint/no-empty-interface", "eslint:@typescript-eslint/no-non-null-assertion")


def _resolved(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(_s, cuts): for each numbered row its replacements as byte ranges, the last first; a range without a place has nulls."""
    each = rows.select("_s", "path", F.posexplode("replacements").alias("nth", "r")).select("_s", "path", "nth", *[F.col(f"r.{c}").alias(c) for c in RANGE])
    bare = F.col("start_byte").isNull() | F.col("end_byte").isNull()
    index = line_index(files.join(each.where(bare).select("path").distinct(), "path", "left_semi"))
    sure = each.where(~bare).select("_s", "nth", "start_byte", "end_byte", "data")
    looked = with_bytes(with_bytes(each.where(bare).drop("start_byte", "end_byte"), index, "start_line", "start_column", "start_byte"), index, "end_line", "end_column", "end_byte")
    every = sure.unionByName(looked.select("_s", "nth", "start_byte", "end_byte", "data"))
    cut = F.struct("end_byte", "nth", F.col("start_byte").alias("start"), F.coalesce("data", F.lit("")).cast("binary").alias("data"))
    return every.groupBy("_s").agg(F.sort_array(F.collect_list(cut), asc=False).alias("cuts"))


def _cut(text: Column, cut: Column) -> Column:
    """``text`` (binary) with one replacement, or null if it doesn't fit."""
    size = F.octet_length(text)
    end = F.when((cut["end_byte"] == size) & (size > 0), size - 1).otherwise(cut["end_byte"])

    def starts_character(k):
        return ~F.hex(F.substring(text, k.cast("int") + 1, 1)).rlike("^[89AB]")

    fits = (cut["start"] >= 0) & (cut["start"] <= end) & (end < size) & starts_character(cut["start"]) & starts_character(end)
    return F.when(fits, F.concat(F.substring(text, F.lit(1), cut["start"].cast("int")), cut["data"], F.substring(text, end.cast("int") + 1, size)))


def modified(suggestions: DataFrame, files: DataFrame) -> DataFrame:
    """``suggestions`` (with path and replacements), ``_s``, and their file before and after all replacements, null if one doesn't fit."""
    rows = stored(suggestions.withColumn("_s", F.monotonically_increasing_id()), "suggestions")
    source = files.select(F.col("path").alias("_path"), F.col("contents").alias("before"))
    joined = rows.join(_resolved(rows, files), "_s", "left").join(source, F.col("path") == F.col("_path"), "left").drop("_path")
    after = F.when(F.size("cuts") > 0, F.aggregate("cuts", F.col("before").cast("binary"), _cut)).cast("string")
    return joined.withColumn("after", after).drop("cuts")


def unified(before: str, after: str) -> str:
    rows = difflib.unified_diff(before.splitlines(True), after.splitlines(True), "original", "modified", n=CONTEXT)
    return "".join(x if x.endswith("\n") else x + "\n" + NO_END for x in rows)


def build_patches(suggestions: DataFrame, files: DataFrame) -> DataFrame:
    """``suggestions`` (with path and replacements) with ``patch``; the diffs are made once and stored."""
    names = suggestions.columns
    rows = stored(modified(suggestions, files), "modified")

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"_s": frame["_s"], "patch": [unified(a, b) for a, b in zip(frame["before"], frame["after"], strict=True)]})

    made = stored(rows.where("after IS NOT NULL AND after <> before").select("_s", "before", "after").mapInPandas(run, "_s bigint, patch string"), "patches")
    return rows.drop("before", "after").join(made, "_s", "left").select(*names, F.coalesce("patch", F.lit("")).alias("patch"))


def patchable(patch: Column, path: Column, tool: Column, rule_key: Column, allow_unsafe: bool = False) -> Column:
    """Whether an issue's first suggestion can be applied."""
    safe = F.lit(allow_unsafe) | ~F.concat_ws(":", tool, rule_key).isin(*UNSAFE_RULES)
    return F.coalesce(patch, F.lit("")).cast("string").__ne__("") & path.isNotNull() & safe


def hunks(patch: str) -> list[tuple[int, list[str], list[str]]]:
    """(line from 0, lines before, lines after) of each hunk."""
    out: list[tuple[int, list[str], list[str]]] = []
    for row in patch.splitlines(True):
        head = re.match(r"@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@", row)
        if head:
            out.append((int(head[1]) - (head[2] != "0"), [], []))
        elif out and row.startswith("\\"):
            for side in last:
                side[-1] = side[-1].removesuffix("\n")
        elif out and row[0] in " -+":
            last = [side for side, marks in ((out[-1][1], " -"), (out[-1][2], " +")) if row[0] in marks]
            for side in last:
                side.append(row[1:])
    return out


def applied(contents: str, patch: str) -> str | None:
    """The contents after the patch, or None if it doesn't fit."""
    lines, moved = contents.splitlines(True), 0
    for at, before, after in hunks(patch):
        places = sorted(range(len(lines) - len(before) + 1), key=lambda k: abs(k - at - moved))
        place = next((k for k in places if lines[k : k + len(before)] == before), None)
        if place is None:
            return None
        lines[place : place + len(before)] = after
        moved = place - at + len(after) - len(before)
    return "".join(lines)


def apply_patches(files: DataFrame, patches: DataFrame) -> DataFrame:
    """(path, contents, fixed): files that have patches (path, position, patch), and the positions that changed them."""
    listed = patches.where("path IS NOT NULL AND patch <> ''").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("position", "patch"))).alias("patches"))

    def run(frames):
        for frame in frames:
            rows = []
            for path, text, todo in zip(frame["path"], frame["contents"], frame["patches"], strict=True):
                fixed = []
                for p in todo:
                    after = applied(text, p["patch"])
                    if after is not None and after != text:
                        text = after
                        fixed.append(p["position"])
                rows.append((path, text, fixed))
            yield pd.DataFrame(rows, columns=["path", "contents", "fixed"])

    return files.where("contents IS NOT NULL").select("path", "contents").join(listed, "path").mapInPandas(run, "path string, contents string, fixed array<bigint>")
