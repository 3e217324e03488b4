"""Unified diffs as tables, in DataFrame functions only.

Input: (diff, content), a whole diff in a row. A header is a line ``--- ``, one ``+++ `` and
one ``@@ `` in a row, so lines of a hunk that look like one alone don't end it.

Defined cases: null or empty content gives no rows; deleted files (``/dev/null``) have no
lines; ``\\ No newline`` marks count for neither side; quoted names are undone, their bytes being UTF-8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Escapes of one character in quoted names.
ESCAPES = {"a": "07", "b": "08", "t": "09", "n": "0A", "v": "0B", "f": "0C", "r": "0D"}


def unquoted(name: Column) -> Column:
    """A name as it is, or what stands between quotes with its escapes (octal bytes, letters) undone."""
    inner = F.regexp_extract(name, r'(?s)^"(.*)"$', 1)
    parts = F.regexp_extract_all(inner, F.lit(r"(?s)\\[0-7]{3}|\\.|[^\\]"), F.lit(0))
    letters = F.create_map(*[F.lit(x) for pair in ESCAPES.items() for x in pair])

    def bytes_of(x):
        code = F.lpad(F.conv(F.substring(x, 2, 3), 8, 16), 2, "0")
        known = F.try_element_at(letters, F.substring(x, 2, 1))
        return F.when(F.length(x) == 4, code).when(F.length(x) == 2, F.coalesce(known, F.hex(F.substring(x, 2, 1)))).otherwise(F.hex(x))

    return F.when(inner != "", F.decode(F.unhex(F.array_join(F.transform(parts, bytes_of), "")), "UTF-8")).otherwise(name)


def _name(line: Column) -> Column:
    """The path of a ``+++ `` line, without the prefix and a time stamp."""
    return F.regexp_replace(unquoted(F.regexp_extract(line, r"^\+\+\+ ([^\t]*)", 1)), "^b/", "")


def _lines(diffs: DataFrame) -> DataFrame:
    """(diff, section, pos, l, path, hunk, start): lines with the file and hunk they lie in."""
    sections = diffs.select("diff", F.posexplode(F.split("content", r"(?m)^(?=diff --git )")).alias("section", "body"))
    rows = sections.select("diff", "section", F.posexplode(F.split("body", "\r?\n")).alias("pos", "l"))
    order = Window.partitionBy("diff", "section").orderBy("pos")
    rows = rows.withColumns({"_1": F.lead("l", 1).over(order), "_2": F.lead("l", 2).over(order), "_b": F.lag("l", 1).over(order)})
    head = F.col("l").startswith("--- ") & F.col("_1").startswith("+++ ") & F.col("_2").startswith("@@ ")
    named = F.col("l").startswith("+++ ") & F.col("_b").startswith("--- ") & F.col("_1").startswith("@@ ")
    rows = rows.withColumns({"_head": F.coalesce(head, F.lit(False)), "_named": F.coalesce(named, F.lit(False))})
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    begins = F.regexp_extract("l", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", 1)
    hunk = F.when(begins != "", begins.cast("bigint"))
    rows = rows.withColumn("path", F.last(F.when(F.col("_named"), _name(F.col("l"))), ignorenulls=True).over(upto))
    rows = rows.withColumns({"_start": hunk, "_off": F.col("_head") | F.col("_named")})
    rows = rows.withColumn("hunk", F.sum(F.when(F.col("_start").isNotNull() | F.col("_head"), 1).otherwise(0)).over(upto))
    inside = Window.partitionBy("diff", "section", "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    kept = F.when(~F.col("_off") & F.col("_start").isNull() & F.substring("l", 1, 1).isin("+", " "), 1).otherwise(0)
    return rows.withColumns({"start": F.max("_start").over(inside), "_kept": kept}).withColumn("line", F.col("start") - 1 + F.sum("_kept").over(inside))


def added_lines(diffs: DataFrame) -> DataFrame:
    """(diff, path, line): lines that a diff adds, by their number in the new file."""
    rows = _lines(diffs).where((F.col("_kept") == 1) & F.col("l").startswith("+") & F.col("start").isNotNull() & (F.col("path") != "/dev/null"))
    return rows.select("diff", "path", "line")


def changed_files(diffs: DataFrame) -> DataFrame:
    """(diff, path) of files that a diff adds, changes or renames; deleted ones aren't among them."""
    hunks = _lines(diffs).where("_named").select("diff", _name(F.col("l")).alias("path"))
    sections = diffs.select("diff", F.explode(F.split("content", r"(?m)^(?=diff --git )")).alias("body")).where("body LIKE 'diff --git %'")
    gone = F.col("body").rlike(r"(?m)^deleted file mode")
    quoted = F.regexp_replace(unquoted(F.regexp_extract("body", r'^diff --git .* ("b/.*")\r?(?:\n|$)', 1)), "^b/", "")
    named = F.coalesce(F.nullif(quoted, F.lit("")), F.regexp_extract("body", r"^diff --git a/.* b/(.*?)\r?(?:\n|$)", 1))
    moved = F.coalesce(F.nullif(unquoted(F.regexp_extract("body", r"(?m)^rename to (.*?)\r?$", 1)), F.lit("")), named)
    return hunks.unionByName(sections.where(~gone).select("diff", moved.alias("path"))).where("path <> '/dev/null' AND path <> ''").distinct()
