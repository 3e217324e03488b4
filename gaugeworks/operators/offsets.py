"""Places in texts: lines and columns to byte offsets and back.

``line_index`` is a table of a file's lines with the byte at which each begins. A line and
column look their byte up by an equi-join on (path, line); a byte offset finds its line as
the last one that begins at or before it, by one sweep over both tables (an as-of look-up).
``place_in`` does the latter within a row that carries its text.

Lines and columns count from 1, columns in code points; a column behind a line's end is that
end, one that is missing or 0 the start. A text's last line feed begins no line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_index(files: DataFrame) -> DataFrame:
    """(path, line, start, text) of files (path, contents); paths are distinct."""
    parts = F.split("contents", "\n")
    rows = files.where("contents IS NOT NULL").select("path", F.size(parts).alias("n"), F.posexplode(parts).alias("at", "text"))
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.octet_length("text") + 1).over(before), F.lit(0)).cast("bigint"))
    return rows.where("NOT (at = n - 1 AND text = '')").select("path", (F.col("at") + 1).cast("bigint").alias("line"), "start", "text")


def with_bytes(places: DataFrame, index: DataFrame, line: str, column: str, name: str) -> DataFrame:
    """``places`` (with path) and ``name``, the byte offset of a line and column; null if there is no such line."""
    lines = index.select(F.col("path").alias("_path"), F.col("line").alias("_line"), F.col("start").alias("_start"), F.col("text").alias("_text"))
    rows = places.join(lines, (F.col("path") == F.col("_path")) & (F.col(line) == F.col("_line")), "left")
    ahead = F.greatest(F.coalesce(column, F.lit(1)) - 1, F.lit(0)).cast("int")
    return rows.withColumn(name, F.col("_start") + F.octet_length(F.substring("_text", F.lit(1), ahead))).drop("_path", "_line", "_start", "_text")


def with_places(offsets: DataFrame, index: DataFrame, offset: str, line: str = "line", column: str = "column") -> DataFrame:
    """``offsets`` (with path) and the line and column of a byte offset; null outside of the file's lines."""
    own = offsets.select("path", F.col(offset).alias("_at"), F.lit(1).alias("_side"), F.struct(*offsets.columns).alias("_row"))
    marks = index.select("path", F.col("start").alias("_at"), F.lit(0).alias("_side"), F.struct("line", "start", "text").alias("_mark"))
    order = Window.partitionBy("path").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = own.unionByName(marks, allowMissingColumns=True).withColumn("_mark", F.last("_mark", ignorenulls=True).over(order)).where("_side = 1")
    inside = F.col("_at") - F.col("_mark.start")
    within = inside <= F.octet_length("_mark.text")
    chars = F.length(F.substring(F.col("_mark.text").cast("binary"), F.lit(1), inside.cast("int")).cast("string"))
    return rows.select("_row.*", F.when(within, F.col("_mark.line")).alias(line), F.when(within, chars + 1).cast("bigint").alias(column))


def place_in(text: Column, offset: Column) -> Column:
    """Struct (line, column) of a byte offset of ``text``, the column in bytes; zeros behind the last line."""
    head = F.substring(text.cast("binary"), F.lit(1), offset.cast("int")).cast("string")
    size = F.octet_length(text) + F.when(text.endswith("\n"), 0).otherwise(1)
    line = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
    column = F.octet_length(F.substring_index(head, "\n", -1)) + 1
    known = (offset >= 0) & (offset < size)
    return F.struct(F.when(known, line).otherwise(0).cast("bigint").alias("line"), F.when(known, column).otherwise(0).cast("bigint").alias("column"))


def bytes_before(text: Column, chars: Column) -> Column:
    """Bytes of the first ``chars`` code points; null if the text has no code point behind them."""
    return F.when(chars < F.length(text), F.octet_length(F.substring(text, F.lit(1), chars.cast("int"))))
