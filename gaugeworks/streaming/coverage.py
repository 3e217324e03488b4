"""Coverage reports merged as they arrive.

Each micro-batch's reports are added to running line sums by (path, position). State grows
with the lines of the code base, not with the number of reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def read_reports(spark, path: str) -> DataFrame:
    """A stream of Parquet files of (path, hits)."""
    return spark.readStream.schema("path string, hits array<bigint>").option("maxFilesPerTrigger", 8).parquet(path)


def running_lines(reports: DataFrame) -> DataFrame:
    """(path, pos, hit, reports) in complete or update mode."""
    lines = reports.select("path", F.posexplode("hits").alias("pos", "hit"))
    merged = lines.groupBy("path", "pos").agg(F.min("hit").alias("low"), F.sum("hit").alias("sum"), F.count("*").alias("reports"))
    return merged.select("path", "pos", F.when(F.col("low") < 0, F.col("low")).otherwise(F.col("sum")).alias("hit"), "reports")


def running_merge(reports: DataFrame) -> DataFrame:
    """``running_lines`` with a row more a path, at position -1, that counts all its reports, empty ones too."""
    marked = F.concat(F.array(F.lit(0).cast("bigint")), F.coalesce("hits", F.array().cast("array<bigint>")))
    lines = running_lines(reports.select("path", marked.alias("hits")))
    return lines.withColumn("pos", F.col("pos") - 1)


def merged_lines(running: DataFrame) -> DataFrame:
    """(path, pos, hit) of a complete table of ``running_merge``, cut to the shortest report as a batch merge is."""
    every = F.max(F.when(F.col("pos") == -1, F.col("reports"))).over(Window.partitionBy("path"))
    return running.withColumn("_all", every).where((F.col("pos") >= 0) & (F.col("reports") == F.col("_all"))).select("path", "pos", "hit")
