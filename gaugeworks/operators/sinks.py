"""Exports: JSON tables in numbered parts, SARIF results and rules, text tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of an exported file and the largest string exported as it is.
PART_ROWS = {"invocations": 200, "issues": 2000, "messages": 10_000, "stats": 10_000, "coverage": 5000}
MAX_TEXT = 4_000_000
SARIF_LEVELS = {50: "error", 40: "warning", 30: "note", 20: "note", 10: "note", 0: "none"}


def omit_long_text(df: DataFrame, columns: list[str], limit: int = MAX_TEXT) -> DataFrame:
    """Strings over ``limit`` bytes are replaced by a note of their size."""
    note = lambda c: F.concat(F.lit("[omitted: "), F.octet_length(c).cast("string"), F.lit(" bytes]"))
    return df.withColumns({c: F.when(F.octet_length(c) > limit, note(c)).otherwise(F.col(c)) for c in columns})


def part_files(placed: DataFrame, table: str) -> DataFrame:
    """``file`` of each row of a table with ``position`` (from 1): parts of the table's size, numbered from 000."""
    part = F.floor((F.col("position") - 1) / PART_ROWS[table]).cast("string")
    width = F.greatest(F.length(part), F.lit(3))
    return placed.withColumn("file", F.concat(F.lit(f"{table}-"), F.lpad(part, width, F.lit("0")), F.lit(".jsonl")))


def short_numbers(file: Column, digits: int = 3) -> Column:
    """Names of numbered parts with the first ``digits`` digits of each number alone: a label, as several parts share one."""
    return F.regexp_replace(file, f"-([0-9]{{{digits}}})[0-9]*([.]jsonl)$", "-$1$2")


def write_parts(placed: DataFrame, path: str, table: str) -> None:
    """JSON lines of a table with ``position``, one folder a numbered file; a part is one task's, however many there are."""
    rows = part_files(placed, table)
    body = F.to_json(F.struct(*[c for c in placed.columns if c != "position"]))
    rows = rows.select("file", "position", body.alias("value")).repartition("file").sortWithinPartitions("file", "position")
    rows.select("file", "value").write.mode("overwrite").partitionBy("file").text(path)


def write_rows(df: DataFrame, path: str, table: str, compress: bool = False) -> None:
    """JSON lines in files of the table's part size."""
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", PART_ROWS[table])
    (writer.option("compression", "gzip") if compress else writer).json(path)


def write_report(tables: dict[str, DataFrame], metadata: dict, path: str, compress: bool = False) -> None:
    """A report's tables and one metadata document; a table with ``position`` goes into numbered parts."""
    for name, df in tables.items():
        if "position" in df.columns:
            write_parts(df, f"{path}/{name}", name)
        else:
            write_rows(df, f"{path}/{name}", name, compress)
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def sarif_results(issues: DataFrame) -> DataFrame:
    """One SARIF result a row, as JSON (``result``): a run is these rows and ``sarif_rules``."""
    level = F.create_map(*[F.lit(x) for pair in SARIF_LEVELS.items() for x in pair])[F.col("level").cast("int")]
    region = F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return issues.select("id", F.to_json(F.struct(F.col("rule_key").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("result"))


def sarif_rules(issues: DataFrame) -> DataFrame:
    """Rules by key alone: two tools' rules of one name are one."""
    return issues.groupBy(F.col("rule_key").alias("id")).agg(F.min("tool").alias("tool"))


def exit_code(issues: DataFrame, fail_level: int) -> int:
    """1 if any issue fails."""
    return 0 if issues.where(F.col("level") >= fail_level).isEmpty() else 1


def table_lines(df: DataFrame, columns: list[str], sums: list[str]) -> DataFrame:
    """Rows of a text table, numbers with thousands separators."""
    return df.select(*columns, *[F.format_number(F.col(c), 0).alias(c) for c in sums])


def tree_text(nodes: DataFrame) -> DataFrame:
    """(path, enter, line): an indented line a node, to be read in order of ``enter``."""
    return nodes.select("path", "enter", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("("), "kind", F.lit(")")).alias("line"))
