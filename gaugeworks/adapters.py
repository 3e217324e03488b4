"""Deterministic record tables made from the driver's tables, in Spark and in SQL.

Each adapter has a twin ``*_SQL``: a common table expression that DuckDB can run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` of a small file over all cores, as the texts made from them are many times larger."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def file_coverage(t) -> DataFrame:
    """(path, report, hits): two reports a path, lines in a fixed order."""
    hit = F.when(F.col("l_linenumber") == 7, F.lit(-1)).when(F.col("l_returnflag") == "R", F.lit(0)).otherwise(F.col("l_quantity")).cast("bigint")
    row = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate", hit.alias("hit"))
    grouped = t("lineitem").groupBy(F.concat(F.lit("src/"), F.col("l_partkey"), F.lit(".x")).alias("path"), F.col("l_linestatus").alias("report"))
    return grouped.agg(F.array_sort(F.collect_list(row)).alias("rows")).select("path", "report", F.transform("rows", lambda r: r["hit"]).alias("hits"))


FILE_COVERAGE_SQL = """file_coverage AS (
  SELECT 'src/' || l_partkey || '.x' AS path, l_linestatus AS report,
    list(CAST(CASE WHEN l_linenumber = 7 THEN -1 WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END AS BIGINT)
         ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate) AS hits
  FROM lineitem GROUP BY 1, 2)"""


def issues(t) -> DataFrame:
    """One issue a line item: tool by priority, rule by flags, path by part, lines by quantity."""
    o = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_orderdate")
    rows = t("lineitem").join(o, "l_orderkey")
    start = F.col("l_quantity").cast("bigint")
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.lower(F.regexp_replace("o_orderpriority", "^[0-9]-| ", "")).alias("tool"),
        F.concat("l_linestatus", F.lit("_"), "l_returnflag").alias("rule_key"),
        (F.lit(10) * (1 + F.pmod(F.col("l_linenumber"), F.lit(5)))).cast("bigint").alias("level"),
        F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.pmod(F.col("l_suppkey"), F.lit(len(CATEGORIES))) + 1).cast("int")).alias("category"),
        F.concat(F.lit("pkg"), F.pmod(F.col("l_partkey"), F.lit(7)), F.lit("/mod"), F.pmod(F.col("l_partkey"), F.lit(31)), F.lit("/f"), F.col("l_partkey"), F.lit(".py")).alias("path"),
        start.alias("start_line"),
        (start + F.pmod(F.col("l_linenumber"), F.lit(4)) - 1).cast("bigint").alias("end_line"),
        F.concat(F.lit("item "), F.col("l_linenumber")).alias("message"),
        F.col("o_orderdate").alias("seen_at"),
    )


CATEGORIES = ("CATEGORY_BUG", "CATEGORY_VULNERABILITY", "CATEGORY_LINT", "CATEGORY_SECRET", "CATEGORY_STYLE")

ISSUES_SQL = f"""issues AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
    lower(regexp_replace(o_orderpriority, '^[0-9]-| ', '', 'g')) AS tool, l_linestatus || '_' || l_returnflag AS rule_key,
    CAST(10 * (1 + l_linenumber % 5) AS BIGINT) AS level, [{", ".join(f"'{c}'" for c in CATEGORIES)}][1 + l_suppkey % {len(CATEGORIES)}] AS category,
    'pkg' || (l_partkey % 7) || '/mod' || (l_partkey % 31) || '/f' || l_partkey || '.py' AS path,
    CAST(l_quantity AS BIGINT) AS start_line, CAST(l_quantity AS BIGINT) + l_linenumber % 4 - 1 AS end_line,
    'item ' || l_linenumber AS message, o_orderdate AS seen_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def added_lines(t) -> DataFrame:
    """(path, line) that a change adds: line items shipped after a date."""
    rows = t("lineitem").where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp"))
    path = F.concat(F.lit("pkg"), F.pmod(F.col("l_partkey"), F.lit(7)), F.lit("/mod"), F.pmod(F.col("l_partkey"), F.lit(31)), F.lit("/f"), F.col("l_partkey"), F.lit(".py"))
    return rows.select(path.alias("path"), F.col("l_quantity").cast("bigint").alias("line")).distinct()


ADDED_SQL = """added_lines AS (
  SELECT DISTINCT 'pkg' || (l_partkey % 7) || '/mod' || (l_partkey % 31) || '/f' || l_partkey || '.py' AS path, CAST(l_quantity AS BIGINT) AS line
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')"""


def stats(t) -> DataFrame:
    """File stats with hierarchical paths from customers."""
    n, r = t("nation"), t("region")
    rows = t("customer").join(F.broadcast(n), F.col("c_nationkey") == n["n_nationkey"]).join(F.broadcast(r), F.col("n_regionkey") == r["r_regionkey"])
    path = F.concat_ws("/", F.lower("r_name"), F.lower(F.regexp_replace("n_name", " ", "_")), F.lower("c_mktsegment"), F.concat("c_name", F.lit(".py")))
    return rows.select(
        F.lit("FILE").alias("kind"),
        path.alias("path"),
        F.lit(1).cast("bigint").alias("files"),
        F.pmod(F.col("c_custkey"), F.lit(3)).cast("bigint").alias("classes"),
        F.pmod(F.col("c_custkey"), F.lit(11)).cast("bigint").alias("functions"),
        (F.floor(F.abs("c_acctbal")) + 1).cast("bigint").alias("lines"),
        F.floor(F.abs("c_acctbal") / 2).cast("bigint").alias("code_lines"),
        F.pmod(F.col("c_custkey"), F.lit(17)).cast("bigint").alias("complexity"),
        F.when(F.pmod(F.col("c_custkey"), F.lit(3)) > 0, F.pmod(F.col("c_custkey"), F.lit(5))).cast("bigint").alias("lcom4"),
    )


STATS_SQL = """stats AS (
  SELECT 'FILE' AS kind, concat_ws('/', lower(r_name), lower(replace(n_name, ' ', '_')), lower(c_mktsegment), c_name || '.py') AS path,
    CAST(1 AS BIGINT) AS files, CAST(c_custkey % 3 AS BIGINT) AS classes, CAST(c_custkey % 11 AS BIGINT) AS functions,
    CAST(floor(abs(c_acctbal)) + 1 AS BIGINT) AS lines, CAST(floor(abs(c_acctbal) / 2) AS BIGINT) AS code_lines, CAST(c_custkey % 17 AS BIGINT) AS complexity,
    CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 5 AS BIGINT) END AS lcom4
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def files(t) -> DataFrame:
    """Source files: the documents' texts."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("xx")), F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".txt")))
    return t("documents").select(path.alias("path"), F.col("text").alias("contents"))


FILES_SQL = """files AS (
  SELECT concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'xx'), 'doc' || doc_id || '.txt') AS path, text AS contents FROM documents)"""


def invocations(t) -> DataFrame:
    """Tool invocations from events."""
    plugin = F.element_at(F.array(*[F.lit(p) for p in PLUGINS]), (F.pmod(F.col("user_id"), F.lit(len(PLUGINS))) + 1).cast("int"))
    failed = (F.col("event_type") == "error") & (F.pmod(F.col("event_id"), F.lit(97)) == 0)
    return t("events").select(F.col("event_id").alias("id"), plugin.alias("plugin"), "event_type", F.when(failed, 2).when(F.col("event_type") == "error", 1).otherwise(0).cast("bigint").alias("exit_code"), F.col("user_id").alias("targets_key"), "ts", "props")


PLUGINS = ("urgent", "high", "medium", "notspecified", "low")

INVOCATIONS_SQL = f"""invocations AS (
  SELECT event_id AS id, [{", ".join(f"'{p}'" for p in PLUGINS)}][1 + user_id % {len(PLUGINS)}] AS plugin, event_type,
    CAST(CASE WHEN event_type = 'error' AND event_id % 97 = 0 THEN 2 WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS exit_code, user_id AS targets_key, ts, props
  FROM events)"""
