"""A cache of issues that is kept between runs, as Parquet keyed by content.

A key is a digest of all that a result depends on (``keyed_digest`` of tool, version,
configuration and the file's digest). A run looks its targets up, computes only the keys that
no entry has, publishes them and returns hits and fresh rows as one table.

Layout: ``runs/<time>-<id>`` holds what one run published, a row for each issue and one
without an issue for each key, so a key without issues is an entry too; ``uses/<time>-<id>``
holds the keys that a run found. A table is written beside its place, under ``work``, and then
renamed: a run that is killed, or whose tasks fail, leaves nothing that a reader sees. Any
number of runs may publish at once; of several entries of a key the latest counts, whole.

Pruning drops keys that were neither published nor used since a time. What stays is published
as one run before older ones are deleted, so a crash in between leaves entries twice, which
readers don't see, and loses none. Pruning must not overlap with runs that read.

Defined cases: a null key is never cached, its rows are computed each time; targets that share
a key share its issues; a cache that doesn't exist is empty; what ``compute`` returns for keys
it wasn't given is an error.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored

DAY_MS = 24 * 3600 * 1000


class IssueCache:
    """``schema``: the columns of an issue, without ``key``."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str):
        self.spark, self.root = spark, root.rstrip("/")
        self.issue = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        self.schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("at", T.LongType()), T.StructField("run", T.StringType()), T.StructField("issue", self.issue)])

    # -------------------------------------------------------------- files

    def _fs(self):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _tables(self, kind: str) -> list[str]:
        fs, where = self._fs(), self._path(kind)
        return sorted(x.getPath().toString() for x in fs.listStatus(where)) if fs.exists(where) else []

    def _publish(self, rows: DataFrame, kind: str, name: str) -> None:
        work = self._path("work", name)
        rows.write.parquet(work.toString())
        fs = self._fs()
        fs.mkdirs(self._path(kind))
        if not fs.rename(work, self._path(kind, name)):
            raise OSError(f"{name} can't be published in {self.root}")

    @staticmethod
    def _name(now: int) -> str:
        return f"{now:015d}-{uuid.uuid4().hex}"

    # -------------------------------------------------------------- entries

    def entries(self) -> DataFrame:
        """(key, at, run, issue) of the latest entry of each key; a row without an issue for each."""
        paths = self._tables("runs")
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        if len(paths) == 1:
            return rows
        latest = rows.where("issue IS NULL").groupBy("key").agg(F.max("run").alias("run"))
        return rows.join(latest, ["key", "run"], "left_semi")

    def lookup(self, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Distinct keys of ``targets`` that have an entry, and those that have none."""
        keys = targets.select("key").where("key IS NOT NULL").distinct()
        known = self.entries().where("issue IS NULL").select("key")
        found = stored(keys.join(known.withColumn("hit", F.lit(True)), "key", "left"), "cache-lookup")
        return found.where("hit").select("key"), found.where("hit IS NULL").select("key")

    def run(self, targets: DataFrame, compute: Callable[[DataFrame], DataFrame], now: int | None = None) -> DataFrame:
        """``targets`` with the issues of their keys, all columns of both and ``hit``; targets without issues have no row.

        ``compute`` gets the targets that miss, one for each key, and returns ``key`` and an issue's columns.
        """
        now = int(time.time() * 1000) if now is None else now
        hits, misses = self.lookup(targets)
        name = self._name(now)
        todo = targets.where("key IS NOT NULL").join(misses, "key", "left_semi").dropDuplicates(["key"])
        columns = self.issue.names
        issue = F.struct(*[F.col(c).cast(self.issue[c].dataType).alias(c) for c in columns])
        fresh = compute(todo).select("key", issue.alias("issue")).join(misses.withColumn("asked", F.lit(True)), "key", "left")
        fresh = fresh.select(F.when(F.col("asked"), F.col("key")).otherwise(F.raise_error(F.lit("a key that wasn't asked for"))).alias("key"), "issue")
        marks = misses.select("key", F.lit(None).cast(self.issue).alias("issue"))
        if not misses.isEmpty():
            self._publish(marks.unionByName(fresh).select("key", F.lit(now).alias("at"), F.lit(name).alias("run"), "issue"), "runs", name)
        if not hits.isEmpty():
            self._publish(hits.select("key", F.lit(now).alias("at")), "uses", name)
        rows = self.entries().where("issue IS NOT NULL").select("key", F.col("run") != name, "issue.*").toDF("key", "hit", *columns)
        whole = targets.join(rows, "key")
        bare = targets.where("key IS NULL")
        if bare.isEmpty():
            return whole
        own = stored(bare.withColumn("key", F.concat(F.lit("null-"), F.monotonically_increasing_id().cast("string"))), "cache-null-keys")
        extra = own.join(compute(own).select("key", *columns).withColumn("hit", F.lit(False)), "key").withColumn("key", F.lit(None).cast("string"))
        return whole.unionByName(extra)

    def prune(self, days: float = 1, now: int | None = None) -> int:
        """Drop keys not published or used within ``days``; returns how many stay. Remains of killed runs go too."""
        now = int(time.time() * 1000) if now is None else now
        old_runs, old_uses, fs = self._tables("runs"), self._tables("uses"), self._fs()
        rows = self.entries()
        seen = rows.where("issue IS NULL").select("key", "at")
        if old_uses:
            seen = seen.unionByName(self.spark.read.schema("key string, at long").parquet(*old_uses))
        fresh = seen.groupBy("key").agg(F.max("at").alias("seen")).where(F.col("seen") >= F.lit(int(now - days * DAY_MS)))
        name = self._name(now)
        kept = stored(rows.join(fresh, "key").select("key", F.col("seen").alias("at"), F.lit(name).alias("run"), "issue"), "cache-kept")
        left = kept.where("issue IS NULL").count()
        if left:
            self._publish(kept, "runs", name)
        for path in [*old_runs, *old_uses]:
            fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)
        fs.delete(self._path("work"), True)
        return left
