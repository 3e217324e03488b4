"""The issue cache between runs, killed runs and pruning."""

import os

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators.issue_cache import DAY_MS, IssueCache

ISSUE = "rule string, line long"


def targets(spark, rows):
    return spark.createDataFrame(rows, "path string, key string")


class Parser:
    """Issues of a key: as many as its number; counts what it was asked for."""

    def __init__(self):
        self.asked = []

    def __call__(self, todo):
        self.asked.append(sorted(str(r["key"]) for r in todo.select("key").collect()))
        n = F.coalesce(F.regexp_extract("key", r"^k(\d)", 1).try_cast("int"), F.lit(1))
        return todo.select("key", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))).alias("line")).select("key", F.concat(F.lit("r"), "line").alias("rule"), F.col("line").cast("long").alias("line"))


def got(df):
    return sorted((r["path"], str(r["key"]), r["hit"], r["line"]) for r in df.collect())


def test_second_run_computes_misses_only(spark, tmp_path):
    cache, parse = IssueCache(spark, str(tmp_path / "c"), ISSUE), Parser()
    first = got(cache.run(targets(spark, [("a", "k1"), ("b", "k2"), ("c", "k0"), ("d", "k1")]), parse))
    assert first == [("a", "k1", False, 1), ("b", "k2", False, 1), ("b", "k2", False, 2), ("d", "k1", False, 1)]
    again = got(cache.run(targets(spark, [("a", "k1"), ("c", "k0"), ("e", "k3"), ("z", None)]), parse))
    assert again == [("a", "k1", True, 1), ("e", "k3", False, 1), ("e", "k3", False, 2), ("e", "k3", False, 3), ("z", "None", False, 1)]
    assert parse.asked[:2] == [["k0", "k1", "k2"], ["k3"]] and len(parse.asked) == 3  # k0 has no issues and is a hit
    other = IssueCache(spark, str(tmp_path / "c"), ISSUE)
    assert got(other.run(targets(spark, [("b", "k2")]), parse)) == [("b", "k2", True, 1), ("b", "k2", True, 2)] and parse.asked[3] == []
    assert cache.run(targets(spark, []), parse).count() == 0


def test_killed_run_leaves_no_entry(spark, tmp_path):
    cache, parse = IssueCache(spark, str(tmp_path / "c"), ISSUE), Parser()

    def fails(todo):
        def run(frames):
            for frame in frames:
                if "k2" in set(frame["key"]):
                    raise RuntimeError("lost")
                yield frame.assign(rule="r", line=1)[["key", "rule", "line"]]

        return todo.select("key").repartition(3, "key").mapInPandas(run, "key string, rule string, line long")

    with pytest.raises(Exception, match="lost"):
        cache.run(targets(spark, [("a", "k1"), ("b", "k2")]), fails).collect()
    assert cache.entries().count() == 0
    os.makedirs(tmp_path / "c/work/half")
    (tmp_path / "c/work/half/part-0.parquet").write_bytes(b"half")
    assert got(cache.run(targets(spark, [("a", "k1")]), parse)) == [("a", "k1", False, 1)] and parse.asked == [["k1"]]
    assert cache.prune() == 1 and not os.path.exists(tmp_path / "c/work")


def test_latest_entry_of_a_key_counts_whole(spark, tmp_path):
    cache = IssueCache(spark, str(tmp_path / "c"), ISSUE)
    for now, lines in ((1, (1, 2)), (2, (7,))):  # as two runs at once would publish
        name = cache._name(now)
        rows = [("k", now, name, None)] + [("k", now, name, ("r", x)) for x in lines]
        cache._publish(spark.createDataFrame(rows, cache.schema), "runs", name)
    assert [r["issue"]["line"] for r in cache.entries().where("issue IS NOT NULL").collect()] == [7]


def test_prune_keeps_what_was_published_or_used(spark, tmp_path):
    cache, parse = IssueCache(spark, str(tmp_path / "c"), ISSUE), Parser()
    cache.run(targets(spark, [("a", "k1"), ("b", "k2")]), parse, now=0)
    cache.run(targets(spark, [("c", "k3")]), parse, now=2 * DAY_MS)
    cache.run(targets(spark, [("a", "k1")]), parse, now=2 * DAY_MS)
    assert cache.prune(days=1, now=int(2.5 * DAY_MS)) == 2
    assert sorted(r["key"] for r in cache.entries().where("issue IS NULL").collect()) == ["k1", "k3"]
    assert len(os.listdir(tmp_path / "c/runs")) == 1 and got(cache.run(targets(spark, [("a", "k1")]), parse, now=3 * DAY_MS)) == [("a", "k1", True, 1)]
    assert cache.prune(days=1, now=9 * DAY_MS) == 0 and cache.entries().count() == 0


def test_keys_that_were_not_asked_for_are_an_error(spark, tmp_path):
    cache = IssueCache(spark, str(tmp_path / "c"), ISSUE)
    with pytest.raises(Exception, match="asked"):
        cache.run(targets(spark, [("a", "k1")]), lambda todo: todo.select(F.lit("k9").alias("key"), F.lit("r").alias("rule"), F.lit(1).alias("line"))).collect()
    assert cache.entries().count() == 0
