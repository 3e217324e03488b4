"""Work made from small tables goes over all cores, and no step gathers whole tables in one place."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import issues, patterns, snapshots, stats, trees, versions
from gaugeworks.plans import metric_queries, tree_queries
from gaugeworks.sources.trees import nodes

CODE = "class A:\n    def m(self, a, *, b):\n        # why\n        return lambda c: self.x\n    def n(self):\n        return self.x or 1\ndef f():\n    pass\n"


@pytest.fixture
def files(spark):
    return spark.createDataFrame([("p", CODE), ("q", CODE), ("r", "x = 1\n")], "path string, contents string")


@pytest.mark.parametrize("made", [tree_queries.sources, tree_queries.modules, metric_queries.programs])
def test_texts_of_one_small_file_are_made_over_all_cores(spark, sf, made):
    rows = made(lambda name: spark.read.parquet(f"{sf}/{name}.parquet"))
    assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_columns_and_masses_asked_for_are_those_of_the_whole_table(files):
    whole = nodes(files, "python").where("mass >= 3")
    some = nodes(files, "python", columns=trees.DUPLICATION, least_mass=3)
    assert some.columns == [c for c in whole.columns if c in trees.DUPLICATION]
    assert sorted(map(str, some.collect())) == sorted(map(str, whole.select(*some.columns).collect()))


def test_parameters_need_one_parse(files):
    table = trees.parameters(nodes(files, "python", digests=False))
    assert table._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = sorted((r["path"], r["name"], r["n"]) for r in table.collect())
    assert got == [(p, n, k) for p in "pq" for n, k in (("f", 0), ("m", 2), ("n", 0))]


def test_stats_and_patterns_broadcast_nothing(files):
    table = patterns.pattern_nodes(nodes(files, "python", digests=False, columns=patterns.COLUMNS), files)
    found = patterns.captures(table, ["(ClassDef (FunctionDef) @m)"])
    for df in (found, stats.file_stats(files), stats.function_stats(files), stats.file_lines(files)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_lines_alone_equal_those_of_stats(files):
    want = stats.file_stats(files).select("path", *stats.LINES).toPandas().sort_values("path", ignore_index=True)
    pd.testing.assert_frame_equal(stats.file_lines(files).toPandas().sort_values("path", ignore_index=True), want)


def test_comparators_are_read_once_each(spark):
    frame = spark.range(1).selectExpr("cast(id AS string) AS key", "'^1.5 || >=2.0.0-a, <3' AS requirement")
    plan = frame.select(versions.satisfies(F.col("key"), F.col("requirement")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(") <= 12


def test_issues_of_a_plugin_do_not_meet_in_one_task(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = spark.createDataFrame([("a", "r", ""), ("b", "r", "")], "tool string, rule_key string, documentation_url string")
        plugins = spark.createDataFrame([("a", "x/${rule}", "block", 0)], "tool string, url_template string, plugin_mode string, ordinal int")
        runs = spark.createDataFrame([("a", 2)], "plugin string, exit_code int")
        for df in (issues.documentation_urls(found, plugins), issues.plugin_modes(found.withColumn("mode", F.lit("none")), plugins), issues.drop_failed_plugins(found, runs)):
            assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert [r["tool"] for r in issues.drop_failed_plugins(found, runs).collect()] == ["b"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rising_pairs_come_in_batches_of_paths(spark):
    assert snapshots.rising([(3, 1), (0, 0), (1, 3), (2, 4)]) == [(0, 0), (1, 3), (2, 4)]
    assert snapshots.rising([]) == []
    one = spark.createDataFrame([("p", 0, "a", False), ("p", 1, "b", False)], "path string, at int, text string, open boolean")
    plan = snapshots._anchors(one, one)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan
