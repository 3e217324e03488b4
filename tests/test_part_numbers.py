"""Numbers of parts beyond three digits, which two queries' own SQL cuts to three."""

from gaugeworks.operators import bundles, sinks


def test_parts_beyond_a_thousand_have_names_of_their_own(spark):
    placed = spark.createDataFrame([(1,), (200_001,), (2_000_001,)], "position bigint")
    assert [r["file"] for r in sinks.part_files(placed, "issues").orderBy("position").collect()] == ["issues-000.jsonl", "issues-100.jsonl", "issues-1000.jsonl"]
    rows = bundles._parts(placed.selectExpr("position", "'x' AS v"), "t", 150)
    assert [r["file"] for r in rows.orderBy("position").collect()] == ["t-000.jsonl", "t-1333.jsonl", "t-13333.jsonl"]
