from gaugeworks.operators import bundles, issues
from gaugeworks.operators.issues import positions


def test_marking_shuffles_whole_rows_once(spark):
    rows = spark.createDataFrame([(1, "a", 3, 5), (2, "a", None, 9), (3, "b", None, None), (4, None, 1, 1), (5, "a", 6, 2), (6, "b", 1, 2), (7, "a", 60, 70)], "id int, path string, start_line long, end_line long")
    added = spark.createDataFrame([("a", 5), ("a", 66), ("c", 1)], "path string, line long")
    out = issues.mark_added(rows, added)
    assert sorted((r["id"], r["on_added_line"]) for r in out.collect()) == [(1, True), (2, True), (3, False), (4, True), (5, False), (6, False), (7, True)]
    outer = out._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter")
    assert outer == 1


def test_parts_are_moved_in_one_pass(spark, tmp_path, monkeypatch):
    made, plain = [], bundles._path
    monkeypatch.setattr(bundles, "_path", lambda s, text: made.append(text) or plain(s, text))
    rows = positions(spark.range(30).selectExpr("id AS path").orderBy("path"))
    parts = bundles.write_bundle(str(tmp_path / "b"), {"file_coverages": rows}, {}, {}, {"file_coverages": 1})
    assert [p["rows"] for p in parts] == [1] * 30 and len(bundles.manifest(spark, str(tmp_path / "b"))) == 30
    assert len(made) < 30  # not one lookup of Hadoop's classes, or more, for each part
