"""Coverage arrays and report formats on small inputs."""

import pytest

from gaugeworks.operators import coverage as C
from gaugeworks.sources import coverage_formats as R


def hits(df):
    return sorted((r["path"], list(r["hits"])) for r in df.collect())


CASES = [
    ([[1, 2, 3]], [1, 2, 3]),
    ([[]], []),
    ([[1, -1], [2, 5]], [3, -1]),
    ([[0, 0], [0, 1]], [0, 1]),
    ([[-1], [-1]], [-1]),
    ([[1, 2, 3], [1]], [2]),
    ([[1], []], []),
    ([[-2, 1], [3, 0]], [-2, 1]),
    ([[1, 0, -1], [1, 0, -1], [0, 5, 7]], [2, 5, -1]),
    ([[10**12], [10**12]], [2 * 10**12]),
]


def test_merge(spark):
    rows = [(f"p{i}", h) for i, (reports, _) in enumerate(CASES) for h in reports]
    df = spark.createDataFrame(rows, "path string, hits array<bigint>").repartition(3)
    assert hits(C.merge_reports(df)) == sorted((f"p{i}", want) for i, (_, want) in enumerate(CASES))


def test_totals(spark):
    df = spark.createDataFrame([("a", [1, -1, 0]), ("a", [0, 1]), ("b", [])], "path string, hits array<bigint>")
    raw = C.combined_totals(df).first()
    assert (raw["covered"], raw["uncovered"], raw["omitted"], raw["total"]) == (1, 2, 0, 3)
    assert C.totals(df.limit(0)).first()["pct"] == 0.0
    s = C.summarize(spark.createDataFrame([("a", [-1, -2, 0, 4])], "path string, hits array<bigint>")).first()
    assert (s["omit"], s["missed"], s["covered"], s["total"]) == (1, 1, 2, 4)


@pytest.mark.parametrize(
    "glob, yes, no",
    [("**/*.py", ["a.py", "x/y/a.py"], ["a.pyc"]), ("src/*", ["src/a", "src/a/b"], ["srca", "x/src/a"]), ("*.min.*", ["a.min.js", "x/y/a.min.js"], ["amin.js"]), ("a/{b,c}/**", ["a/b/x", "a/c/y/z"], ["a/d/x"]), ("[!a]?.c", ["bc.c"], ["ab.c", "b.c"])],
)
def test_globs(spark, glob, yes, no):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(p,) for p in yes + no], "path string")
    assert sorted(r["path"] for r in df.where(C.matches(F.col("path"), [glob])).collect()) == sorted(yes)


def test_globs_within_names():
    import re

    assert [bool(re.search(C.glob_regex("src/*.{py,p?}", True), x)) for x in ("src/a.py", "src/a/b.py", "src/a.px", "src/a.p/")] == [True, False, True, False]


def report(spark, content):
    return spark.createDataFrame([("f", content)], "file string, content string")


def test_lcov(spark):
    text = "TN:\nSF:a.c\nDA:3,1\nDA:3,2\nDA:1,0\nLF:2\nend_of_record\nSF:b.c\nend_of_record\n"
    assert hits(R.lcov(report(spark, text))) == [("a.c", [0, -1, 3]), ("b.c", [])]
    with pytest.raises(Exception, match="(?i)cast|negative"):
        R.lcov(report(spark, "SF:a\nDA:1,x\nend_of_record")).collect()


def test_xml_formats(spark):
    cobertura = '<coverage><packages><package><classes><class filename="a"><lines><line number="2" hits="1"/><line number="2" hits="3"/><line number="1" hits="x"/></lines></class><class filename="b"><lines/></class></classes></package></packages></coverage>'
    assert hits(R.cobertura(report(spark, cobertura))) == [("a", [-1, 4]), ("b", [])]
    clover = '<coverage><project><file name="n" path="p"><line num="3" count="1"/><line num="1" count="0"/><metrics loc="5"/></file><package><file name="q"><line num="1" count="2"/><line num="1" count="7"/></file></package></project></coverage>'
    assert hits(R.clover(report(spark, clover))) == [("p", [0, -1, 1, -1, -1]), ("q", [2, 7])]
    jacoco = '<report><package name="d"><sourcefile name="A.java"><line nr="2" ci="4"/></sourcefile></package><group><package name="e"><sourcefile name="B.java"><line nr="1" ci="0"/></sourcefile></package></group></report>'
    assert hits(R.jacoco(report(spark, jacoco))) == [("d/A.java", [-1, 4]), ("e/B.java", [0])]
    dot = '<Root><FileIndices><File Index="1" Name="x.cs"/><File Index="2" Name="y.cs"/></FileIndices><A><Statement FileIndex="1" Line="2" Covered="True"/><Statement FileIndex="1" Line="2" Covered="False"/><Statement FileIndex="1" Line="1" Covered="True"/></A></Root>'
    assert hits(R.dotcover(report(spark, dot))) == [("x.cs", [1, 0])]


def test_json_and_text_formats(spark):
    new = '{"meta":{"simplecov_version":"0.21.2"},"coverage":{"a.rb":{"lines":[1,null,"ignored",0]}}}'
    assert hits(R.simplecov(report(spark, new))) == [("a.rb", [1, -1, -2, 0])]
    assert hits(R.simplecov(report(spark, '{"RSpec":{"coverage":{"b.rb":[null,2]}}}'))) == [("b.rb", [-1, 2])]
    assert hits(R.simplecov(report(spark, '{"files":[{"filename":"c.rb","coverage":{"lines":[3]}}]}'))) == [("c.rb", [3])]
    assert hits(R.simplecov(report(spark, '{"x":1}'))) == []
    profile = "mode: set\na.go:1.2,3.4 1 0\na.go:2.1,2.9 1 5\nb.go:1.1,1.2 1 1\na.go:1.1,1.2 1 7\n"
    assert hits(R.coverprofile(report(spark, profile))) == [("a.go", [0, 5, 0]), ("a.go", [7]), ("b.go", [1])]
    xc = '{"z.swift":[{"line":1,"isExecutable":true,"executionCount":2},{"line":2,"isExecutable":false},{"line":3,"isExecutable":true}]}'
    assert hits(R.xccov(report(spark, xc))) == [("z.swift", [2, -1, 0])]


def test_streaming_merge(spark, tmp_path):
    from gaugeworks.streaming.coverage import read_reports, running_lines

    spark.createDataFrame([("a", [1, -1]), ("a", [2, 3])], "path string, hits array<bigint>").write.parquet(str(tmp_path / "in"))
    q = running_lines(read_reports(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("merged").start()
    q.processAllAvailable()
    rows = {(r["path"], r["pos"]): r["hit"] for r in spark.sql("SELECT * FROM merged").collect()}
    q.stop()
    assert rows == {("a", 0): 3, ("a", 1): -1}


def test_stream_cuts_to_the_shortest_as_a_batch_does(spark, tmp_path):
    from gaugeworks.streaming.coverage import merged_lines, read_reports, running_merge

    rows = [("a", [1, -1, 3]), ("a", [1, 2]), ("b", [4]), ("b", []), ("c", [0, 5])]
    reports = spark.createDataFrame(rows, "path string, hits array<bigint>")
    reports.write.parquet(str(tmp_path / "in"))
    q = running_merge(read_reports(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("cut").start()
    q.processAllAvailable()
    got = {}
    for r in merged_lines(spark.table("cut")).orderBy("path", "pos").collect():
        got.setdefault(r["path"], []).append(r["hit"])
    q.stop()
    want = {r["path"]: list(r["hits"]) for r in C.merge_reports(reports).collect()}
    assert want == {"a": [2, -1], "b": [], "c": [0, 5]} and got == {k: v for k, v in want.items() if v}


def test_lcov_of_many_lines_is_linear(spark):
    text = "SF:f\n" + "\n".join(f"DA:{i},{i % 3}" for i in range(3, 200_001, 2)) + "\nend_of_record\n"
    rows = R.lcov(spark.createDataFrame([("r", text)], "file string, content string")).collect()
    hits = rows[0]["hits"]
    assert len(hits) == 199_999 and hits[:5] == [-1, -1, 0, -1, 2] and hits[-1] == 199_999 % 3


def test_clover_numbers_given_twice_shift(spark):
    xml = '<coverage><project><file name="f" path="p/f"><line num="2" count="5"/><line num="2" count="6"/><line num="3" count="7"/><line num="9" count="8"/><metrics loc="11"/></file><file name="g"/></project></coverage>'
    rows = {r["path"]: list(r["hits"]) for r in R.clover(spark.createDataFrame([("r", xml)], "file string, content string")).collect()}
    assert rows == {"p/f": [-1, 5, 6, 7, -1, -1, -1, -1, 8, -1, -1], "g": []}
