import re

from gaugeworks.operators import coverage
from gaugeworks.plans import coverage_queries
from gaugeworks.sources import coverage_formats as formats
from pyspark.sql import functions as F

PROFILE = "mode: set\na.go:1.2,3.4 2 0\na.go:2.1,2.9 1 5\nbroken\nb.go:2.1,2.5 1 1\na.go:1.1,1.2 1 7\na.go:1.1,2.2 1 3\n"
LCOV = "TN:\nSF:a\nDA:3,1\nDA:1,2\nDA:3,4\nDA:0,9\nend_of_record\nSF:none\nend_of_record\nSF:b\nDA:2,0,sum\nDA:2\nend_of_record\n"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_coverprofile_folds_a_record_in_its_row(spark):
    out = formats.coverprofile(spark.createDataFrame([("x", PROFILE), ("y", "mode: set")], "file string, content string"))
    assert sorted((r["path"], r["hits"]) for r in out.collect()) == [("a.go", [0, 5, 0]), ("a.go", [7, 3]), ("b.go", [-1, 1])]
    assert "Exchange" not in plan(out) and "Window" not in plan(out)


def test_lcov_folds_a_record_in_its_row(spark):
    out = formats.lcov(spark.createDataFrame([("x", LCOV)], "file string, content string"))
    assert sorted((r["path"], r["hits"]) for r in out.collect()) == [("a", [2, -1, 5]), ("b", [-1, 0]), ("none", [])]
    assert "Exchange" not in plan(out)


def test_lcov_reports_grow_in_number(spark):
    rows = spark.range(5000).selectExpr("id AS l_partkey", "'O' AS l_linestatus", "id AS l_orderkey", "1 AS l_linenumber", "id AS l_suppkey", "1.0 AS l_extendedprice", "current_date() AS l_shipdate", "'N' AS l_returnflag", "2 AS l_quantity")
    one, four = (coverage_queries.lcov_text(lambda _, n=n: rows.where(F.col("l_partkey") < n)) for n in (1250, 5000))
    assert one.count() == 1 and four.count() == 4
    assert four.where("length(content) > 60000").count() == 0


def test_ci_prefixes_take_one_pass(spark):
    paths = ["/home/runner/work/a/b/home/travis/build/c/d/x", "C:\\github.com\\a\\x", "home/circleci/project/x", "a/home/circleci/project/x", "/Users/u/workspace/a/b/x", "/Users/distiller/q/x", "github.com/a/github.com/b/x"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").withColumn("fixed", coverage.fix_path(F.col("path")))

    def first(path):
        path = re.sub("^.:/", "", path.replace("\\", "/"))
        return next((re.sub(p, "", path) for p in coverage.CI_PREFIXES if re.search(p, path)), path)

    assert [r["fixed"] for r in df.collect()] == [first(p) for p in paths] and first(paths[0]) == "home/travis/build/c/d/x"
    assert plan(df).count("regexp_replace") + plan(df).lower().count("rlike") <= 2
