"""Manifests, report rewriting and requested paths on edge cases."""

import json

from pyspark.sql import functions as F

from gaugeworks.operators import issues as I
from gaugeworks.operators import paths as P
from gaugeworks.sources import manifests as M


def test_manifests_of_all_sorts(spark):
    lock = {"packages": {"": {"version": "0"}, "node_modules/@a/b": {"version": "1.0.0"}, "node_modules/@a/b/node_modules/c": {"version": "2.0.0"}, "node_modules/d": {"link": True}}}
    gems = "GEM\n  remote: x\n  specs:\n    rubocop (1.2.3)\n      ast (>= 2)\n    ast (2.4.0)\n\nPLATFORMS\n  ruby\n"
    files = [("package.json", json.dumps({"dependencies": {"a": "^1"}, "devDependencies": {"b": "*"}, "other": {"c": "1"}})), ("x/package.json", "[1]"), ("y/package.json", None), ("z/package.json", "no json"), ("q/my-package.json", '{"dependencies":{"z":"1"}}'), ("package-lock.json", json.dumps(lock)), ("Gemfile.lock", gems)]
    df = spark.createDataFrame(files, "path string, contents string")
    assert sorted(tuple(r) for r in M.node_dependencies(df).collect()) == [("package.json", "dependencies", "a", "^1"), ("package.json", "devDependencies", "b", "*")]
    assert sorted(tuple(r)[1:] for r in M.node_locked(df).collect()) == [("@a/b", "1.0.0", False), ("c", "2.0.0", True)]
    assert sorted(tuple(r)[1:] for r in M.gems_locked(df).collect()) == [("ast", "2.4.0"), ("rubocop", "1.2.3")]
    assert [x[0] for x in df.select(M.folder(F.col("path"))).collect()] == ["", "x", "y", "z", "q", "", ""]
    filters = spark.createDataFrame([("a", "a"), ("p", "a"), ("p", "zz")], "plugin string, filter string")
    assert [tuple(r) for r in M.plugin_packages(M.node_dependencies(df), filters).collect()] == [("package.json", "p", "a")]


def test_relative_paths_with_and_without_nested_columns(spark):
    df = spark.createDataFrame([("/r/a", "/r/a", [("/r/b", 1)], [("s", [("/rr/c", "x"), ("/r/d", "y")])]), (None, None, None, None)], "path string, fully_qualified_name string, other_locations array<struct<path:string,line:int>>, suggestions array<struct<id:string,replacements:array<struct<path:string,data:string>>>>")
    rows = I.relative_paths(df, "/r/").collect()
    assert rows[0]["path"] == rows[0]["fully_qualified_name"] == "a" and rows[0]["other_locations"][0]["path"] == "b"
    assert [x["path"] for x in rows[0]["suggestions"][0]["replacements"]] == ["/rr/c", "d"] and tuple(rows[1]) == (None,) * 4
    assert I.relative_paths(df.select("path"), "/r").columns == ["path"]


def test_requested_paths(spark):
    df = spark.createDataFrame([("a/b.py",), ("ab/c.py",), ("x.py",), (None,)], "path string")
    assert [r[0] for r in P.requested(df, []).collect()] == ["a/b.py", "ab/c.py", "x.py"]
    assert [r[0] for r in P.requested(df, ["a", "x.py"]).collect()] == ["a/b.py", "x.py"]
    assert [r[0] for r in P.analysed(spark.createDataFrame([("a/vendor/x",), ("vendor.py",), ("a/x.min.js",)], "path string")).collect()] == ["vendor.py"]


def test_queries_are_listed_without_a_session():
    import os
    import subprocess
    import sys

    code = "import sys; sys.path.insert(0, '.'); from gaugeworks.plans import registry; print(len(registry()))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).stdout) > 150


def test_groups_of_duplicates(spark):
    df = spark.createDataFrame([("b", 1, 2, "h"), ("a", 5, 6, "h"), ("c", 1, 1, None)], "path string, start_line int, end_line int, structural_hash string")
    assert [(r["structural_hash"], r["n"], r["first"]["path"]) for r in I.by_structure(df).collect()] == [("h", 2, "a")]
