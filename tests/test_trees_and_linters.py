"""Golden cases for trees, linter formats, scalar functions and exports."""

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import text as X
from gaugeworks.operators import issues as I
from gaugeworks.operators import sinks, trees
from gaugeworks.sources import linters
from gaugeworks.sources.trees import nodes

CODE = """
class A:
    def __init__(self):
        self.x = 1
    def a(self):
        return self.x
    def b(self):
        return self.x and self.y
    def c(self, k):
        for i in k:
            if i > 1:
                break
            elif i:
                pass
        return self.other()
    def other(self):
        return self.z
    def alone(self):
        return 3
"""


def table(spark, code=CODE, lang="python"):
    return nodes(spark.createDataFrame([("f", code)], "path string, contents string"), lang)


def test_python_metrics(spark):
    t = table(spark).cache()
    assert trees.counts(t).first()[1:] == (1, 6, 3)  # other is called, so no field
    assert trees.lcom4(t).first()["lcom4"] == 2
    assert trees.cyclomatic(t).first()["cyclomatic"] == 1 + 1 + 1 + 1 + 1
    assert trees.cognitive(t).first()["complexity"] == 1 + 1 + 2 + 1 + 1  # and, for, if in it, break, elif
    assert trees.control_depth(t).first()["depth"] == 2
    assert {r["name"]: r["n"] for r in trees.parameters(t).collect()}["c"] == 1


COMPLEX = """
def walk(x, y):
    if x and y and x or y:
        for i in x:
            walk(i, y)
    elif y:
        x = [a for a in y]
    else:
        if x:
            other(x)
    while x:
        break
    else:
        y = any(x)
    def inner(z):
        if z or x:
            inner(z)
        return map(z, x)
    return lambda q: q if q else x
"""
DECORATOR = """
def make(f):
    def call(x):
        if x:
            return f(x)
    return call
"""


def test_complexity_counts_all_parts(spark):
    t = table(spark, COMPLEX).cache()
    # if 1, and 1, or 1, for 2, walk 1, elif 1, else 1, if in else 2, while 1, break 1, else 1, if in inner 2, inner 1, ternary in lambda 2
    assert trees.cognitive(t).first()["complexity"] == 18
    # 1, if, 3 operators, for, elif, if, while, any, if, or, map, ternary
    assert trees.cyclomatic(t).first()["cyclomatic"] == 14
    raised = {r["rule_key"]: r["value"] for r in trees.structure_issues(t).collect()}
    assert raised["function-complexity"] == 18 and "file-complexity" not in raised
    inner = trees.structure_issues(t, {"function-complexity": 3}).where("rule_key = 'function-complexity'").collect()
    assert sorted(r["value"] for r in inner) == [3, 18]
    assert trees.cognitive(table(spark, DECORATOR)).first()["complexity"] == 1
    assert trees.cognitive(table(spark, DECORATOR.replace("return call", "x = 1; return call"))).first()["complexity"] == 2


def test_bad_source_gives_no_rows(spark):
    assert table(spark, "def (").count() == 0
    assert table(spark, "<p>a<b>c</p></i>", "html").where("kind = 'b'").count() == 1


def test_structural_digest(spark):
    one = spark.range(1).select(X.node_digest(F.lit("k"), F.array(F.md5(F.lit("a").cast("binary")))).alias("d")).first()["d"]
    import hashlib

    assert one == hashlib.md5(b"k" + hashlib.md5(b"a").digest()).hexdigest()


def test_duplication_prunes_inner_nodes(spark):
    body = "<div><ul><li><a>x</a></li><li><a>y</a></li></ul></div>"
    t = nodes(spark.createDataFrame([("p", body), ("q", body), ("r", "<p>z</p>")], "path string, contents string"), "html")
    rows = trees.with_other_locations(trees.duplicates(t, min_mass=3, min_lines=1)).collect()
    assert sorted((r["path"], r["n"], len(r["other_locations"])) for r in rows) == [("p", 2, 1), ("q", 2, 1)]
    assert {r["rule_key"] for r in rows} == {"identical-code"}


def test_duplicate_functions_against_brute_force(spark, sf):
    from collections import defaultdict

    from gaugeworks.plans import registry
    from gaugeworks.plans.tree_queries import modules

    t = nodes(modules(lambda name: spark.read.parquet(f"{sf}/{name}.parquet")), "python").collect()
    groups = defaultdict(list)
    for r in t:
        if r["mass"] >= 64:
            groups[r["structural_hash"]].append(r)
    groups = {h: g for h, g in groups.items() if len(g) > 1}
    grouped = defaultdict(list)
    for r in (r for g in groups.values() for r in g):
        grouped[r["path"]].append(r)
    inner = {a["structural_hash"] for rows in grouped.values() for a in rows for b in rows if b["enter"] < a["enter"] and a["leave"] < b["leave"]}
    want = []
    for h in groups.keys() - inner:
        kind = "identical-code" if len({r["source_hash"] for r in groups[h]}) == 1 else "similar-code"
        want += [(r["path"], r["start_line"], r["end_line"], kind, len(groups[h]), r["mass"]) for r in groups[h] if r["end_line"] - r["start_line"] + 1 >= 15]
    got = registry()["d07_duplicate_functions"].run(spark, sf).collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(want)
    assert inner and {r["start_line"] for r in got} - {1} and max(r["n"] for r in got) > 2


OUTPUTS = {
    "actionlint": ('[{"message":"m","filepath":"w.yml","line":2,"column":3,"kind":"k","end_column":9}]', ("w.yml", "k", 40, 2)),
    "ast_grep": ('[{"file":"a","ruleId":"r","severity":"hint","message":"","range":{"start":{"line":0,"column":1},"end":{"line":2,"column":3}}}]', ("a", "r", 30, 1)),
    "coffeelint": ('{"a.coffee":[{"level":"warn","message":"m","lineNumber":4,"rule":"x"}]}', ("a.coffee", "x", 40, 4)),
    "golangci_lint": ('{"Issues":[{"FromLinter":"l","Text":"t","Severity":"","Pos":{"Filename":"m.go","Line":7,"Column":1}}]}', ("m.go", "l", 40, 7)),
    "haml_lint": ('{"files":[{"path":"a.haml","offenses":[{"severity":"error","message":"m","location":{"line":3},"linter_name":"L"}]}]}', ("a.haml", "L", 50, 3)),
    "markdownlint": ('[{"fileName":"a.md","ruleDescription":"d","ruleInformation":"u","ruleNames":["MD1","x"]}]', ("a.md", "MD1", 40, 1)),
    "php_codesniffer": ('{"files":{"a.php":{"messages":[{"message":"m","source":"s","type":"ERROR","line":5,"column":1}]}}}', ("a.php", "s", 50, 5)),
    "phpstan": ('{"files":{"b.php":{"messages":[{"message":"m","line":6,"identifier":"i","tip":"see https://x.y/z now"}]}}}', ("b.php", "i", 40, 6)),
    "radarlint": ('{"severity":"CRITICAL","ruleKey":"java:S1","primaryMessage":"m","fileUri":"A.java"}', ("A.java", "java.S1", 50, 0)),
    "rubocop": ('{"files":[{"path":"a.rb","offenses":[{"severity":"error","message":"m","cop_name":"Layout/X","location":{"start_line":1,"start_column":1,"last_line":2,"last_column":2}}]}]}', ("a.rb", "Layout/X", 50, 1)),
    "shellcheck": ('[{"file":"a.sh","line":1,"endLine":2,"column":3,"endColumn":4,"level":"style","code":2086,"message":"m"}]', ("a.sh", "2086", 30, 1)),
    "sqlfluff": ('[{"filepath":"a.sql","violations":[{"name":"n","code":"c","description":"d","warning":true,"start_line_no":3,"start_line_pos":1}]}]', ("a.sql", "n", 30, 3)),
    "terraform": ('{"diagnostics":[{"severity":"error","summary":"s","range":{"filename":"m.tf","start":{"line":1,"column":1},"end":{"line":1,"column":2}}}]}', ("m.tf", None, 50, 1)),
    "trufflehog": ('{"SourceMetadata":{"Data":{"Filesystem":{"file":"k","line":4}}},"DetectorName":"AWS","Redacted":"A"}', ("k", "AWS", 50, 5)),
    "editorconfig_checker": ('[{"description":"Trailing whitespace","severity":"x","location":{"path":"e","lines":{"begin":2,"end":3}}}]', ("e", "trim_trailing_whitespace", 40, 2)),
}


@pytest.mark.parametrize("name", OUTPUTS)
def test_linter_output(name, spark):
    text, want = OUTPUTS[name]
    rows = linters.parse(spark.createDataFrame([("f", text)], "file string, output string"), name).collect()
    assert [(r["path"], r["rule_key"], r["level"], r["start_line"]) for r in rows] == [want]


def test_empty_and_malformed_output(spark):
    out = lambda text: spark.createDataFrame([("f", text)], "file string, output string")
    assert linters.parse(out('{"files":[]}'), "phpstan").count() == 0
    assert linters.parse(out(""), "taplo").count() == 0 and linters.parse(out("oops"), "markdownlint").count() == 0
    with pytest.raises(Exception, match="(?i)malformed"):
        linters.parse(out("{"), "ruff").collect()
    with pytest.raises(Exception, match="no such rule"):
        linters.sarif(out('{"runs":[{"results":[{"ruleId":"X","message":{"text":"m"}}]}]}')).collect()


def test_added_line_ranges(spark):
    issues = spark.createDataFrame([("a", 1, 3), ("a", 60, 70), ("a", 5, 2), ("b", 1, 1), (None, 1, 1), ("a", None, None), ("a", 128, 128), ("a", 1, 500)], "path string, start_line bigint, end_line bigint")
    added = spark.createDataFrame([("a", 3), ("a", 65), ("a", 129)], "path string, line bigint")
    got = {(r["path"], r["start_line"]): r["on_added_line"] for r in I.mark_added(issues.where("end_line IS NULL OR end_line < 500"), added).collect()}
    assert got == {("a", 1): True, ("a", 60): True, ("a", 5): False, ("b", 1): False, (None, 1): True, ("a", None): True, ("a", 128): False}
    assert I.mark_added(issues.where("end_line = 500"), added).first()["on_added_line"]


def test_limits(spark):
    issues = spark.createDataFrame([("t", i) for i in range(12)], "tool string, level bigint")
    assert I.enforce_limit(issues, 12).count() == 12
    with pytest.raises(ValueError, match="t: 12"):
        I.enforce_limit(issues, 11)


def test_scalars(spark):
    row = spark.range(1).select(X.byte_offset(F.lit("é\nab"), F.lit(2), F.lit(2)).alias("o"), X.timestamp_of(F.lit("86400")).alias("t"), X.keyed_digest(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))).alias("k")).first()
    import hashlib

    assert row["o"] == 4 and row["t"].day == 2 and row["k"] == hashlib.md5(b"a1b2").hexdigest()


def test_exports(spark, tmp_path):
    rows = spark.range(5).selectExpr("id", "'x' AS message")
    sinks.write_report({"issues": rows, "messages": rows}, {"a": 1}, str(tmp_path), compress=True)
    assert spark.read.json(str(tmp_path / "issues")).count() == 5
    assert spark.read.text(str(tmp_path / "metadata")).first()["value"] == '{"a": 1}'
