"""Patterns matched in the pass that parses a file, against the joins on node tables; stats that move no other nodes."""

import random

import pytest

from gaugeworks.operators import matching, stats, trees
from gaugeworks.operators import patterns as P
from gaugeworks.plans import metric_queries as Q
from gaugeworks.sources.trees import nodes
from tests.test_patterns import CODE, FILES, PATTERNS, rows_of
from tests.test_stats import CODE as MORE

SHAPES = [
    *PATTERNS, *Q.SHAPES, *Q.IMPORTS, "(_) @all", "(FunctionDef . (_) @first)", "(_ (_) @last .)", "[(If) (Return (Constant) @k)] @any", "(Module) @m", "((Module) @m)",
    '((ClassDef (FunctionDef name: (identifier) @n (#match? @n "^(?:test|help)[_e]")) . (_) @then))', '((Return) @r (#match? @r "\\\\bna.ve\\"$"))', '(FunctionDef name: (identifier) @n (#not-eq? @n "helper")) @f',
]


def plain(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("limit", [None, 2])
def test_sources_equal_node_tables(spark, limit):
    dice = random.Random(8)
    lines = ["import a", "x = f(1)", "x", "from b import c", "def g(a):\n    x\n    import a\n    x = f(2)\n    return x", "class C:\n    def m(self):\n        if self.y or q:\n            return 'z'\n        x"]
    files = FILES + [(f"r{k}", "\n".join(dice.choice(lines) for _ in range(8))) for k in range(5)] + [("n", None), ("s.py", MORE)]
    df, _, table = rows_of(spark, files)
    got = P.source_captures(df, SHAPES, limit)
    assert got.columns == P.captures(table, SHAPES).columns
    assert plain(got.collect()) == plain(P.captures(table, SHAPES, limit).collect())
    assert 0 < len(P.split(SHAPES)[1]) < 3  # those that Java and Python may read differently go by the joins
    without = P.source_captures(df, SHAPES[:1], limit, texts=False).collect()
    assert without and all(r["text"] is None for r in without) and P.source_captures(df, []).count() == 0


def test_which_expressions_are_plain():
    for test, same in [("^test_", True), ("^f[0-9]+", True), ("a|(?:b_c)*", True), ("[^a-z]", True), ("\\d", False), ("a$", False), ("a.b", False), ("(?i)a", False), ("[a&&b]", False), ("a{2}", False), ("é", False), ("a*+", False)]:
        assert matching.plain([("#match?", "x", [test])]) == same, test


def test_matching_moves_no_nodes(spark, monkeypatch):
    made = []
    for module in (P, stats):
        monkeypatch.setattr(module, "stored", lambda df, name, keep=module.stored: made.append((name, df)) or keep(df, name))
    files = spark.createDataFrame([("a.py", MORE + "\ndef test_it():\n    assert free()\n"), ("b.py", CODE)], "path string, contents string")
    assert "Exchange" not in P.source_captures(files, Q.SHAPES)._jdf.queryExecution().executedPlan().toString() and not made
    assert stats.file_stats(files, Q.TESTS).count() == 2 and [n for n, _ in made] == ["stats-nodes"]
    assert "Exchange" not in made[0][1]._jdf.queryExecution().executedPlan().toString()
    kept = made[0][1].where("kind IS NOT NULL").count()
    assert kept < nodes(files, "python").count() / 2
    made.clear()
    assert stats.function_stats(files, Q.TESTS).count() == 5 and [n for n, _ in made] == ["stats-nodes", "stats-inside"]


def test_expressions_that_go_by_joins_exclude_the_same(spark):
    code = MORE + "\ndef test_it():\n    # why\n    assert free()\n    return '''a\nb'''\n"
    files = spark.createDataFrame([("a.py", code), ("a.py", "def test_a():\n    pass\n"), (None, MORE), ("b.py", "def ("), ("c.py", None), ("d.py", "")], "path string, contents string")
    dotted = [Q.TESTS[0].replace("^test_", "^test.")]
    assert P.split(dotted) == ([], [0])
    for of in (stats.file_stats, stats.function_stats, stats.names):
        assert plain(of(files, dotted).collect()) == plain(of(files, Q.TESTS).collect()) != plain(of(files).collect())


def test_names_are_those_of_the_stats(spark):
    files = spark.createDataFrame([("a.py", MORE), ("a.py", MORE), (None, CODE), ("b.py", "def ("), ("c.py", None), ("d.py", "")], "path string, contents string")
    rows = stats.file_stats(files).selectExpr("kind", "fully_qualified_name", "path", "cast(null as int) AS start_line")
    rows = rows.unionByName(stats.function_stats(files).select("kind", "fully_qualified_name", "path", "start_line"))
    assert plain(stats.names(files).collect()) == plain(rows.collect())
    assert "Exchange" not in stats.names(files)._jdf.queryExecution().executedPlan().toString()


def test_metrics_of_kept_nodes_equal_those_of_all(spark):
    df, table, _ = rows_of(spark, [(str(k), text) for k, text in enumerate((MORE, CODE, Q.CLASS))])
    got = {r["path"]: r for r in stats.file_stats(df).collect()}
    for part in (trees.counts(table), trees.cyclomatic(table), trees.cognitive(table), trees.lcom4(table)):
        for r in part.collect():
            assert all(got[r["path"]][c] == r[c] for c in part.columns), r
