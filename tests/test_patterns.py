"""Patterns against brute force over embeddings, and exclusion against pairs of ranges."""

import ast
import itertools
import random

import pytest

from gaugeworks.operators import patterns as P
from gaugeworks.operators import trees
from gaugeworks.sources.trees import NODES, nodes

CODE = '''
import os
import sys, re
from a import b

class TestCase:
    def test_one(self):
        import os
        return check(1)

    def helper(self):
        if ready:
            return 1
        elif other:
            raise ValueError("é no")
        return "naïve"

def test_two():
    pass

async def test_three(x):
    a = require("x")
    b = require("y")
    return a
'''
PATTERNS = [
    "(import_statement _) @i",
    '((function_definition name: (identifier) @name) @f (#match? @name "^test_"))',
    '(ClassDef name: (identifier) @c body: (FunctionDef name: (identifier) @m (#not-match? @m "^test")))',
    "((Import) . (Import) @second)",
    "((Import) @a (ImportFrom) @b)",
    "(FunctionDef body: [(Return) (If)] @step)",
    '(Assign (Name) @target value: (Call func: (Name) @f args: (Constant)) (#eq? @f "require")) @whole',
    "(FunctionDef . (arguments) (Return) @last .)",
    '(Call func: (Name) @f (#any-of? @f "check" "require"))',
    "(_ test: (_) @t)",
    '(Return (Constant) @c (#eq? @c "\\"naïve\\""))',
    "(Nothing) @x",
]


def rows_of(spark, files):
    df = spark.createDataFrame(files, "path string, contents string")
    table = nodes(df, "python").cache()
    return df, table, P.pattern_nodes(table, df).cache()


def brute(rows, pattern):
    """All embeddings, one by one, over plain rows."""
    part, predicates = P.read(pattern)
    kids = {}
    for r in rows:
        kids.setdefault((r["path"], r["parent"]), []).append(r)
    for v in kids.values():
        v.sort(key=lambda r: r["position"])

    def fits(p, r):
        if p.kinds is not None and r["kind"] not in p.kinds or p.field is not None and r["field"] != p.field:
            return
        if p.options:
            for o in p.options:
                for found in fits(o, r):
                    yield found + [(c, r) for c in p.captures]
            return
        for found in rest(p, r):
            yield found + [(c, r) for c in p.captures]

    def rest(p, r):
        if not p.children:
            yield []
            return
        own = kids.get((r["path"], r["enter"]), [])
        real = [x["position"] for x in own if x["position"] >= 0]
        for chosen in itertools.combinations(own, len(p.children)):
            at = [x["position"] for x in chosen]
            if any(c.near and (at[k] != at[k - 1] + 1 if k else at[0] != min(real)) for k, c in enumerate(p.children)) or p.end and at[-1] != max(real):
                continue
            for parts in itertools.product(*[list(fits(c, x)) for c, x in zip(p.children, chosen)]):
                yield [y for part in parts for y in part]

    def true(found):
        for test, capture, literals in predicates:
            for c, r in found:
                if c == capture:
                    import re

                    held = bool(re.search(literals[0], r["text"] or "")) if test.endswith("match?") else (r["text"] or "") in literals
                    if held == ("not-" in test):
                        return False
        return True

    out = set()
    for r in rows:
        for found in rest(part, r) if part.group else fits(part, r):
            if true(found):
                out |= {(r["path"], r["enter"], c, x["enter"], x["text"]) for c, x in found}
    return out


FILES = [("a.py", CODE), ("b.py", CODE.replace("test_", "check_")), (None, "import os\nimport re\n"), ("c.py", "def ("), ("d.py", "")]


def test_captures_equal_all_embeddings(spark):
    _, _, table = rows_of(spark, FILES)
    rows = table.collect()
    got = P.captures(table, PATTERNS).collect()
    for k, pattern in enumerate(PATTERNS):
        own = {(r["path"], r["match"], r["capture"], r["enter"], r["text"]) for r in got if r["pattern"] == k}
        assert own == brute(rows, pattern), pattern
        assert own or pattern == "(Nothing) @x", pattern


def test_random_trees(spark):
    rng = random.Random(5)
    files = [(f"f{i}", "\n".join(rng.choice(["import a", "x = f(1)", "x", "from b import c", "def g(a):\n    x\n    import a\n    x = f(2)\n    return x"]) for _ in range(9))) for i in range(6)]
    _, _, table = rows_of(spark, files)
    rows = table.collect()
    shapes = ["((Expr) . (Import) @i (Assign) @a)", "((Import) @i (Expr) @e . (Assign))", "(FunctionDef (arguments) @p . (_) @n (Return) @r .)", "(_ (Assign) @a . (_) @next)", "((Expr) @one (Expr) @two (Expr) @three)"]
    got = P.captures(table, shapes).collect()
    for k, pattern in enumerate(shapes):
        assert {(r["path"], r["match"], r["capture"], r["enter"], r["text"]) for r in got if r["pattern"] == k} == brute(rows, pattern), pattern


def test_limit_keeps_the_first_matches_of_a_file(spark):
    _, _, table = rows_of(spark, [("a", "import a\n" * 9), ("b", "import b\n")])
    got = P.captures(table, ["(Import) @i", "(alias) @x"], limit=4).groupBy("path", "pattern").count().collect()
    assert {(r["path"], r["pattern"]): r["count"] for r in got} == {("a", 0): 4, ("b", 0): 1, ("a", 1): 4, ("b", 1): 1}


@pytest.mark.parametrize("bad", ["(a", "a)", "(a (#eq? @x @y))", "(a ((b)))", "(a) (b)", '(a (#what? @x "y"))', "(a (#eq? @x \"y\" \"z\"))", "()"])
def test_unreadable_patterns_are_errors(bad):
    with pytest.raises(P.PatternError):
        P.read(bad)


def test_exclusion_equals_comparing_all_ranges(spark):
    df, table, pattern_table = rows_of(spark, FILES)
    ranges = P.all_captured(pattern_table, ['((function_definition name: (identifier) @n) (#match? @n "^test_"))', "(import_statement _)"]).collect()
    assert ranges
    extra = [(r["path"], r["start_byte"], r["end_byte"]) for r in ranges] + [("a.py", 0, 30), ("a.py", 20, 60), ("zz", 0, 9**6)]
    kept = P.exclude(table, spark.createDataFrame(extra, "path string, start_byte int, end_byte int")).collect()
    want = {(r["path"], r["enter"]) for r in table.collect() if not any(p == r["path"] and a <= r["start_byte"] and r["end_byte"] <= b for p, a, b in extra)}
    assert {(r["path"], r["enter"]) for r in kept} == want and kept[0].__fields__ == [c.split()[0] for c in NODES.split(", ")]
    assert "BroadcastNestedLoopJoin" not in P.exclude(table, spark.createDataFrame(extra, "path string, start_byte int, end_byte int"))._jdf.queryExecution().toString()
    assert P.exclude(table, spark.createDataFrame([], "path string, start_byte int, end_byte int")).count() == table.count()
    before, after = (trees.counts(x).where("path = 'a.py'").first() for x in (table, P.exclude(table, spark.createDataFrame(extra[: len(ranges)], "path string, start_byte int, end_byte int"))))
    assert before["functions"] == 4 and after["functions"] == 1


def test_bytes_are_those_of_the_source(spark):
    code = "x = 'é' + y\r\nif x:\r\n    ☃ = 'naïve'\n"
    with pytest.raises(SyntaxError):
        ast.parse(code)
    code = code.replace("☃", "ß")
    _, _, table = rows_of(spark, [("a", code)])
    text = {(r["kind"], r["text"]) for r in table.collect()}
    assert {("Constant", "'é'"), ("Name", "y"), ("Constant", "'naïve'"), ("Name", "ß"), ("If", "if x:\r\n    ß = 'naïve'"), ("Module", code)} <= text
