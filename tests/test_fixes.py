"""Byte offsets, and fixes from linter output to patched files."""

import json
import random

from pyspark.sql import functions as F

from gaugeworks.operators import offsets as O
from gaugeworks.operators import patches as P
from gaugeworks.sources import fixes

TEXTS = ["", "\n", "a", "ab\ncd", "naïve ☃\n\n漢字\r\nend\n", "x\n" * 5]


def brute_bytes(text, line, column):
    rows = text.split("\n")
    if text.endswith("\n") or not text:
        rows.pop()
    if not 1 <= line <= len(rows):
        return None
    return len("".join(x + "\n" for x in rows[: line - 1]).encode()) + len(rows[line - 1][: max(0, column - 1)].encode())


def test_lines_and_columns_to_bytes_and_back(spark):
    files = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(TEXTS)] + [("none", None)], "path string, contents string")
    index = O.line_index(files)
    places = [(f"f{i}", line, column) for i in range(len(TEXTS)) for line in range(0, 8) for column in range(0, 12)]
    got = {tuple(r)[:3]: r["at"] for r in O.with_bytes(spark.createDataFrame(places, "path string, line long, column long"), index, "line", "column", "at").collect()}
    assert got == {(p, line, column): brute_bytes(TEXTS[int(p[1:])], line, column) for p, line, column in places}
    back = {}
    for i, t in enumerate(TEXTS):
        for line, row in enumerate(t.split("\n")[: t.count("\n") + (not t.endswith("\n") and t != "")], 1):
            for column in range(1, len(row) + 2):
                back[(f"f{i}", brute_bytes(t, line, column))] = (line, column)
    rows = spark.createDataFrame([*back, ("f0", 0), ("f2", 5), ("none", 0)], "path string, at long")
    found = {(r["path"], r["at"]): (r["line"], r["column"]) for r in O.with_places(rows, index, "at").collect()}
    assert found == {**back, ("f0", 0): (None, None), ("f2", 5): (None, None), ("none", 0): (None, None)}


SOURCE = "let é = 1;\nvar b = 'ö';\nfoo(a);\n\nbar();\n"


def patched(spark, tool, output):
    rows = fixes.TOOLS[tool](spark.createDataFrame([("o", json.dumps(output))], "file string, output string"))
    files = spark.createDataFrame([("s", SOURCE)], "path string, contents string")
    made = P.build_patches(rows, files)
    assert made.columns == ["file", "nth", "path", "rule_key", "id", "description", "replacements", "patch"]
    made = made.orderBy("nth").collect()
    return [P.applied(SOURCE, r["patch"]) if r["patch"] else None for r in made], made


def test_ruff_and_shellcheck(spark):
    place = lambda row, column: {"row": row, "column": column}
    edits = [{"content": "è", "location": place(1, 5), "end_location": place(1, 6)}, {"content": '"', "location": place(2, 9), "end_location": place(2, 10)}, {"content": '"', "location": place(2, 11), "end_location": place(2, 12)}]
    output = [{"code": "Q1", "filename": "s", "fix": {"edits": edits}}, {"code": None, "filename": "s", "fix": None}, {"code": "X", "filename": "s", "fix": {"edits": [{"content": "", "location": place(9, 1), "end_location": place(9, 2)}]}}]
    got, rows = patched(spark, "ruff", output)
    assert got == ["let è = 1;\nvar b = \"ö\";\nfoo(a);\n\nbar();\n", None] and [r["rule_key"] for r in rows] == ["Q1", "X"]
    fix = {"replacements": [{"line": 2, "column": 1, "endLine": 2, "endColumn": 4, "replacement": "const", "precedence": 1, "insertionPoint": "beforeStart"}]}
    got, _ = patched(spark, "shellcheck", [{"file": "s", "code": 1, "fix": fix}, {"file": "s", "code": 2, "fix": None}])
    assert got == [SOURCE.replace("var", "const")]


def test_eslint_counts_characters_of_its_source(spark):
    at = SOURCE.index("'ö'")
    fix = {"range": [at, at + 3], "text": "`ö`"}
    message = {"ruleId": "quotes", "line": 2, "column": 9, "endLine": 2, "endColumn": 12, "fix": fix}
    got, rows = patched(spark, "eslint", [{"filePath": "s", "source": SOURCE, "messages": [message, {"ruleId": None, "suggestions": [{"messageId": "m1", "desc": "d1", "fix": {"range": [0, 3], "text": "const"}}, {"messageId": "m2", "desc": "d2", "fix": {"range": [0, 0], "text": "// "}}]}, {"ruleId": "none"}]}])
    assert got == [SOURCE.replace("'ö'", "`ö`"), SOURCE.replace("let", "const"), "// " + SOURCE]
    assert [(r["id"], r["description"], r["rule_key"]) for r in rows] == [("fix", "fix", "quotes"), ("m1", "d1", ""), ("m2", "d2", "")]
    r = rows[0]["replacements"][0]
    assert SOURCE.encode()[r["start_byte"] : r["end_byte"]].decode() == "'ö'" and (r["start_line"], r["start_column"], r["end_column"]) == (2, 9, 12)
    _, bare = patched(spark, "eslint", [{"filePath": "s", "messages": [message]}])
    assert bare[0]["replacements"][0]["start_byte"] == at  # no source: taken as bytes


def delta(before, after, lines_off, rng):
    """A delta as the tool writes it: pieces of both texts in one dictionary, runs of equal lines left out."""
    import difflib

    words, ops, a, b = "", [], before.splitlines(True), after.splitlines(True)

    def put(kind, text):
        nonlocal words
        at = len(words.encode())
        words += text
        ops.append({"diffOp": {kind: {"range": [at, len(words.encode())]}}})

    for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "equal" and j - i > 1 and rng.random() < lines_off:
            ops.append({"equalLines": {"line_count": j - i - 1}})
        elif tag == "equal":
            put("equal", "".join(a[i:j]))
        else:
            if i < j:
                put("delete", "".join(a[i:j]))
            if k < m:
                put("insert", "".join(b[k:m]))
    return {"dictionary": words, "ops": ops}


def test_biome_deltas(spark):
    rng, cases = random.Random(3), []
    for _ in range(60):
        rows = [rng.choice(["é\n", "x\n", "\n", "long line\n"]) for _ in range(rng.randrange(1, 12))]
        new = [rng.choice([x, x, x, "ß\n", ""]) for x in rows]
        cases.append(("".join(rows) + "end\n", "".join(new) + "end\n"))
    diagnostics = [{"category": "c", "severity": "error", "description": "d", "location": {"path": {"file": f"f{i}"}, "span": [0, 1], "sourceCode": a}, "advices": {"advices": [{"log": []}, {"diff": delta(a, b, 0.6, rng)}]}} for i, (a, b) in enumerate(cases)]
    out = spark.createDataFrame([("o", json.dumps({"diagnostics": diagnostics}))], "file string, output string")
    files = spark.createDataFrame([(f"f{i}", a) for i, (a, _) in enumerate(cases)], "path string, contents string")
    got = {r["path"]: r["after"] for r in P.modified(fixes.biome_fixes(out), files).collect()}
    assert got == {f"f{i}": b for i, (a, b) in enumerate(cases) if a != b}


ENUM = "const foobar = () => { }\nconst barfoo = () => { }\n\nenum Bar { Baz };\n\nconst foo = (bar: Bar) => {\n  switch (bar) {\n    case Bar.Baz:\n      foobar();\n      barfoo();\n      break;\n  }\n  { !foo ? null : 1 }\n}\n\nenum Foo { Bae };\n"


def test_biome_issues_and_places(spark):
    eq = lambda a, b: {"diffOp": {"equal": {"range": [a, b]}}}
    ops = [eq(0, 50), {"equalLines": {"line_count": 10}}, eq(50, 64), eq(64, 68), {"diffOp": {"insert": {"range": [68, 72]}}}, eq(72, 75)]
    words = "const foobar = () => { }\nconst barfoo = () => { }\n}\n\nenum Foo { Bae = 0 };\n"
    where = {"path": {"file": "b.ts"}, "span": [212, 215], "sourceCode": ENUM}
    rows = [{"category": "lint/x", "severity": "error", "description": "d", "location": where, "advices": {"advices": [{"diff": {"dictionary": words, "ops": ops}}]}}, {"category": "y", "severity": "information", "description": "e", "location": {"path": {"file": "c"}, "span": None, "sourceCode": None}}, {"category": "z", "severity": "warning", "description": "e", "location": {"path": {"file": "c"}, "span": [0, 999], "sourceCode": "é\n"}}]
    out = spark.createDataFrame([("o", json.dumps({"diagnostics": rows}))], "file string, output string")
    got = [tuple(r)[1:] for r in fixes.biome(out).collect()]
    assert got == [("b.ts", "lint/x", "d", 50, "CATEGORY_LINT", 16, 6, 16, 9), ("c", "y", "e", 40, "CATEGORY_LINT", None, None, None, None), ("c", "z", "e", 40, "CATEGORY_LINT", 1, 1, 0, 0)]
    fix = fixes.biome_fixes(out).collect()
    assert len(fix) == 1 and fix[0]["path"] == "b.ts"
    made = P.modified(fixes.biome_fixes(out), spark.createDataFrame([("b.ts", ENUM)], "path string, contents string")).select(F.col("after")).first()[0]
    assert made == ENUM.replace("Bae }", "Bae = 0 }")


def test_no_outputs(spark):
    none = spark.createDataFrame([], "file string, output string")
    assert all(f(none).count() == 0 for f in fixes.TOOLS.values())
