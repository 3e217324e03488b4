"""Stats rows of files and functions."""

from gaugeworks.operators import stats as S

CODE = '''# head
class A:
    """Doc

    string"""

    def m(self, k):
        # why
        if k:  # trailing
            return self.x
        return self.y

    def s(k):
        return k


def free():
    def inner():

        return 1
    return inner
'''


def test_line_kinds():
    assert S.line_kinds(CODE) == ["comment", "code", "code", "code", "code", "blank", "code", "comment", "code", "code", "code", "blank", "code", "code", "blank", "blank", "code", "code", "blank", "code", "code"]
    assert S.line_kinds("") == [] and S.line_kinds("x = 1\n\x0cy = 2\n") == ["code", "code"] and S.line_kinds("x = (\n# c\n\n") == ["code", "comment", "blank"]


def test_stats(spark):
    files = spark.createDataFrame([("a.py", CODE), ("b.py", "def ("), ("c.py", None), ("d.py", "")], "path string, contents string")
    got = {r["path"]: r for r in S.stats_order(S.file_stats(files)).collect()}
    assert sorted(got) == ["a.py", "b.py", "d.py"]
    a = got["a.py"]
    assert (a["classes"], a["functions"], a["fields"], a["cyclomatic"], a["complexity"], a["lcom4"]) == (1, 4, 2, 2, 1, 1)  # s touches no attribute
    assert [a[c] for c in S.LINES] == [21, 14, 2, 5]
    assert got["b.py"]["functions"] is None and got["b.py"]["lines"] == 1 and [got["d.py"][c] for c in S.LINES] == [0, 0, 0, 0] and got["d.py"]["cyclomatic"] == 1
    rows = {r["fully_qualified_name"]: r for r in S.function_stats(files).collect()}
    assert sorted(rows) == ["A#m", "A::s", "free", "inner"]
    assert [rows["A#m"][c] for c in S.LINES] == [5, 4, 1, 0] and rows["A#m"]["fields"] == 2 and rows["A#m"]["cyclomatic"] == 2 and rows["A#m"]["complexity"] == 1
    assert [rows["free"][c] for c in S.LINES] == [5, 4, 0, 1] and S.file_stats(files.limit(0)).count() == 0


def test_repeated_and_null_paths_are_files_of_their_own(spark):
    one, two = "def f():\n    if x:\n        pass\n", "def f():\n    pass\n\ndef g():\n    pass\n"
    files = spark.createDataFrame([("a.py", one), ("a.py", two), (None, one)], "path string, contents string")
    got = sorted((str(r["path"]), r["functions"], r["lines"], r["cyclomatic"]) for r in S.file_stats(files).collect())
    assert got == [("None", 1, 3, 2), ("a.py", 1, 3, 2), ("a.py", 2, 5, 1)]
    rows = sorted((str(r["path"]), r["name"], r["cyclomatic"], r["lines"]) for r in S.function_stats(files).collect())
    assert rows == [("None", "f", 2, 3), ("a.py", "f", 1, 2), ("a.py", "f", 2, 3), ("a.py", "g", 1, 2)]


def test_excluded_code_counts_in_the_total_only(spark):
    code = CODE + "\ndef test_it():\n    # why\n    assert free()\n    return '''a\nb'''\n"
    files = spark.createDataFrame([("a.py", code), ("t.py", "def test_a():\n    pass\n")], "path string, contents string")
    tests = ['((function_definition name: (identifier) @name) @f (#match? @name "^test_"))']
    plain, kept = ({r["path"]: r for r in S.file_stats(files, x).collect()} for x in ([], tests))
    assert (plain["a.py"]["functions"], kept["a.py"]["functions"]) == (5, 4) and [kept["a.py"][c] for c in S.LINES] == [27, 14, 2, 11]
    assert [plain["a.py"][c] for c in S.LINES] == [27, 18, 3, 6]
    assert (kept["t.py"]["functions"], kept["t.py"]["cyclomatic"], kept["t.py"]["code_lines"], kept["t.py"]["blank_lines"]) == (0, 1, 0, 2)
    assert sorted(r["name"] for r in S.function_stats(files, tests).collect()) == ["free", "inner", "m", "s"]
