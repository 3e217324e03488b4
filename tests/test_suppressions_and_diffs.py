"""Suppression comments and unified diffs on golden cases and against line-by-line states."""

import random

from pyspark.sql import functions as F

from gaugeworks.operators import suppressions as S
from gaugeworks.sources import diffs as D

RUBY = """## skip-rule: +rule1, rule2, -rule8
#
# skip-rule(>rule3,+rule5): explanation
#
def example
    puts "hi" # skip-rule: rule6, -rule1, +rule8
    # skip-rule: rule4, -rule1
    x = 1

    y = 2
end
def other; end"""


def covered(spark, text, name="f.other"):
    out = {}
    for _, line, rule in S.suppressions(spark.createDataFrame([(name, text)], "path string, contents string"), "skip-rule").orderBy("line", "rule").collect():
        out.setdefault(line, []).append(rule)
    return out


def test_directives(spark):
    want = ["R1", "+R2", "-R3", ">R4"]
    texts = ["// skip-rule: R1,+R2, -R3   >R4", "/*skip-rule:R1,+R2,-R3,>R4*/", "*** skip-rule: R1,+R2,-R3,>R4", "# skip-rule: R1,+R2, -R3   >R4*/", "### skip-rule: R1,+R2, -R3   >R4*/", "///skip-rule(R1,+R2, -R3   >R4): why", "  # skip-rule R1 +R2,-R3 >R4 "]
    rows = spark.createDataFrame([(t,) for t in [*texts, "// not-skip-rule: rule", "skip-rule: x", "# skip-rule"]], "t string").select("t", S.directive_rules(F.col("t"), "skip-rule").alias("r")).collect()
    assert [r["r"] for r in rows] == [want] * len(texts) + [None, None, []]


def test_states_of_a_file(spark):
    # Python's comments are told by its tokenizer, trailing ones too; these lines are Ruby, of which only full lines count
    got = covered(spark, RUBY)
    assert got[1] == ["rule1", "rule2"] and got[5] == ["rule1", "rule2", "rule3", "rule5"]
    assert got[6] == ["rule1", "rule2", "rule5"] and 9 not in got
    assert got[7] == got[8] == ["rule2", "rule4", "rule5"]
    assert got[10] == got[11] == ["rule2", "rule5"] and got[12] == ["rule5"]


def test_shell_blocks_end_by_indent(spark):
    text = '# skip-rule: rule1\n// skip-rule(rule2): x\n/* skip-rule: rule3 */\necho "hi" # skip-rule: rule4\n# skip-rule: rule5\nif [ -f "f" ]; then\n  echo "f"\nfi\necho "done"'
    assert covered(spark, text) == {1: ["rule1"], 2: ["rule1", "rule2"], 3: ["rule1", "rule2", "rule3"], 4: ["rule1", "rule2", "rule3"], 5: ["rule1", "rule2", "rule3", "rule5"], 6: ["rule5"], 7: ["rule5"], 8: ["rule5"]}


PYTHON = """## skip-rule: +rule1, rule2, -rule8
#
# skip-rule(>rule3,+rule5): explanation
#
if a:
    b()  # skip-rule: rule6, -rule1, +rule8
    # skip-rule: rule4, -rule1
    c = '''
    # skip-rule: +rule7
    '''
    d()
pass
e()
"""


def test_trailing_python_comments(spark):
    text = "# skip-rule: +a\nx = 1  # skip-rule: -a, b\ny = '# skip-rule: c'\n"
    assert covered(spark, text, "f.py") == {1: ["a"], 2: ["b"], 3: ["a"]}
    head, two = ["rule1", "rule2", "rule3", "rule5"], ["rule2", "rule5"]
    got = covered(spark, PYTHON, "g.py")
    assert [got[k] for k in range(1, 8)] == [["rule1", "rule2"]] * 2 + [head] * 3 + [["rule2", "rule5", "rule6", "rule8"], ["rule2", "rule4", "rule5"]]
    assert got[8] == ["rule2", "rule4", "rule5"] and [got[k] for k in range(9, 14)] == [two] * 4 + [["rule5"]]


def test_comments_of_several_lines(spark):
    text = "/* skip-rule: r1\n   more\n ** skip-rule(>r2): why\n*/\nf() {\n\n  x\n}\ny\n/* open\n # skip-rule: +r3\n"
    assert covered(spark, text, "f.js") == {1: ["r1", "r2"], 5: ["r1", "r2"], 7: ["r1"], 8: ["r1"], 10: ["r3"]}


def plain(lines, marks):
    """The states of a file line by line: ``marks`` has (line, rule, sign) of full-line comments, ``lines`` (indent, kind)."""
    out, on, after, blocks = set(), set(), set(), []
    for k, (indent, kind) in enumerate(lines, 1):
        for at, rule, sign in marks:
            if at == k:
                if sign == "+":
                    on.add(rule)
                elif sign == "-":
                    on.discard(rule)
                elif sign == ">":
                    after.add(rule)
                else:
                    blocks.append({"rule": rule, "at": indent, "seen": []})
        if kind == "blank":
            continue
        for b in list(blocks):  # a block ends at code no deeper than it, if all since the code before was no deeper
            if kind == "code" and "code" in (x for _, x in b["seen"]) and indent <= b["at"]:
                last = max(i for i, (_, x) in enumerate(b["seen"]) if x == "code")
                if max(d for d, _ in b["seen"][last:]) <= b["at"]:
                    blocks.remove(b)
                    continue
            b["seen"].append((indent, kind))
        out |= {(k, r) for r in on | after | {b["rule"] for b in blocks}}
        if kind == "code":
            after = set()
    return out


def test_random_files_equal_states_line_by_line(spark):
    rng, files, want = random.Random(11), [], set()
    for i in range(40):
        lines, marks, text = [], [], []
        for k in range(1, 30):
            indent, kind = rng.randrange(4), rng.choice(["code", "code", "code", "comment", "blank"])
            lines.append((0 if kind == "blank" else indent, kind))
            if kind == "comment" and rng.random() < 0.7:
                rule, sign = rng.choice("abc"), rng.choice(["", "", "+", "-", ">"])
                marks.append((k, rule, sign))
                text.append(" " * indent + f"# skip-rule: {sign}{rule}")
            else:
                text.append("" if kind == "blank" else " " * indent + ("# x" if kind == "comment" else "x"))
        files.append((f"f{i}", "\n".join(text)))
        want |= {(f"f{i}", k, r) for k, r in plain(lines, marks)} if marks else set()
    got = {tuple(r) for r in S.suppressions(spark.createDataFrame(files, "path string, contents string"), "skip-rule").collect()}
    assert got == want


def test_unsuppressed_issues(spark):
    files = spark.createDataFrame([("m.py", "# skip-rule: +lint\nx\n# skip-rule(-lint)\ny  # skip-rule: lint/r, other:q\nz"), ("n.py", None), ("o.py", "x")], "path string, contents string")
    rows = [("lint", "r", "m.py", 2), ("lint", "r", "m.py", 5), ("lint", "r", "m.py", 4), ("lint", "s", "m.py", 4), ("other", "q", "m.py", 4), ("lint", "r", "o.py", 1), ("lint", "r", None, None), ("lint", None, "m.py", 2)]
    issues = spark.createDataFrame([(*r, 7) for r in rows], "tool string, rule_key string, path string, start_line bigint, _rules_ int")
    left = S.unsuppressed(issues, S.suppressions(files, "skip-rule"))
    assert left.columns == issues.columns
    assert sorted(map(str, ((r[0], r[1], r[2], r[3]) for r in left.collect()))) == sorted(map(str, [rows[1], rows[3], rows[5], rows[6]]))
    assert S.suppressions(files.limit(0), "skip-rule").count() == 0


DIFF = """diff --git a/one.py b/one.py
index 1..2 100644
--- a/one.py
+++ b/one.py
@@ -1,3 +1,4 @@
 keep
-gone
+new
+++ b/looks like a header
 keep
@@ -10 +11,2 @@ def f():
 ten
+eleven
\\ No newline at end of file
diff --git a/dead.py b/dead.py
deleted file mode 100644
--- a/dead.py
+++ /dev/null
@@ -1 +0,0 @@
-x
diff --git a/old.py b/moved.py
similarity index 100%
rename from old.py
rename to moved.py
diff --git a/fresh.py b/fresh.py
new file mode 100644
--- /dev/null
+++ b/fresh.py
@@ -0,0 +1,2 @@
+a
+b
"""


def test_added_lines_and_changed_files(spark):
    df = spark.createDataFrame([("d", DIFF), ("e", None), ("f", "--- a/x\n+++ b/x\n@@ -1 +1,2 @@\n a\n+b\n--- a/y\n+++ b/y\n@@ -0,0 +5 @@\n+c")], "diff string, content string")
    got = sorted(tuple(r) for r in D.added_lines(df).collect())
    assert got == [("d", "fresh.py", 1), ("d", "fresh.py", 2), ("d", "one.py", 2), ("d", "one.py", 3), ("d", "one.py", 12), ("f", "x", 2), ("f", "y", 5)]
    files = sorted(tuple(r) for r in D.changed_files(df).collect())
    assert files == [("d", "fresh.py"), ("d", "moved.py"), ("d", "one.py"), ("f", "x"), ("f", "y")]


QUOTED = r'''diff --git "a/na\303\257ve.py" "b/na\303\257ve.py"
--- "a/na\303\257ve.py"
+++ "b/na\303\257ve.py"
@@ -1 +1,2 @@
 a
+b
diff --git "a/o\"\\\t.py" "b/n\"\\\t.py"
rename from "o\"\\\t.py"
rename to "n\"\\\t.py"
diff --git "a/em\303\251.py" "b/em\303\251.py"
new file mode 100644
'''


def test_quoted_names(spark):
    one = spark.createDataFrame([("q", QUOTED)], "diff string, content string")
    assert [tuple(r) for r in D.added_lines(one).collect()] == [("q", "naïve.py", 2)]
    assert sorted(r["path"] for r in D.changed_files(one).collect()) == ["emé.py", 'n"\\\t.py', "naïve.py"]
