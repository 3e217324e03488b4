"""Differences of snapshots: applied again they give the other side."""

import random

from gaugeworks.operators import snapshots as S


def lines(text):
    return [] if not text else text.split("\n")[:-1] if text.endswith("\n") else text.split("\n")


def replay(text, other, rows):
    """``other`` from ``text`` by the kept lines' places and the added lines' numbers."""
    a, b = lines(text), lines(other)
    out = {}
    for op, old, new in rows:
        if op == " ":
            assert a[old - 1] == b[new - 1]
            out[new] = a[old - 1]
        elif op == "+":
            out[new] = b[new - 1]
    assert sorted(out) == list(range(1, len(b) + 1)) and [out[k] for k in sorted(out)] == b
    assert sorted(old for op, old, _ in rows if op != "+") == list(range(1, len(a) + 1))
    kept = [(old, new) for op, old, new in rows if op == " "]
    assert sorted(kept) == sorted(kept, key=lambda x: x[1])  # both sides rise


def tables(spark, before, after):
    return (spark.createDataFrame(list(x.items()), "path string, contents string") for x in (before, after))


def test_random_files(spark):
    rng, before, after = random.Random(2), {}, {}
    for i in range(60):
        a = [rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(30))]
        b = [x for x in a if rng.random() > 0.2]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.choice(["new", "a", "zz"]))
        if len(b) > 4 and rng.random() < 0.3:
            b.append(b.pop(0))  # a line that moves crosses all others
        before[f"f{i}"], after[f"f{i}"] = "\n".join(a) + rng.choice(["", "\n"]), "\n".join(b) + rng.choice(["", "\n"])
    before["gone"], after["made"] = "x\ny\n", "1\n2"
    one, two = tables(spark, before, after)
    rows = {}
    for r in S.line_changes(one, two).collect():
        rows.setdefault(r["path"], []).append(tuple(r)[1:])
    for path in {*before, *after}:
        a, b = before.get(path, ""), after.get(path, "")
        if a == b:
            assert path not in rows
        elif rows.get(path) or a or b:
            replay(a, b, rows.get(path, []))
    added = S.added_lines(S.line_changes(one, two)).where("path = 'made'").collect()
    assert sorted(r["line"] for r in added) == [1, 2]


def test_a_line_with_and_without_its_end_differ(spark):
    one, two = tables(spark, {"f": "a\nb"}, {"f": "a\nb\n"})
    assert sorted((r["op"], r["old_line"], r["new_line"]) for r in S.line_changes(one, two).collect()) == [(" ", 1, 1), ("+", None, 2), ("-", 2, None)]


def test_few_lines_change_in_a_long_file(spark):
    a = [f"line {i}" for i in range(5000)] + ["same"] * 200
    b = a[:1000] + ["new"] + a[1003:4000] + a[4500:4600] + a[4000:4500] + a[4600:]
    one, two = tables(spark, {"f": "\n".join(a)}, {"f": "\n".join(b)})
    rows = [tuple(r)[1:] for r in S.line_changes(one, two).collect()]
    replay("\n".join(a), "\n".join(b), rows)
    assert sum(op == "+" for op, _, _ in rows) == 101 and sum(op == "-" for op, _, _ in rows) == 103


def test_file_changes(spark):
    before = {"same": "s", "edit": "1", "old1": "r", "old2": "r", "dead": "d", "empty": "", "null": None}
    after = {"same": "s", "edit": "2", "new2": "r", "new1": "r", "new3": "r", "fresh": "f", "empty": "", "null": "n"}
    one, two = tables(spark, before, after)
    assert sorted(tuple(r) for r in S.file_changes(one, two).fillna("-").collect()) == [("dead", "dead", "D"), ("edit", "edit", "M"), ("fresh", "-", "A"), ("new1", "old1", "R"), ("new2", "old2", "R"), ("new3", "-", "A"), ("null", "-", "A")]
    assert S.line_changes(one.limit(0), two.limit(0)).count() == 0 and S.file_changes(one, one).count() == 0
