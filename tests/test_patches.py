"""Patches built from replacements and applied to files."""

import random

from gaugeworks.operators import patches as P
from pyspark.sql import functions as F

TEXT = "one\ntwö\nthree\nfour\n"


def r(data, start=None, end=None, place=(None,) * 4):
    return {"start_byte": start, "end_byte": end, "start_line": place[0], "start_column": place[1], "end_line": place[2], "end_column": place[3], "data": data}


def after(spark, *suggestions, text=TEXT):
    """What each suggestion makes of the text."""
    files = spark.createDataFrame([("f", text)], "path string, contents string")
    rows = spark.createDataFrame([(i, "f", x) for i, x in enumerate(suggestions)], f"position bigint, path string, replacements array<{P.REPLACEMENT}>")
    return [x["after"] for x in P.modified(rows, files).orderBy("position").collect()]


def test_replacements(spark):
    bad = (r("x", 7, 8), r("x", 5, 2), r("x", 0, 999), r("x", place=(9, 1, 9, 2)), r("x", -1, 2))
    good = [
        [r("1", 0, 3), r("2", 4, 8)], [r("ü", place=(2, 3, 2, 4))], [r("!", place=(1, 99, 1, 99))], [r("T", place=(3, 1, 3, 2)), r("F", place=(4, None, 4, 2)), r("O", 0, 1)],
        [r("a", 0, 0), r("b", 0, 0)], [r(None, 8, 14)], [r("x", 14, 20)],
    ]
    got = after(spark, *good, *[[r("1", 0, 3), x] for x in bad], [])
    assert got[:7] == ["1\n2\nthree\nfour\n", "one\ntwü\nthree\nfour\n", "one!\ntwö\nthree\nfour\n", "One\ntwö\nThree\nFour\n", "abone\ntwö\nthree\nfour\n", "one\ntwö\nfour\n", "one\ntwö\nthreex\n"]
    assert got[7:] == [None] * 6


def plain(text, replacements):
    """One after the other, the last end first."""
    raw = text.encode()
    for x in sorted(replacements, key=lambda x: x["end_byte"])[::-1]:
        start, end = x["start_byte"], x["end_byte"]
        end -= end == len(raw) and end > 0
        if not 0 <= start <= end < len(raw) or any(raw[k] & 0xC0 == 0x80 for k in (start, end)):
            return None
        raw = raw[:start] + x["data"].encode() + raw[end:]
    return raw.decode()


def test_random_replacements(spark):
    rng = random.Random(7)
    cases = [[r(rng.choice(["", "x", "é\n"]), *sorted((rng.randrange(22), rng.randrange(22)))) for _ in range(rng.randrange(1, 5))] for _ in range(200)]
    got, want = after(spark, *cases), [plain(TEXT, c) for c in cases]
    assert got == want and sum(x is not None for x in want) > 50


def test_patch_text_and_round_trip():
    assert P.unified(TEXT, TEXT.replace("three", "3")) == "--- original\n+++ modified\n@@ -1,4 +1,4 @@\n one\n twö\n-three\n+3\n four\n"
    rng = random.Random(3)
    for _ in range(300):
        a = "".join(rng.choice("ab\n") for _ in range(rng.randrange(60)))
        b = "".join(rng.choice([x, x, x, "c", ""]) for x in a)
        assert P.applied(a, P.unified(a, b)) == b, (a, b)
    assert P.applied("x\n" * 9 + TEXT, P.unified(TEXT, TEXT.replace("three", "3"))) == "x\n" * 9 + TEXT.replace("three", "3")
    assert P.applied("other\n", P.unified(TEXT, "")) is None


def test_tables(spark):
    text = TEXT + "x\n" * 9 + "end\n"  # the second patch's context doesn't reach the first
    files = spark.createDataFrame([("f", text), ("g", None)], "path string, contents string")
    rows = [(1, "f", [r("1", 0, 3)]), (2, "f", [r("x", 0, 999)]), (3, "g", [r("1", 0, 1)]), (4, "f", []), (5, None, [r("1", 0, 1)]), (6, "f", [r("END", place=(14, 1, 14, 4))]), (7, "f", [r("3", place=(3, 1, 3, 6))])]
    made = P.build_patches(spark.createDataFrame(rows, f"position bigint, path string, replacements array<{P.REPLACEMENT}>"), files)
    assert {x["position"]: bool(x["patch"]) for x in made.collect()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True, 7: True}
    done = P.apply_patches(files, made).collect()
    assert [(x["path"], x["contents"], list(x["fixed"])) for x in done] == [("f", text.replace("one", "1").replace("end", "END"), [1, 6])]  # 7 has the line that 1 changed as context
    issues = spark.createDataFrame([("p", "f", "eslint", "semi"), ("", "f", "eslint", "semi"), ("p", None, "eslint", "semi"), ("p", "f", "eslint", "@typescript-eslint/no-explicit-any")], "patch string, path string, tool string, rule_key string")
    flags = [x[0] for x in issues.select(P.patchable(*map(F.col, ("patch", "path", "tool", "rule_key")))).collect()]
    assert flags == [True, False, False, False]
