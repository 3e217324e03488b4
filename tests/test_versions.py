"""Version order, requirements and resolution against plain tuples."""

import itertools
import random
import re

from pyspark.sql import functions as F

from gaugeworks.operators import versions as V


def parse(v):
    m = re.fullmatch(r"v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+.*)?", v)
    pre = tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in m[4].split(".")) if m[4] else None
    return tuple(map(int, m.groups()[:3])), pre


def order(v):
    numbers, pre = parse(v)
    return numbers, pre is None, pre or ()


ORDERED = ["0.0.0-0", "0.0.0", "0.0.1", "0.2.0-alpha", "0.2.0", "1.0.0-1", "1.0.0-2", "1.0.0-10", "1.0.0-10.a", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-alpha-b", "1.0.0-alphab", "1.0.0-beta", "1.0.0", "1.2.3", "1.10.0", "2.0.0", "18446744073709551615.0.0"]


def test_keys_sort_as_versions(spark):
    rows = spark.createDataFrame([(v,) for v in [*ORDERED, "1.2", "x", None, "01.2.3", "v1.2.3+b"]], "v string").select("v", V.version_key(F.col("v")).alias("k")).collect()
    keys = {r["v"]: r["k"] for r in rows}
    assert [keys[x] for x in ("1.2", "x", None, "01.2.3")] == [None] * 4 and keys["v1.2.3+b"] == keys["1.2.3"]
    assert sorted(ORDERED, key=keys.get) == sorted(ORDERED, key=order)


def comparator(text, v):
    """Whether one comparator takes a version, pre-releases aside; and the numbers of a pre-release that it names."""
    m = re.fullmatch(r"\s*(=|>=|<=|>|<|\^|~)?\s*(?:(\d+)(?:\.(\d+|\*))?(?:\.(\d+|\*))?(?:-([0-9A-Za-z.-]+))?|(\*))\s*", text)
    if m[6]:
        return True, None
    sign = m[1] or ("=" if "*" in text else "^")
    given = [int(x) if x and x != "*" else None for x in m.groups()[1:4]]
    a, b, c = given[0], given[1] or 0, given[2] or 0
    numbers, pre = parse(v)
    own = order(v)
    at = order(f"{a}.{b}.{c}" + (f"-{m[5]}" if m[5] else ""))
    same = all(g is None or g == n for g, n in zip(given, numbers))
    if given[1] is None or given[2] is None:
        known = tuple(g for g in given if g is not None)[: 1 if given[1] is None else 2]
        head = numbers[: len(known)]
        taken = {"=": head == known, ">": head > known, ">=": head >= known, "<": head < known, "<=": head <= known, "~": head == known, "^": head == known if a or given[1] is None or len(known) == 1 else head == known}[sign]
        if sign == "^" and len(known) == 2 and a:
            taken = head[0] == known[0] and head >= known
        return taken, None
    upper = {"^": (a + 1, 0, 0) if a else (0, b + 1, 0) if b else (0, 0, c + 1), "~": (a, b + 1, 0)}
    taken = {"=": own == at, ">": own > at, ">=": own >= at, "<": own < at, "<=": own <= at}.get(sign, own >= at and numbers < upper.get(sign, ()))
    return taken, (a, b, c) if m[5] else None


def fulfils(requirement, v):
    numbers, pre = parse(v)
    for conjunction in requirement.split("||"):
        found = [comparator(c, v) for c in conjunction.split(",") if c.strip()]
        if all(t for t, _ in found) and (pre is None or any(p == numbers for _, p in found)):
            return True
    return False


REQUIREMENTS = ["*", "", "^1.2", "1", "~1", "~1.2", "^0", "^0.2", "^0.0.1", "^0.2.0-alpha", "=1.0.0", "= 1.0", "=1", ">1", ">=1.0", "<1.0.0", "<=1", "<1", "1.*", "1.2.*", ">=1.0.0-alpha, <1.0.0", ">=0.0.1,<1.2.3 || ^2.0", "~1.0.0-alpha.1", ">1.0.0-2", "<=1.0.0-alpha || =0.0.0", ">2, <1", "^1.0.0-10 || 0.0.*"]
POOL = [v for v in ORDERED if not v.startswith("1844")] + ["1.2.4-rc.1", "1.3.0", "0.2.5", "0.0.2", "2.0.1-rc", "3.1.0"]


def test_satisfies_equals_comparing_numbers(spark):
    rows = spark.createDataFrame(list(itertools.product(REQUIREMENTS, POOL)), "r string, v string")
    got = {(x["r"], x["v"]): x["ok"] for x in rows.select("r", "v", V.satisfies(V.version_key(F.col("v")), F.col("r")).alias("ok")).collect()}
    wrong = [(k, x) for k, x in got.items() if x != fulfils(*k)]
    assert not wrong
    bad = spark.createDataFrame([("1.0.0", "abc"), ("1.0.0", "^1.2.3.4"), ("x", "*"), ("1.0.0", None)], "v string, r string")
    assert [x[0] for x in bad.select(V.satisfies(V.version_key(F.col("v")), F.col("r"))).collect()] == [None] * 4


def test_resolution_equals_the_highest_that_fits(spark):
    rng = random.Random(1)
    versions = [(f"p{i}", v) for i in range(8) for v in rng.sample(POOL, rng.randrange(0, len(POOL)))] + [("p0", "junk"), ("p0", POOL[3]), ("p0", POOL[3])]
    asked = [(f"p{i}", r) for i in range(9) for r in REQUIREMENTS] + [("p1", "junk")]
    got = {(r["package"], r["requirement"]): r["version"] for r in V.resolve(spark.createDataFrame(asked, "package string, requirement string"), spark.createDataFrame(versions, "package string, version string")).collect()}
    want = {}
    for p, r in asked:
        fits = [v for q, v in versions if q == p and v != "junk" and r != "junk" and fulfils(r, v)]
        want[p, r] = max(fits, key=order) if fits else None
    assert got == want
    assert V.resolve(spark.createDataFrame([], "package string, requirement string"), spark.createDataFrame(versions, "package string, version string")).count() == 0
