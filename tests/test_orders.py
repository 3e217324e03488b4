"""Orders over whole tables: every row has its place."""

from gaugeworks.operators import issues as I

ROWS = [(k, f"p{k % 7}" if k % 11 else None, k % 5 if k % 3 else None, 10 * (k % 4), f"m{k % 2}", f"t{k % 3}", f"d{k % 4}", f"r{k % 5}") for k in range(2000)]
NAMES = "id long, path string, start_line long, level long, message string, tool string, driver string, rule_key string"


def none_first(*values):
    return tuple((x is not None, x) for x in values)


def test_positions_of_all_rows(spark):
    df = spark.createDataFrame(ROWS, NAMES).repartition(5)
    want = sorted(ROWS, key=lambda r: (none_first(r[1]), r[2] or 0, -r[3], r[4], r[0]))
    got = {r["position"]: r["id"] for r in I.positions(I.issue_order(df, "id")).collect()}
    assert got == {n: r[0] for n, r in enumerate(want, 1)}
    want = sorted(ROWS, key=lambda r: (*r[5:8], none_first(r[1], r[2]), r[0]))
    got = {r["position"]: r["id"] for r in I.positions(I.build_order(df, "id")).collect()}
    assert got == {n: r[0] for n, r in enumerate(want, 1)}
