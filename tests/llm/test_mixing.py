"""Source mixing against a plain sort by hash, and what the mix promises."""

import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import mixing


def plain(rows, weights=(5, 2, 1), share=1, most=3):
    """{(id, source, text): how often each of the equal rows is taken, sorted}, {source: target}"""
    by = defaultdict(list)
    for i, text, source in rows:
        size = len(re.findall(mixing.WORDS, text or ""))
        h = hashlib.md5(f"{'' if i is None else i}:{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()
        by[source].append((h, size, (i, source, text)))
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    size = {s: sum(x[1] for x in by[s]) for s in names}
    budget, capped = int(share * sum(size.values())), set()
    while True:
        left, free = budget - sum(most * size[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and weight[s] * left > most * size[s] * free}
        if not more:
            break
        capped |= more
        if len(capped) == len(names):
            break
    target = {s: float(most * size[s]) if s in capped else float(Fraction(weight[s] * left)) / free for s in names}
    taken = defaultdict(list)
    for s in names:
        k = int(target[s] // size[s]) if size[s] else 0
        rest, before = target[s] - k * size[s], 0
        for _, n, key in sorted(by[s]):
            extra = n > 0 and before < rest and (before + n <= rest or before + n - rest <= rest - before)
            taken[key].append(k + extra if n else 0)
            before += n
    return {k: sorted(v) for k, v in taken.items()}, target


def answers(df, **rule):
    rows = mixing.mix(df, "doc_id", "text", "source", **rule).join(df.select("doc_id", "text", F.col("source").alias("s")).distinct(), F.col("id").eqNullSafe(F.col("doc_id")) & F.col("source").eqNullSafe(F.col("s")) & (F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary")) == F.col("h"))).collect()
    taken, target = defaultdict(list), {}
    for r in rows:
        taken[(r["id"], r["source"], r["text"])].append(r["times"])
        target[r["source"]] = r["target"]
    return {k: sorted(v) for k, v in taken.items()}, target


def words(n):
    return " ".join(f"w{k}" for k in range(n))


CASES = {
    "many": [(i, words(1 + i * 7 % 90), f"s{i % 7}") for i in range(900)],
    "hot": [(i, words(20), "hot" if i % 3 else f"s{i % 11}") for i in range(600)],
    "equal rows": [(1, words(10), "a")] * 301 + [(2, words(3000), "b"), (3, words(50), None)],
    "capped": [(i, words(2), "a") for i in range(5)] + [(i, words(500), "z") for i in range(40)] + [(99, words(3), None)],
    "edges": [(None, words(5), None), (None, None, None), (1, "", "e"), (2, None, "e"), (3, words(5), "é"), (3, words(5), "é"), (4, words(4), ""), (5, words(9), "z\U0001f642")],
    "one": [(1, words(5), "a")],
    "no words": [(1, None, "a"), (2, " \t", "b")],
}


@pytest.mark.parametrize("name", CASES)
def test_equals_a_sort_by_hash(spark, name):
    df = spark.createDataFrame(CASES[name], "doc_id long, text string, source string").repartition(3)
    assert answers(df) == plain(CASES[name])


def test_other_weights_and_budgets_nest(spark):
    rows = CASES["many"]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    before = None
    for share in (0.25, 0.5, 1.0):
        taken, target = answers(df, weights=(1, 3), share=share, most=2)
        assert (taken, target) == plain(rows, (1, 3), share, 2)
        if before:
            assert all(x <= y for k in taken for x, y in zip(before[k], taken[k], strict=True))
        before = taken


def test_few_digits_a_round_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DIGITS", 1)
    df = spark.createDataFrame(CASES["many"], "doc_id long, text string, source string")
    assert answers(df) == plain(CASES["many"])


def test_shuffle_joins_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 2)
    df = spark.createDataFrame(CASES["hot"], "doc_id long, text string, source string")
    assert answers(df) == plain(CASES["hot"])


def test_targets_are_met_and_no_source_is_above_its_cap(spark):
    rows = mixing.mix(spark.createDataFrame(CASES["hot"], "doc_id long, text string, source string"), "doc_id", "text", "source")
    for r in rows.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("t"), F.first("target").alias("g"), F.max("size").alias("m"), F.max("times").alias("k")).collect():
        assert abs(r["t"] - r["g"]) <= r["m"] / 2 and r["k"] <= 3


def test_mixed_rows_repeat_whole_rows(spark):
    df = spark.createDataFrame(CASES["equal rows"], "doc_id long, text string, source string").withColumn("copy", F.lit("x")).withColumn("h", F.lit(1))
    rows = mixing.mixed_rows(df, "doc_id", "text", "source")
    assert rows.columns == [*df.columns, "copy_"]
    taken, _ = plain(CASES["equal rows"])
    assert {(r["doc_id"], r["source"], r["text"]): r["count"] for r in rows.groupBy("doc_id", "source", "text").count().collect()} == {k: sum(v) for k, v in taken.items() if sum(v)}


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string"), "doc_id", "text", "source").count() == 0


def test_wrong_arguments(spark):
    df = spark.createDataFrame(CASES["one"], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="share"):
        mixing.mix(df, "doc_id", "text", "source", share=4)
