"""Fill-in-middle against a regular expression's units, and exact round trips."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeworks.llm import fim

UNITS = {"chars": r"(?s:.)", "words": r"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*", "lines": r"[^\n]*\n|[^\n]+"}


def units(unit, text):
    if unit != "words":
        return re.findall(UNITS[unit], text)
    head = re.match(r"[ \t\n\x0b\x0c\r]*", text).group()
    return ([head] if head else []) + re.findall(r"[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*", text)


def plain(unit, doc_id, text):
    text = text or ""
    parts = units(unit, text)
    n = len(parts)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


ROWS = [(i, t) for i, t in enumerate(["", None, "a", " ", "\n", "a\n\nb", "  two  words ", "no <M> here", "<P", "<<S>", "tail <", "🙂é漢字 naïve", "x" * 200_000, "w " * 100_000, "line\n" * 50_000] * 6)] + [(None, "null id"), (3, "shared id"), (3, "shared id")]


@pytest.mark.parametrize("unit", list(fim.CHANGES))
def test_equals_plain_units(spark, unit):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("form", F.lit(1)).withColumn("h1", F.lit("x")).repartition(3)
    rows = fim.restore(fim.transform(df, "doc_id", "text", unit=unit)).collect()
    key = lambda r: (str(r[0]), r[5])
    assert sorted((tuple(r)[:6] for r in rows), key=key) == sorted((plain(unit, *r) for r in ROWS), key=key)
    assert sorted(r["restored"] for r in rows) == sorted(t or "" for _, t in ROWS)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>PSM a\n\té🙂", max_size=40), st.tuples(*[st.integers(0, 2**32 - 1)] * 4), st.sampled_from(list(fim.CHANGES)))
def test_round_trip(text, h, unit):
    scanner = fim.Scanner(unit)
    n, form, a, m, out = fim.arrange(scanner, text, h, 90, 20)
    assert fim.rebuild(fim.Scanner(), out, form) == text
    assert n == len(units(unit, text))


def test_sentinels_that_could_overlap_are_refused():
    for bad in (("<a>", "<a>b", "c"), ("ab", "bc", "x"), ("aba", "x", "y"), ("", "x", "y")):
        with pytest.raises(ValueError, match="overlap"):
            fim.Scanner("chars", bad)


def test_empty_table_and_given_sentinels(spark):
    df = spark.createDataFrame([(i, "some text of words") for i in range(50)], "doc_id long, text string")
    marks = ("[prefix words]", "[suffix words]", "[middle words]")
    rows = fim.restore(fim.transform(df, "doc_id", "text", unit="words", plain_from=100, sentinels=marks), sentinels=marks).collect()
    assert {r["restored"] for r in rows} == {"some text of words"} and "plain" not in {r["form"] for r in rows}
    assert fim.restore(fim.transform(df.limit(0), "doc_id", "text")).count() == 0
