"""What has a bound inside an operator keeps its results beyond that bound."""

import time

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gaugeworks.llm import langid, packing, pieces
from gaugeworks.llm.common import vocabulary_path


@pytest.fixture
def labelled(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5 + "common words of all", f"l{i:03d}") for i in range(520)] + [(1000, None, "l001"), (1001, "12 !", "l002"), (1002, "ab ab", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_any_number_of_labels(spark, labelled):
    model = langid.train(labelled, "text", "lang", bits=8)
    assert len(model.labels) == 512 and model.further().labels == [f"l{i:03d}" for i in range(512, 520)] and model.further().further is None
    got = {r["id"]: r for r in langid.predict(labelled, model, "doc_id", "text").collect()}
    assert sum(got[i]["lang_pred"] == f"l{i:03d}" for i in range(520)) > 500 and got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1000]["score"] == 0


def test_blocks_of_labels_give_what_one_block_gives(spark, labelled):
    some = labelled.where("doc_id < 60 OR doc_id >= 1000")
    whole, parts = (langid.predict(some, langid.train(some, "text", "lang", bits=8, max_labels=n), "doc_id", "text").orderBy("id").collect() for n in (100, 7))
    assert [(r["id"], r["lang_pred"]) for r in whole] == [(r["id"], r["lang_pred"]) for r in parts]
    assert np.allclose([r["score"] for r in whole], [r["score"] for r in parts], rtol=1e-12)
    kept = [langid.keep_rows(some, langid.train(some, "text", "lang", bits=8, max_labels=n), "text") for n in (100, 7)]
    assert kept[0].columns == some.columns and sorted(r["doc_id"] for r in kept[0].collect()) == sorted(r["doc_id"] for r in kept[1].collect())


def test_labels_equal_plain_bayes(spark):
    """Every text's posterior from counts of its n-grams, one label at a time."""
    rows = [(0, "aab aab", "x"), (1, "abb", "x"), (2, "Bbb é", "y"), (3, "aé", "z"), (4, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    bits, half = 8, 0.5

    def grams(text):
        points = np.array([ord(c) for c in text.lower()], np.uint32)
        out = []
        for bucket in langid.gram_buckets(points, np.array([0, len(points)]), bits):
            out += [b for b in bucket.tolist() if b < 1 << bits]
        return out

    counts = {x: np.full(1 << bits, half) for x in "xyz"}
    for _, text, label in rows:
        for b in grams(text):
            counts[label][b] += 1
    prior = {"x": 2 / 5, "y": 1 / 5, "z": 2 / 5}
    got = {r["id"]: r for r in langid.predict(df, langid.train(df, "text", "lang", bits=bits), "doc_id", "text").collect()}
    for i, text, _ in rows:
        if not any(c.isalpha() for c in text):
            assert got[i]["lang_pred"] == "und"
            continue
        logs = {x: np.log(prior[x]) + sum(np.log(counts[x][b] / counts[x].sum()) for b in grams(text)) for x in "xyz"}
        best = max(logs, key=logs.get)
        assert got[i]["lang_pred"] == best and abs(got[i]["score"] - 1 / sum(np.exp(v - logs[best]) for v in logs.values())) < 1e-4


def test_equal_scores_give_the_label_that_sorts_first(spark):
    df = spark.createDataFrame([(0, "same text", "b"), (1, "same text", "a"), (2, "same text", "c")], "doc_id long, text string, lang string")
    for n in (1, 2, 10):
        rows = langid.predict(df, langid.train(df, "text", "lang", bits=8, max_labels=n), "doc_id", "text").collect()
        assert {r["lang_pred"] for r in rows} == {"a"} and all(abs(r["score"] - 1 / 3) < 1e-9 for r in rows)


def test_full_pieces_and_bins_never_share_a_number(spark):
    rows = [(i, 0, 0, 16 if i % 2 else 5, i, (i << 33) if i % 2 else i) for i in range(32_760, 32_780)]  # as 32,780 partitions would number them
    found = spark.createDataFrame(rows, "id long, piece int, start long, length long, ids_crc32 long, item long")
    packed = packing.pack(found, 16)
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.count_distinct("offset").alias("o")).collect()
    assert packed.count() == len(rows) and all(r["n"] <= 16 and r["k"] == r["o"] for r in fill)
    assert sum(r["n"] == 16 and r["k"] == 1 for r in fill) == 10 and all(r["sequence_id"] < 0 for r in packed.where("length = 16").collect())


def exact_bins(sizes, capacity):
    """The fewest bins, by trying every place of every item."""
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + sizes[k], *bins[i + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best


def test_best_fit_and_bounds_against_exact_packings():
    rng = np.random.default_rng(4)
    for _ in range(150):
        capacity = int(rng.integers(4, 24))
        sizes = rng.integers(1, capacity + 1, rng.integers(1, 9))
        exact = exact_bins(sorted(sizes.tolist(), reverse=True), capacity)
        bins, offsets = packing.best_fit(sizes, capacity)
        assert packing.lower_bound(sizes, capacity) <= exact <= bins.max() + 1 <= exact * 11 / 9 + 1
        for b in range(bins.max() + 1):
            own = np.sort(offsets[bins == b])
            ends = own + sizes[bins == b][np.argsort(offsets[bins == b])]
            assert own[0] == 0 and (own[1:] == ends[:-1]).all() and ends[-1] <= capacity


@pytest.mark.parametrize("text", ["  " + "x" * 300_000, "  " + "ab" * 50_000 + " end", " " * 5000])
def test_long_units_behind_blanks_take_seconds(text):
    path = vocabulary_path("piece_bpe_32k.model")
    codec, model = pieces.pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    began = time.time()
    ids = codec.encode([text])[0]
    assert time.time() - began < 30 and ids.tolist() == model.encode(text) and codec.decode(ids) == text
