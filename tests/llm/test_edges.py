"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing columns and no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugeworks.llm import exact, langid, lines, lm, media, ngram_join, packing, pieces, secrets, shards
from gaugeworks.llm.common import vocabulary_path

ROWS = [
    (1, "the quick brown fox jumps over the lazy dog " * 3, "en"),
    (1, "the quick brown fox jumps over the lazy dog " * 3, "en"),
    (2, None, "en"),
    (3, "", None),
    (None, "le renard brun saute par dessus le chien", "fr"),
    (None, None, None),
    (4, "12345 !!!", "fr"),
    (5, "password=abcdef123 user=bob\nline\n\nline", "en"),
    (5, "another text under one id", "en"),
    (7, "x" * 300_000 + " end", "en"),
    (8, "wort " * 60_000, "de"),
    (9, "the quick brown fox jumps over the lazy dog " * 3, "en"),
    (10, "naïve ☃ 漢字 🙂 é", "fr"),
]
N = len(ROWS)


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    clash = ["id", "key", "n", "label", "digest", "h", "line", "found", "entry", "part", "bin", "item", "held", "fold", "copies", "_hash"]
    return base.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)]).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def train_and_predict(df):
    return langid.predict(df, langid.train(df, "text", "lang", bits=10), "doc_id", "text")


OPERATORS = {
    "langid": train_and_predict,
    "secrets": lambda df: secrets.scan(df, "doc_id", "text"),
    "exact": lambda df: exact.exact_dedup(df, "doc_id", "text"),
    "lines": lambda df: lines.dedup_lines(df, "doc_id", "text"),
    "lm": lambda df: lm.score_documents(df, "doc_id", "text", F.col("doc_id") == 5),
    "media": lambda df: media.media_rows(df, "doc_id", "text"),
    "shards": lambda df: shards.shard_rows(df, "doc_id", "text", 24),
    "ngram_join": lambda df: ngram_join.near_duplicates(df, "doc_id", "text"),
    "pieces": lambda df: pieces.round_trip(df, "doc_id", "text", vocabulary_path("piece_bpe_32k.model")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_input_row(name, docs):
    rows = OPERATORS[name](docs).collect()
    assert sorted(str(r["id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(name, empty):
    assert OPERATORS[name](empty).collect() == []


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, "doc_id", "text", vocabulary_path()).collect()
    firsts = [r for r in rows if r["piece"] == 0]
    assert len(firsts) == N
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048
    assert packing.pack_documents(empty, "doc_id", "text", vocabulary_path()).collect() == []


def test_language_cases(docs):
    found = {(r["id"], r["score"] > 0): r["lang_pred"] for r in train_and_predict(docs).collect()}
    assert found[(2, False)] == found[(3, False)] == found[(4, False)] == "und"
    assert all(found[k] in ("en", "fr", "de") for k in found if k[1])
    none = langid.predict(docs, langid.train(docs.limit(0), "text", "lang", bits=8), "doc_id", "text").collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_language_stage_decides_each_row(spark, docs):
    shared = docs.where("doc_id = 5").withColumn("text", F.lit("123").cast("string"))
    kept = corpus_pipeline.language(spark, docs.unionByName(shared), "")
    assert kept.columns == docs.columns
    want = [(i, t) for i, t, _ in ROWS if t and any(map(str.isalpha, t))]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["text"])) for r in kept.collect())


def test_language_stage_without_labels(spark, docs):
    want = sum(1 for _, t, _ in ROWS if t and any(map(str.isalpha, t)))
    for lang in (None, "und"):
        kept = corpus_pipeline.language(spark, docs.withColumn("lang", F.lit(lang).cast("string")), "")
        assert kept.count() == want


def test_language_stage_follows_the_classifier(spark):
    rows = [(1, "aaaa", "a"), (2, "bbbb", "b"), (3, "cccc", "c"), (4, "q", None), (5, "aaaa q", None)]
    kept = corpus_pipeline.language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 5]


def test_exact_cases(docs):
    rows = exact.exact_dedup(docs, "doc_id", "text").collect()
    fox = [r for r in rows if r["keep_id"] == 9]
    assert sorted(r["id"] for r in fox) == [1, 1, 9] and sum(r["kept"] for r in fox) == 1 and fox[0]["group_size"] == 3
    blank = [r for r in rows if r["group_size"] == 3 and r["keep_id"] == 3]
    assert sorted(str(r["id"]) for r in blank) == ["2", "3", "None"]


def test_keep_rows(docs):
    kept = exact.keep_rows(docs, "doc_id", "text")
    assert kept.columns == docs.columns
    assert kept.count() == N - 4
    twice = docs.where("doc_id = 1").unionByName(docs.where("doc_id = 1"))
    assert exact.keep_rows(twice, "doc_id", "text").count() == 1
    near = ngram_join.keep_rows(docs, "doc_id", "text", ngram_join.Rule(5, 80, 100))
    assert near.columns == docs.columns and near.where("doc_id = 9").count() == 0 and near.where("doc_id = 1").count() == 1


def test_secret_cases(docs):
    rows = {(r["id"], r["digest"]): r["found"] for r in secrets.scan(docs, "doc_id", "text").collect()}
    hit = [f for f in rows.values() if f]
    assert [(x["kind"], x["start"], x["end"]) for x in hit[0]] == [("assign", 0, 18), ("ident", 19, 27)]
    masked = secrets.redact(docs, "doc_id", "text", secrets.scan(docs, "doc_id", "text"))
    assert masked.columns == docs.columns and masked.count() == N
    assert masked.where("text LIKE '[secret] [secret]%'").count() == 1


def test_line_cases(docs):
    rows = [(r["id"], r["n_lines"], r["removed"]) for r in lines.dedup_lines(docs, "doc_id", "text").collect()]
    assert (5, 4, [3]) in rows and (9, 1, [0]) in rows and (2, 1, []) in rows
    cleaned = lines.remove_lines(docs, "doc_id", "text", lines.dedup_lines(docs, "doc_id", "text"))
    assert cleaned.columns == docs.columns and cleaned.count() == N
    assert cleaned.where("doc_id = 9 AND text = ''").count() == 1


def test_components(docs):
    rows = {str(r["id"]): r for r in ngram_join.near_duplicates(docs, "doc_id", "text").collect()}
    assert rows["9"]["component_id"] == 1 and rows["3"]["component_id"] == 3 and rows["3"]["n_shingles"] == 0
    assert rows["8"]["n_shingles"] == 1


def test_shards_are_gapless(docs):
    rows = shards.shard_rows(docs, "doc_id", "text", 3).collect()
    for s in range(3):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 3) for r in rows)
    assert {r["size"] for r in rows if r["id"] == 2} == {8}
