"""Tokenizer alignment against one text at a time, encoded by the libraries and merged by two plain pointers."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import align
from gaugeworks.llm.common import vocabulary_path

A, B = vocabulary_path(), vocabulary_path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox can't jump over 1234 lazy dogs.",
    "The quick brown fox can't jump over 1234 lazy dogs.",
    None,
    "",
    " ",
    "  leading and trailing  ",
    "line\nline\r\n\n\ttabs   and   runs ",
    "naïve ☃ 漢字 🙂 é \x00 <s> <|endoftext|> <0x41>",
    "a literal ▁ mark",
    "x" * 3000,
    "Straße über café déjà vu " * 40,
]


def plain(texts):
    """The contract, word for word."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    alphabet = align.byte_alphabet()
    rows, counts = [], Counter()
    for text in texts:
        row = {"n_a": 0, "n_b": 0, "n_groups": 0, "links": [], "sha": ""}
        rows.append(row)
        if not text:
            continue
        want = (" " + text).encode()
        e = tok.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(alphabet[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
        b = []
        for i in sp.encode(text):
            p = sp.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()))
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            continue
        groups, links, i, j, end_a, end_b = [([], [])], [], 0, 0, len(a[0][1]), len(b[0][1])
        groups[0][0].append(a[0][0])
        groups[0][1].append(b[0][0])
        while True:
            links.append((a[i][0], b[j][0]))
            if end_a == end_b == len(want):
                break
            step_a, step_b = end_a <= end_b, end_b <= end_a
            if end_a == end_b:
                groups.append(([], []))
            if step_a:
                i, end_a = i + 1, end_a + len(a[i + 1][1])
                groups[-1][0].append(a[i][0])
            if step_b:
                j, end_b = j + 1, end_b + len(b[j + 1][1])
                groups[-1][1].append(b[j][0])
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        row.update(n_a=len(a), n_b=len(b), n_groups=len(groups), links=links, sha=hashlib.sha256(shown.encode()).hexdigest())
        counts.update(links)
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(r["n_a"], r["n_b"], r["n_groups"], len(r["links"]), sum(counts[x] == top[x[1]] for x in r["links"]), sum(counts[x] for x in r["links"]), r["sha"]) for r in rows]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def aligned(df):
    return [tuple(r[c] for c in COLUMNS) for r in sorted(align.align(df, "doc_id", "text", A, B).collect(), key=lambda r: r["id"])]


@pytest.mark.parametrize("parts", [1, 3])
def test_equals_plain_pointers(spark, parts):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(parts)
    assert aligned(df) == plain(TEXTS)


def test_documents_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    assert aligned(docs) == plain(texts)


def test_long_texts_are_cut_where_both_sides_end(monkeypatch):
    monkeypatch.setattr(align, "PART_CHARS", 64)
    monkeypatch.setattr(align, "BLOCK_CHARS", 200)
    texts = TEXTS + ["word " * 500, "no cut here " * 30, "über " * 100]
    assert all("".join(align.parts_of(t)) == " " + t for t in texts if t)
    a, b = align.ByteSide(A), align.PieceSide(B)
    found = [doc for doc, _ in align.documents_of(range(len(texts)), texts, a, b)]
    want = plain(texts)
    assert [(d[1], d[2], d[3], int(d[6].sum()), d[4]) for d in found] == [(w[0], w[1], w[2], w[3], w[6]) for w in want]


def test_null_and_shared_ids_empty_tables_and_other_columns(spark):
    df = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two"), (2**62 + 1, "three")], "doc_id long, text string")
    df = df.withColumn("block", F.lit(1)).withColumn("pair", F.lit("x")).withColumn("item", F.lit(0))
    rows = align.align(df, "doc_id", "text", A, B).collect()
    assert sorted(str(r["id"]) for r in rows) == ["1", "1", str(2**62 + 1), "None"]
    same = [tuple(r)[1:] for r in rows if r["id"] in (1, None)]
    assert len(set(same)) == 1 and same[0][5] == 3 * same[0][3]  # each link three times in all
    assert align.align(df.limit(0), "doc_id", "text", A, B).count() == 0


def test_links_of_the_corpus(spark):
    df = spark.createDataFrame([(0, "a b"), (1, "a b"), (2, "a c")], "doc_id long, text string")
    b = align.PieceSide(B)
    counts = align.links(align.pair_counts(align.blocks(df, "doc_id", "text", A, B), b.table.size), b.table.size).collect()
    shown = {b.model.id_to_piece(r["b"]): (r["n"], r["best"]) for r in counts}
    assert shown == {"▁a": (3, True), "▁b": (2, True), "▁c": (1, True)}
