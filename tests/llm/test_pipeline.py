"""The pipeline's stages: columns, decisions, and the rows against a brute-force version."""

import re
import zlib

import numpy as np

import corpus_pipeline
from gaugeworks.llm import ngram_join, packing, secrets
from gaugeworks.llm.common import documents, vocabulary_path

from .test_operators import SF, brute_components


def test_stages_against_brute_force(spark):
    docs = documents(spark, SF)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {d: t for d, t in rows.items() if any(map(str.isalpha, t or ""))}
    top = {}
    for d, t in want.items():
        top[t] = max(d, top.get(t, d))
    want = {d: t for d, t in want.items() if top[t] == d}
    comp = brute_components(list(want.items()), 5, 80, 100)
    want = {d: t for d, t in want.items() if comp[d][1] == d or comp[d][0] == 0}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
        assert docs.columns == documents(spark, SF).columns, name
    assert {r["doc_id"] for r in docs.collect()} == set(want)
    masked = corpus_pipeline.mask_secrets(spark, docs, SF)
    assert masked.columns == docs.columns
    texts = {r["doc_id"]: r for r in masked.collect()}
    assert set(texts) == set(want)
    for d, r in texts.items():
        assert r["n_chars"] == len(r["text"])
        assert not re.search(secrets.ACCESS, r["text"]) and not re.search(secrets.HEX, r["text"])
        if not re.search(secrets.ASSIGN + "|" + secrets.ACCESS + "|" + secrets.HEX + "|" + secrets.IDENT + "|" + secrets.TOKEN + "|" + secrets.ENDPOINT, want[d]):
            assert r["text"] == want[d]
    packed = corpus_pipeline.pack(spark, masked, SF).collect()
    enc = packing.encoder(vocabulary_path())
    for d, r in texts.items():
        ids = [*enc.tokenizer.encode(r["text"], add_special_tokens=False).ids, 0]
        own = sorted((p["start"], p["length"], p["ids_crc32"]) for p in packed if p["doc_id"] == d)
        assert sum(p[1] for p in own) == len(ids)
        for start, length, crc in own:
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())


def test_run_is_the_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact_copies", "near_copies", "mask_secrets", "pack"]
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert ngram_join.Rule(5, 80, 100).distance(180) == 20
