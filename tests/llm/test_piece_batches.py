"""Units of different lengths are encoded in few batches, with the library's ids."""

import random

import sentencepiece

from gaugeworks.llm import pieces
from gaugeworks.llm.common import vocabulary_path


def test_lengths_share_batches(monkeypatch):
    path = vocabulary_path("piece_bpe_32k.model")
    codec, library = pieces.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng, calls, run = random.Random(9), [], pieces.Pieces.viterbi
    monkeypatch.setattr(pieces.Pieces, "viterbi", lambda self, points, *more: calls.append(points.shape) or run(self, points, *more))
    words = ["".join(rng.choices("etaoinshrdlu漢é☃\x00Z9.", k=n)) for n in range(1, 61) for _ in range(20)]
    rng.shuffle(words)
    texts = [" ".join(words), *words, "\x00", "a\x00", ""]
    got = codec.encode(texts)
    assert [x.tolist() for x in got] == library.encode(texts)
    assert [codec.decode(x) for x in got] == texts
    assert len(calls) <= 15  # 61 lengths
