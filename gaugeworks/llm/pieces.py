"""SentencePiece encoding and decoding by batched Viterbi in numpy.

The vocabulary's pieces and scores come from a SentencePiece model file. A text is
escaped as the model says (a space before it, spaces as U+2581) and cut into units, each
a run of U+2581 with what follows up to the next; no piece crosses that border (checked
when the model is read), so units are encoded on their own, distinct ones once.

Units of about equal length advance together, the longest first: hashes of all substrings of a length probe the
sorted keys of that length's pieces; at each end a vectorised maximum over lengths is
stored as a back-pointer. What is maximised depends on the model's type:

* unigram: the sum of scores; of equal sums the longest last piece. Scores are exact in
  float64.
* merges (BPE): a step counts as possible or not. Replaying merges splits a text into a
  sequence if and only if it splits the text of every two neighbours into these two, and
  each piece's text into that piece; each prefix has just one such last piece. So the
  maximum is over "neighbours agree", and ids equal those of replayed merges. Answers
  for pairs are kept in a bounded table. Units that begin with several U+2581, whose
  pieces have equal scores, are replayed.

A code point that is no piece of its own is spelled in byte pieces.

Defined cases: null text is empty text, no ids; U+2581 in a text decodes as a space;
repeated rows get a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdCache, blocks, id_type, mix, power_tables, text_buffers

SPACE = "▁"
BPE = 2  # the model type of merges, as the file format numbers it
PAIR_SLOTS = 1 << 20
CELLS = 1 << 19  # most code points of one batch of units
CLOSE = 9  # units shorter than this go in a batch of their own


def _hashes(points: np.ndarray) -> np.ndarray:
    """Prefix sums (one more column than points) from which substrings are hashed."""
    up, _ = power_tables(points.shape[-1])
    sums = np.zeros((*points.shape[:-1], points.shape[-1] + 1), np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * up, axis=-1, out=sums[..., 1:])
    return sums


def _substrings(sums: np.ndarray, size: int) -> np.ndarray:
    n = sums.shape[-1] - size
    _, down = power_tables(sums.shape[-1])
    return mix((sums[..., size:] - sums[..., :n]) * down[:n] + np.uint64(size))


def model_type(path: str) -> int:
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model.trainer_spec.model_type


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = []  # what each id decodes to
        self.byte_ids = np.full(256, model.unk_id(), np.uint32)
        by_length: dict[int, list[tuple[str, float, int]]] = {}
        least = 0.0
        for k in range(model.vocab_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_ids[int(piece[3:5], 16)] = k
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.bytes.append(b"")
            else:
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError("a piece crosses the border of words")
                self.bytes.append(piece.replace(SPACE, " ").encode())
                by_length.setdefault(len(piece), []).append((piece, model.get_score(k), k))
                least = min(least, model.get_score(k))
        self.unknown = least - 10.0
        self.tables = {}
        for size, rows in sorted(by_length.items()):
            texts, scores, ids = zip(*rows, strict=True)
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(-1, size)
            keys = _substrings(_hashes(points), size)[:, 0]
            order = np.argsort(keys)
            self.tables[size] = keys[order], np.array(scores, np.float64)[order], np.array(ids, np.int64)[order]
        self.cache = IdCache()
        self.merges = model_type(path) == BPE
        self.scores = {model.id_to_piece(k): model.get_score(k) for k in range(model.vocab_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))}
        self.texts = [model.id_to_piece(k) for k in range(model.vocab_size())]
        self.ids = {t: k for k, t in enumerate(self.texts) if t in self.scores}
        self.whole = np.array([t in self.scores and self.replay(t) == [t] for t in self.texts]) if self.merges else None
        self.pair_keys = np.full(PAIR_SLOTS, -1, np.int64)
        self.pair_fits = np.zeros(PAIR_SLOTS, bool)

    def replay(self, text: str) -> list[str]:
        """Merge the neighbours whose union scores highest, the leftmost first, until none is a piece.

        Candidates wait in a heap; links to living neighbours tell which are still there, so a
        text of n characters takes n log n steps.
        """
        parts, n, score = list(text), len(text), self.scores.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(-s, i, text[i : i + 2]) for i in range(n - 1) if (s := score(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = right[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            after = right[i] = right[j]
            if after < n:
                left[after] = i
                if (s := score(both + parts[after])) is not None:
                    heapq.heappush(heap, (-s, i, both + parts[after]))
            before = left[i]
            if before >= 0 and (s := score(parts[before] + both)) is not None:
                heapq.heappush(heap, (-s, before, parts[before] + both))
        return [p for p in parts if p]

    def _agree(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each two neighbouring pieces stay apart when merges are replayed; -1 is an unknown code point."""
        fits = np.ones(len(left), bool)
        known = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[known] * len(self.texts) + right[known]
        slots = (mix(keys.astype(np.uint64)) & np.uint64(PAIR_SLOTS - 1)).astype(np.int64)
        while True:
            missed = np.flatnonzero(self.pair_keys[slots] != keys)
            if len(missed) == 0:
                break
            fresh, first = np.unique(slots[missed], return_index=True)  # one key a slot at a time
            done = missed[first]
            for k, slot in zip(keys[done].tolist(), fresh.tolist(), strict=True):
                a, b = self.texts[k // len(self.texts)], self.texts[k % len(self.texts)]
                self.pair_keys[slot], self.pair_fits[slot] = k, self.replay(a + b) == [a, b]
            answered = known[self.pair_keys[slots] == keys]
            fits[answered] = self.pair_fits[slots[self.pair_keys[slots] == keys]]
            rest = self.pair_keys[slots] != keys
            known, keys, slots = known[rest], keys[rest], slots[rest]
        fits[known] = self.pair_fits[slots]
        return fits

    def _probe(self, sums: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Score (-inf if there is none) and id of each substring."""
        found = _substrings(sums, size)
        if size not in self.tables:
            return np.full(found.shape, -np.inf), np.full(found.shape, -1, np.int64)
        keys, scores, ids = self.tables[size]
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        hit = keys[at] == found
        return np.where(hit, scores[at], -np.inf), np.where(hit, ids[at], -1)

    def _by_scores(self, probes: dict, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = probes[1][0]
        one[np.isneginf(one)] = self.unknown
        rows, n = live[0], len(live) - 1
        best = np.full((rows, n + 1), -np.inf)
        best[:, 0] = 0
        back, last = np.zeros((rows, n + 1), np.int64), np.full((rows, n + 1), -1, np.int64)
        order = sorted(probes, reverse=True)  # the first maximum is the longest piece
        for end in range(1, n + 1):
            fit = [s for s in order if s <= end]
            reach = np.stack([best[:, end - s] + probes[s][0][:, end - s] for s in fit])
            pick = reach.argmax(axis=0)
            best[:, end] = reach[pick, np.arange(rows)]
            back[:, end] = np.array(fit)[pick]
            last[:, end] = np.stack([probes[s][1][:, end - s] for s in fit])[pick, np.arange(rows)]
        return back, last

    def _by_merges(self, probes: dict, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, n = live[0], len(live) - 1
        last = np.full((rows, n + 1), -1, np.int64)  # last piece of each prefix
        back = np.zeros((rows, n + 1), np.int64)
        for end in range(1, n + 1):
            open_rows = np.arange(live[end])
            for s in sorted((s for s in probes if s <= end), reverse=True):
                piece = probes[s][1][open_rows, end - s]
                able = self.whole[np.maximum(piece, 0)] & (piece >= 0)
                if s == 1:
                    able |= piece < 0
                own, piece = open_rows[able], piece[able]
                if len(own) == 0:
                    continue
                if end > s:
                    fits = self._agree(last[own, end - s], piece)
                    own, piece = own[fits], piece[fits]
                back[own, end], last[own, end] = s, piece
                open_rows = open_rows[back[open_rows, end] == 0]
                if len(open_rows) == 0:
                    break
            if len(open_rows):
                raise ValueError("a prefix without a last piece")
        return back, last

    def viterbi(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids) of units, rows of ``points``, the longest first; what follows a unit in its row counts for nothing."""
        rows, n = points.shape
        live = np.searchsorted(-lengths, -np.arange(n + 1), "right")  # rows that reach each end
        sums = _hashes(points)
        sizes = [s for s in self.tables if s <= n]
        if 1 not in sizes:
            sizes.insert(0, 1)
        probes = {s: self._probe(sums, s) for s in sizes}
        back, last = self._by_merges(probes, live) if self.merges else self._by_scores(probes, live)
        chosen = np.full((rows, n), -2, np.int64)  # id of the piece that starts there; -1: bytes
        at, own = lengths.copy(), np.arange(rows)
        while len(own):
            end = at[own]
            at[own] = end - back[own, end]
            chosen[own, at[own]] = last[own, end]
            own = own[at[own] > 0]
        row, place = np.nonzero(chosen != -2)
        ids = chosen[row, place]
        spelled = np.flatnonzero(ids == -1)
        if len(spelled):
            parts = [self.byte_ids[list(chr(c).encode())] for c in points[row[spelled], place[spelled]].tolist()]
            sizes = np.ones(len(ids), np.int64)
            sizes[spelled] = list(map(len, parts))
            first = (np.cumsum(sizes) - sizes)[spelled]
            ids, row = np.repeat(ids, sizes), np.repeat(row, sizes)
            ids[np.concatenate([np.arange(a, a + len(p)) for a, p in zip(first.tolist(), parts, strict=True)])] = np.concatenate(parts)
        return ids.astype(np.uint32), np.bincount(row, minlength=rows)

    def _learn(self, keys: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if self.merges:
            runs = (ends - starts > 1) & (points[starts] == ord(SPACE)) & (points[np.minimum(starts + 1, len(points) - 1)] == ord(SPACE))
            for k in np.flatnonzero(runs).tolist():
                parts = self.replay(points[starts[k] : ends[k]].tobytes().decode("utf-32-le"))
                ids = np.concatenate([[self.ids[t]] if t in self.ids else self.byte_ids[list(t.encode())] for t in parts]).astype(np.uint32)
                self.cache.add(keys[k : k + 1], ids, np.array([len(ids)]))
            keys, starts, ends = keys[~runs], starts[~runs], ends[~runs]
        order = np.argsort(starts - ends, kind="stable")
        keys, starts, lengths = keys[order], starts[order], (ends - starts)[order]
        at = 0
        while at < len(keys):
            n = int(lengths[at])
            least = min(n, max(CLOSE, n - n // 4) if n >= CLOSE else 1)  # units nearly as long go along
            end = min(int(np.searchsorted(-lengths, -least, "right")), at + max(1, CELLS // n))
            part = starts[at:end, None] + np.arange(n)
            ids, sizes = self.viterbi(points[np.minimum(part, len(points) - 1)], lengths[at:end])
            self.cache.add(keys[at:end], ids, sizes)
            at = end

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        escaped = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        points = np.frombuffer("".join(escaped).encode("utf-32-le"), np.uint32)
        bounds = np.cumsum([0, *map(len, escaped)])
        if len(points) == 0:
            return [np.zeros(0, np.uint32) for _ in texts]
        mark = points == ord(SPACE)
        first = mark.copy()
        first[1:] &= ~mark[:-1]
        first[bounds[:-1][bounds[:-1] < len(points)]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(points))
        sums = _hashes(points)
        _, down = power_tables(len(points) + 1)
        keys = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        distinct, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        new = self.cache.missing(distinct)
        if len(new):
            self._learn(distinct[new], points, starts[at[new]], ends[at[new]])
        ids, total = self.cache.gather(distinct, inverse)
        cut = total[np.searchsorted(starts, bounds)]
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(df: DataFrame, id_col: str, text_col: str, model: str) -> DataFrame:
    """(id, ids): the piece ids of each row's text."""

    def run(batches):
        codec = pieces(model)
        for batch in batches:
            offsets, raw = text_buffers(batch.column(1))
            for lo, hi in blocks(offsets):
                texts = [raw[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(lo, hi)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([x.astype(np.int32) for x in codec.encode(texts)], pa.list_(pa.int32()))], names=["id", "ids"])

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_type(df, id_col)}, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(id, text) of (id, ids)."""

    def run(batches):
        codec = pieces(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x.values.to_numpy()) for x in batch.column(1)], pa.string())], names=["id", "text"])

    return encoded.mapInArrow(run, f"id {id_type(encoded, 'id')}, text string")


def round_trip(df: DataFrame, id_col: str, text_col: str, model: str) -> DataFrame:
    """(id, n_ids, ids_sha256, decoded_sha256, exact): each text encoded and decoded again.

    Ids are hashed as little-endian 32-bit integers.
    """

    def run(batches):
        codec = pieces(model)
        for batch in batches:
            offsets, raw = text_buffers(batch.column(1))
            for lo, hi in blocks(offsets):
                texts = [raw[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(lo, hi)]
                rows = []
                for t, ids in zip(texts, codec.encode(texts), strict=True):
                    back = codec.decode(ids)
                    rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == t))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=["id", "n_ids", "ids_sha256", "decoded_sha256", "exact"])

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_type(df, id_col)}, n_ids long, ids_sha256 string, decoded_sha256 string, exact boolean")
