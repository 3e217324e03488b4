"""Best-fit packing of token sequences with lower-bound certificates.

Tokenising: texts are split at the tokenizer's own word pattern by numpy (classes of
code points, a block of texts at once); each distinct word is encoded once in a worker
by the tokenizer, which keeps a bounded number of them; ids are gathered from
there. Texts with code points outside the table go through the tokenizer whole.

Packing: pieces of full length are sequences. The rest is dealt into partitions of
about ``PART_ITEMS`` pieces, each packed by best-fit decreasing. Dual feasible
functions bound the bins a partition needs; where the bound is met, the partition is
certified and only its emptiest bin goes on, else (a gap) all its bins that aren't
full do. What goes on is dealt into new partitions, so documents of different
partitions meet, and best-fit decreasing runs again; the fewer bins stay. Rounds end
when one partition holds all that is left, or when a round over several partitions needs as
many bins as before; there is no other limit to their number.

Defined cases: null text is empty text (one end token); repeated rows are packed one
by one; equal lengths go by row number; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, IdCache, blocks, id_type, materialize, mix, power_tables, text_buffers

END = 0
PART_ITEMS = 1 << 16

# ------------------------------------------------------------------ tokenising

LETTER, NUMBER, SPACE, OTHER, UNSURE = range(5)
#: Code points whose classes are the same in all Unicode versions in use.
SURE = ((0x00, 0x1C), (0x20, 0x0250), (0x0370, 0x0378), (0x0384, 0x0386), (0x0386, 0x038B), (0x038E, 0x03A2), (0x03A3, 0x0528), (0x2000, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20BD))


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point below 0x10000; all others are UNSURE."""
    import regex

    table = np.full(0x10001, UNSURE, np.uint8)
    for lo, hi in SURE:
        for k in range(lo, hi):
            c = chr(k)
            table[k] = LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else SPACE if c.isspace() else OTHER
    return table


def word_starts(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the words of texts begin, by the byte-level pattern.

    The pattern, as fixed by the vocabulary: contractions 's 't 're 've 'm 'll 'd; runs
    of letters, of numbers or of other marks, each with a space before it; white space
    runs, which leave their last character to what follows.
    """
    n = len(points)
    kind = classes()[np.minimum(points, 0x10000)]
    head = np.zeros(n + 1, bool)
    head[bounds[:-1][bounds[:-1] < n]] = True
    start = head[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    last = np.zeros(n, bool)  # the last white space before something else of the same text
    last[:-1] = space[:-1] & ~space[1:] & ~head[1:n]
    start |= last
    joined = np.flatnonzero(last & (points == 0x20))
    run_first = start & (kind == OTHER) & (points == 0x27)
    start[joined + 1] = False
    at = np.flatnonzero(run_first & start)
    ends = bounds[np.searchsorted(bounds, at, "right")]
    at, ends = at[at + 1 < ends], ends[at + 1 < ends]
    one = points[at + 1]
    two = np.where(at + 2 < ends, points[np.minimum(at + 2, n - 1)], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    hit = short | long
    at, size = at[hit], np.where(short[hit], 2, 3)
    start[at + 1] = False
    after = at + size
    start[after[after < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of many texts at once; words are encoded once and kept up to a bound."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.widths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # bytes of each id
        for token, k in vocabulary.items():
            self.widths[k] = len(token)
        self.cache = IdCache()

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each).

        Words of a space and letters split from one another as they do alone, so they are
        encoded as one text; byte widths tell which ids are whose.
        """
        plain = np.array([w[0] == " " and w[1:].isalpha() for w in words], bool)
        sizes, parts = np.zeros(len(words), np.int64), [None] * len(words)
        odd = np.flatnonzero(~plain)
        for i, e in zip(odd, self.tokenizer.encode_batch([words[i] for i in odd], add_special_tokens=False), strict=True):
            parts[i] = np.array(e.ids, np.uint32)
            sizes[i] = len(e.ids)
        picked = np.flatnonzero(plain)
        for at in range(0, len(picked), 4096):
            own = picked[at : at + 4096]
            ids = np.array(self.tokenizer.encode("".join([words[i] for i in own]), add_special_tokens=False).ids, np.uint32)
            ends = np.cumsum([len(words[i].encode()) for i in own])
            cuts = np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1
            sizes[own] = np.diff(cuts, prepend=0)
            for i, x in zip(own, np.split(ids, cuts[:-1]), strict=True):
                parts[i] = x
        return np.concatenate(parts), sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        bounds = np.cumsum([0, *map(len, texts)])
        unsure = np.concatenate([[0], np.cumsum(classes()[np.minimum(points, 0x10000)] == UNSURE)])
        odd = np.flatnonzero(unsure[bounds[1:]] > unsure[bounds[:-1]])
        for i, e in zip(odd, self.tokenizer.encode_batch([texts[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        if len(points) == 0:
            return [x if x is not None else np.zeros(0, np.uint32) for x in out]
        starts = word_starts(points, bounds)
        ends = np.append(starts[1:], len(points))
        sums = np.zeros(len(points) + 1, np.uint64)
        up, down = power_tables(len(points))
        np.cumsum(_codes()[np.minimum(points, 0x10000)] * up, out=sums[1:])
        keys = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        new = self.cache.missing(distinct)
        if len(new):
            whole = points.tobytes()
            self.cache.add(distinct[new], *self._ids([whole[4 * starts[k] : 4 * ends[k]].decode("utf-32-le") for k in first[new]]))
        ids, total = self.cache.gather(distinct, inverse)
        cut = total[np.searchsorted(starts, bounds)]
        return [ids[cut[i] : cut[i + 1]] if x is None else x for i, x in enumerate(out)]


@lru_cache(1)
def _codes() -> np.ndarray:
    return mix(np.arange(1, 0x10002, dtype=np.uint64))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(df: DataFrame, id_col: str, text_col: str, vocabulary: str, limit: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32, item) of each row's ids and end token, cut at ``limit``."""

    def cut(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            offsets, raw = text_buffers(batch.column(1))
            for lo, hi in blocks(offsets, BLOCK_BYTES):
                texts = [raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in range(lo, hi)]
                rows = []
                for i, ids in enumerate(enc.encode(texts)):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    first = (len(ids) - 1) % limit + 1
                    marks = [0, *range(first, len(ids) + 1, limit)]
                    rows += [(lo + i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(marks, marks[1:], strict=False))]
                own, *rest = zip(*rows, strict=True)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), *(pa.array(x, t) for x, t in zip(rest, kinds, strict=True))], names=["id", "piece", "start", "length", "ids_crc32"])

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = rows.mapInArrow(cut, f"id {id_type(df, id_col)}, piece int, start long, length long, ids_crc32 long")
    return found.withColumn("item", F.monotonically_increasing_id())


# ------------------------------------------------------------------ bounds and bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of several dual feasible functions: no packing has fewer bins."""
    if len(lengths) == 0:
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    n, w = np.append(0, np.cumsum(count)), np.append(0, np.cumsum(count * size))
    best = -(-int(w[-1]) // capacity)
    cut = np.arange(1, capacity // 2 + 1)  # sizes under the cut count 0, those over capacity - cut a bin
    whole = n[-1] - n[capacity - cut + 1]
    best = max(best, int((whole + -(-(w[capacity - cut + 1] - w[cut]) // capacity)).max()))
    for k in range(1, 65):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, by best-fit decreasing; equal lengths in given order."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, made = 0, 0  # bit r of mask: a bin has r tokens of room
    for i in order.tolist():
        size = int(lengths[i])
        fit = mask >> size
        if fit:
            room = (fit & -fit).bit_length() - 1 + size
            b = open_bins[room].pop()
            if not open_bins[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - room
        if room > size:
            open_bins[room - size].append(b)
            mask |= 1 << (room - size)
    return bins, offsets


def repack(part: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pack one partition; columns item, length, bin (of the round before, or -1).

    Adds ``seq`` (number in this partition), ``offset`` and ``open``: whether the
    piece's bin goes on to the next round.
    """
    part = part.sort_values("item", ignore_index=True)
    lengths = part["length"].to_numpy()
    bins, offsets = best_fit(lengths, capacity)
    old = part["bin"].to_numpy()
    if (old >= 0).all() and len(np.unique(old)) < bins.max() + 1:
        bins, offsets = np.unique(old, return_inverse=True)[1], part["offset"].to_numpy()
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    released = np.zeros(len(fill), bool)
    if len(fill) > lower_bound(lengths, capacity):
        released = fill < capacity
    elif fill.min() < capacity:
        released[fill.argmin()] = True
    return part.assign(seq=bins, offset=offsets, open=released[bins])


def pack(found: DataFrame, limit: int) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; the fewest sequences found."""
    found = materialize(found, "pieces")
    # bins are numbered from 0 up, full pieces from -1 down
    whole = found.where(F.col("length") == limit).select("item", F.expr("-1 - item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = found.where(F.col("length") < limit).select("item", "length", F.lit(-1).cast("long").alias("bin"), F.lit(0).cast("long").alias("offset"))
    placed, k, before = [], 0, None
    while True:
        k += 1
        n = left.count()
        groups = max(1, -(-n // PART_ITEMS))
        # all pieces of a bin move together, so the old packing can stay if it is better
        together = F.when(F.col("bin") >= 0, F.col("bin")).otherwise(F.col("item"))
        dealt = left.withColumn("part", F.pmod(F.xxhash64(F.lit(k), together), F.lit(groups)))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return repack(pdf, limit)[["item", "length", "part", "seq", "offset", "open"]]

        done = dealt.groupBy("part").applyInPandas(run, "item long, length long, part long, seq long, offset long, open boolean")
        number = F.lit(k << 48) + F.col("part") * F.lit(1 << 20) + F.col("seq")
        done = materialize(done.select("item", "length", number.alias("bin"), "offset", "open"), "bins")
        final = groups == 1 or (before is not None and done.select("bin").distinct().count() >= before)
        placed.append((done if final else done.where(~F.col("open"))).select("item", F.col("bin").alias("sequence_id"), "offset"))
        if final:
            break
        left = done.where("open").select("item", "length", "bin", "offset")
        before = left.select("bin").distinct().count()
    for part in placed:
        whole = whole.unionByName(part)
    return found.join(whole, "item").drop("item")


def pack_documents(df: DataFrame, id_col: str, text_col: str, vocabulary: str, limit: int = 2048) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(pieces(df, id_col, text_col, vocabulary, limit), limit)
