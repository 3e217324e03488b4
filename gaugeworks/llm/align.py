"""Alignment of two tokenizers' tokens over the bytes of each text.

Both encode a space and the text: A a byte-level BPE file, B a SentencePiece model that adds
the space itself. Byte offsets where a token of A and one of B both end cut the two sequences
into groups; two tokens whose byte ranges overlap are linked.

Within ``mapInPandas`` the two increasing sequences of token ends are merged, all texts of a
block at once: each distinct end closes one stretch of bytes that lies in exactly one token
of either side, so it makes one link, and ends of both sides close a group. Links are folded
to distinct pairs of ids, numbered within the block; a block's row holds its documents'
figures, its pairs with their counts, and which pairs each document has how often.

Spark then sums the counts by pair, takes the highest of each side-B id, and joins both back
to the pairs of blocks. That join moves one row for each pair and block, not for each link,
and pairs that many blocks have are joined apart (``join_groups``).

Words are encoded once a worker and kept up to a bound. Texts are worked off in parts of about
``PART_CHARS`` characters, cut at single spaces between ASCII letters or digits, where tokens of
both sides always end; only a text without such a place is one part, however long.

Defined cases: a text that is null or empty, or whose tokens' bytes on either side differ
from the space and the text (a literal U+2581, for one), has no tokens: zeros and an empty
digest; special tokens' strings are plain text; repeated rows get a row each and count each; a
null id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdCache, id_type, join_groups, materialize, mix, power_tables
from .packing import Encoder

PART_CHARS = 1 << 19
#: Characters of the texts of a block, but for its last text.
BLOCK_CHARS = 1 << 20
SPACE = "▁"


# ------------------------------------------------------------------ token bytes


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, for the
    characters from U+0100 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Table:
    """Bytes and decimal digits of each id."""

    def __init__(self, entries: list[bytes]):
        self.widths = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.widths) - self.widths
        self.raw = np.frombuffer(b"".join(entries), np.uint8)
        self.size = len(entries)
        cells = max(1, len(str(max(self.size - 1, 0))))
        shown = b"".join(str(k).encode().ljust(cells + 1, b"\0") for k in range(self.size))
        self.digits = np.frombuffer(shown, np.uint8).reshape(self.size, cells + 1)
        self.lengths = np.array([len(str(k)) for k in range(self.size)], np.int64)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.widths[ids]
        before = np.cumsum(sizes) - sizes
        return self.raw[np.repeat(self.starts[ids] - before, sizes) + np.arange(int(sizes.sum()))]


def _entries(count: int, pairs) -> list[bytes]:
    out = [b""] * count
    for k, entry in pairs:
        out[k] = entry
    return out


class ByteSide:
    """Side A: a tokenizers file with a byte-level vocabulary."""

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        alphabet = byte_alphabet()
        vocabulary = self.encoder.tokenizer.get_vocab(with_added_tokens=True)
        known = ((k, bytes(alphabet[c] for c in t)) for t, k in vocabulary.items() if all(c in alphabet for c in t))
        self.table = Table(_entries(max(vocabulary.values(), default=-1) + 1, known))

    def encode(self, parts: list[str]) -> list[np.ndarray]:
        return self.encoder.encode(parts)


class PieceSide:
    """Side B: a SentencePiece model; runs of spaces with the word behind them are encoded once."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table = Table([self._bytes(k) for k in range(self.model.vocab_size())])
        self.cache = IdCache()
        inner = (self.model.id_to_piece(k).lstrip(SPACE) for k in range(self.model.vocab_size()))
        self.by_words = all(SPACE not in piece for piece in inner)  # no piece crosses from a word into the next space

    def _bytes(self, k: int) -> bytes:
        piece = self.model.id_to_piece(k)
        if self.model.is_byte(k):
            return bytes([int(piece[3:5], 16)])
        if self.model.is_control(k) or self.model.is_unknown(k) or self.model.is_unused(k):
            return b""
        return piece.replace(SPACE, " ").encode()

    def encode(self, parts: list[str]) -> list[np.ndarray]:
        """``parts`` begin with the space that the model adds."""
        if not self.by_words:
            return [np.array(x, np.uint32) for x in self.model.encode([p[1:] for p in parts], num_threads=1)]
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.cumsum([0, *map(len, parts)])
        if len(points) == 0:
            return [np.zeros(0, np.uint32) for _ in parts]
        first = points == 0x20
        first[1:] &= points[:-1] != 0x20
        first[bounds[:-1][bounds[:-1] < len(points)]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(points))
        up, down = power_tables(len(points))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        keys = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        distinct, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        new = self.cache.missing(distinct)
        if len(new):
            whole = points.tobytes()
            units = [whole[4 * starts[k] + 4 : 4 * ends[k]].decode("utf-32-le", "surrogatepass") for k in at[new]]
            found = [x if u else [self.model.piece_to_id(SPACE)] for u, x in zip(units, self.model.encode(units, num_threads=1), strict=True)]  # no space is added to an empty text
            self.cache.add(distinct[new], np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64))
        ids, total = self.cache.gather(distinct, inverse)
        cut = total[np.searchsorted(starts, bounds)]
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


@lru_cache(2)
def sides(a_path: str, b_path: str) -> tuple[ByteSide, PieceSide]:
    return ByteSide(a_path), PieceSide(b_path)


# ------------------------------------------------------------------ merging token ends


def parts_of(text: str) -> Iterator[str]:
    """A space and the text, cut into parts that begin with a space and are encoded apart."""
    text, at = " " + text, 0
    while len(text) - at > PART_CHARS:
        end, cut = at + PART_CHARS, -1
        while end < len(text) and cut < 0:
            k = text.rfind(" ", at + 1, end)
            while k > at:
                near = text[k - 1] + text[k + 1]
                if near.isascii() and near.isalnum():
                    cut = k
                    break
                k = text.rfind(" ", at + 1, k)
            end += PART_CHARS
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class Merged:
    """The merge of some parts; part k has n_a[k], n_b[k], n_groups[k], whether ``fits[k]``, and ``shown[k]``.

    ``part``, ``pair``, ``times``: distinct pairs (A id times size of B, plus B id) of each part.
    """

    def __init__(self, parts: list[str], a: ByteSide, b: PieceSide):
        raws = [p.encode("utf-8", "surrogatepass") for p in parts]
        ids_a, ids_b = a.encode(parts), b.encode(parts)
        self.fits = np.array([a.table.joined(x).tobytes() == raw and b.table.joined(y).tobytes() == raw for x, y, raw in zip(ids_a, ids_b, raws, strict=True)], bool)
        none = np.zeros(0, np.uint32)
        ids_a = [x if ok else none for x, ok in zip(ids_a, self.fits, strict=True)]
        ids_b = [y if ok else none for y, ok in zip(ids_b, self.fits, strict=True)]
        self.n_a, self.n_b = np.array([len(x) for x in ids_a], np.int64), np.array([len(y) for y in ids_b], np.int64)
        one, two = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (ids_a, ids_b))
        end_a, end_b = np.cumsum(a.table.widths[one]), np.cumsum(b.table.widths[two])
        # two pointers: how far the other side has come when a token ends
        in_b, in_a = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)
        both_a = end_b[np.minimum(in_b, max(len(end_b) - 1, 0))] == end_a if len(end_b) else np.zeros(0, bool)
        both_b = np.zeros(len(end_b), bool)
        both_b[in_b[both_a]] = True
        part_a, part_b = np.repeat(np.arange(len(parts)), self.n_a), np.repeat(np.arange(len(parts)), self.n_b)
        self.n_groups = np.bincount(part_a[both_a], minlength=len(parts))
        self.shown = self._render(one, two, both_a, both_b, a.table, b.table)
        only_b = np.flatnonzero(~both_b)
        part = np.concatenate([part_a, part_b[only_b]])
        pair = np.concatenate([one * b.table.size + two[in_b], one[in_a[only_b]] * b.table.size + two[only_b]])
        self.part, self.pair, self.times = folded(part, pair, np.ones(len(pair), np.int64))

    def _render(self, one, two, both_a, both_b, table_a: Table, table_b: Table) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each part."""
        group_a, group_b = np.cumsum(both_a) - both_a, np.cumsum(both_b) - both_b
        ends_a, ends_b = np.flatnonzero(both_a) + 1, np.flatnonzero(both_b) + 1  # tokens up to each group
        place_a = np.arange(len(one)) + np.append(0, ends_b)[group_a]
        place_b = np.arange(len(two)) + (ends_a[group_b] if len(two) else 0)
        width = max(table_a.digits.shape[1], table_b.digits.shape[1])
        cells = np.zeros((len(one) + len(two), width), np.uint8)
        for place, ids, table, both, last in ((place_a, one, table_a, both_a, b"|"), (place_b, two, table_b, both_b, b";")):
            cells[place, : table.digits.shape[1]] = table.digits[ids]
            cells[place, table.lengths[ids]] = np.where(both, last[0], b","[0])
        flat = cells.ravel()
        shown = flat[flat != 0]
        sizes = np.append(0, np.cumsum((cells != 0).sum(axis=1)))
        bounds = sizes[np.append(0, np.cumsum(self.n_a + self.n_b))]
        return [shown[lo : max(lo, hi - 1)].tobytes() for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]


def folded(group: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, pair) in order, with the sum of their times."""
    if len(pair) == 0:
        return group, pair, times
    order = np.lexsort((pair, group)) if int(group.max()) >= 1 << 31 or int(pair.max()) >= 1 << 32 else np.argsort((group << 32) | pair)
    group, pair, times = group[order], pair[order], times[order]
    first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (pair[1:] != pair[:-1])))
    return group[first], pair[first], np.add.reduceat(times, first)


# ------------------------------------------------------------------ documents and blocks


class _Document:
    """Sums over the parts of one text."""

    def __init__(self, name: str | None):
        self.name, self.fits, self.n_a, self.n_b, self.n_groups, self.digest, self.pairs = name, True, 0, 0, 0, hashlib.sha256(), []

    def add(self, merged: Merged, k: int) -> None:
        self.fits &= bool(merged.fits[k])
        if self.n_groups:
            self.digest.update(b";")
        self.digest.update(merged.shown[k])
        self.n_a, self.n_b, self.n_groups = self.n_a + int(merged.n_a[k]), self.n_b + int(merged.n_b[k]), self.n_groups + int(merged.n_groups[k])
        lo, hi = np.searchsorted(merged.part, [k, k + 1])
        self.pairs.append((merged.pair[lo:hi], merged.times[lo:hi]))

    def close(self) -> tuple:
        if not self.fits or self.n_a == 0:
            return self.name, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair, times = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
        if len(self.pairs) > 1:
            _, pair, times = folded(np.zeros(len(pair), np.int64), pair, times)
        return self.name, self.n_a, self.n_b, self.n_groups, self.digest.hexdigest(), pair, times


def documents_of(names, texts, a: ByteSide, b: PieceSide) -> Iterator[tuple[tuple, int]]:
    """(name, n_a, n_b, n_groups, digest, pairs, times) of each text, and its characters."""
    waiting: list[tuple[_Document, str]] = []  # parts not merged yet
    ready: list[tuple[_Document, int]] = []  # documents whose last part waits

    def flush():
        if waiting:
            merged = Merged([p for _, p in waiting], a, b)
            for k, (doc, _) in enumerate(waiting):
                doc.add(merged, k)
            waiting.clear()
        for doc, chars in ready:
            yield doc.close(), chars
        ready.clear()

    chars = 0
    for name, text in zip(names, texts, strict=True):
        doc = _Document(name)
        for part in parts_of(text) if text else ():
            waiting.append((doc, part))
            chars += len(part)
            if chars >= PART_CHARS:
                yield from flush()
                chars = 0
        ready.append((doc, len(text or "")))
    yield from flush()


BLOCK = "block long, names array<string>, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, sizes array<int>, locals binary, times binary, pairs array<long>, counts array<long>"


def _block(number: int, docs: list[tuple]) -> dict:
    names, n_a, n_b, n_groups, digests, pairs, times = zip(*docs, strict=True)
    sizes = np.array([len(x) for x in pairs], np.int32)
    pair, many = np.concatenate(pairs), np.concatenate(times)
    distinct, local = np.unique(pair, return_inverse=True)
    counts = np.bincount(local, weights=many, minlength=len(distinct)).astype(np.int64)
    step = np.diff(local, prepend=0)  # small and positive within a document
    return {
        "block": number, "names": list(names), "n_a": list(n_a), "n_b": list(n_b), "n_groups": list(n_groups), "digests": list(digests), "sizes": sizes,
        "locals": _packed(step), "times": _packed(many), "pairs": distinct, "counts": counts,
    }


def _packed(numbers: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<i4").tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<i4").astype(np.int64)


def blocks(df: DataFrame, id_col: str, text_col: str, a_path: str, b_path: str) -> DataFrame:
    """The merged blocks, written once."""

    def run(frames):
        a, b = sides(a_path, b_path)
        for frame in frames:
            docs, chars, number = [], 0, iter(frame["item"].tolist())
            first = None
            for (doc, size), item in zip(documents_of(frame["name"].tolist(), frame["text"].tolist(), a, b), number, strict=True):
                first = item if first is None else first
                docs.append(doc)
                chars += size
                if chars >= BLOCK_CHARS:
                    yield pd.DataFrame([_block(first, docs)])
                    docs, chars, first = [], 0, None
            if docs:
                yield pd.DataFrame([_block(first, docs)])

    rows = df.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{id_col}`").cast("string").alias("name"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return materialize(rows.mapInPandas(run, BLOCK), "align-blocks")


def pair_counts(merged: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, parts, best): links of each pair in all texts, blocks that have it, and whether no pair of its B id has more."""
    each = merged.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("x.pairs", "x.counts")
    counts = materialize(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n"), F.count("*").alias("parts")), "align-counts")
    top = counts.groupBy(F.pmod("pair", F.lit(b_size)).alias("b")).agg(F.max("n").alias("top"))  # a row for each entry of B at most
    found = counts.withColumn("b", F.pmod("pair", F.lit(b_size))).join(top, "b")
    return found.select("pair", "n", "parts", (F.col("n") == F.col("top")).alias("best"))


def links(counts: DataFrame, b_size: int) -> DataFrame:
    """(a, b, n, best) of ``pair_counts``: how often each two ids are linked."""
    return counts.select(F.expr(f"cast(pair div {b_size} as int)").alias("a"), F.pmod("pair", F.lit(b_size)).cast("int").alias("b"), "n", "best")


ROW = "name string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(df: DataFrame, id_col: str, text_col: str, a_path: str, b_path: str) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each input row."""
    import sentencepiece

    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()
    merged = blocks(df, id_col, text_col, a_path, b_path)
    counts = materialize(pair_counts(merged, b_size), "align-pairs")
    local = merged.select("block", F.posexplode("pairs").alias("local", "pair"))
    total = counts.agg(F.sum("parts")).first()[0] or 0
    found = join_groups(local, counts, "pair", "parts", total)
    answers = found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("local", "n", "best"))).alias("all"))  # at most the pairs of one block
    answers = answers.select("block", F.transform("all", lambda x: x["n"]).alias("n"), F.transform("all", lambda x: x["best"]).alias("best"))
    columns = ["names", "n_a", "n_b", "n_groups", "digests", "sizes", "locals", "times"]
    joined = merged.select("block", *columns).join(answers, "block", "left").select(*columns, "n", "best")

    def run(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                sizes = np.asarray(row.sizes, np.int64)
                out = {"name": list(row.names), "n_a": row.n_a, "n_b": row.n_b, "n_groups": row.n_groups}
                owner = np.repeat(np.arange(len(sizes)), sizes)
                many, at = _unpacked(row.times), np.cumsum(_unpacked(row.locals))
                n, best = (np.asarray(x if x is not None else [], t) for x, t in ((row.n, np.int64), (row.best, bool)))

                def summed(values, owner=owner, count=len(sizes)):
                    total = np.zeros(count, np.int64)
                    np.add.at(total, owner, values)
                    return total

                out |= {"n_links": summed(many), "n_best": summed(many * best[at]), "count_sum": summed(many * n[at]), "groups_sha256": list(row.digests)}
                yield pd.DataFrame(out)

    found = joined.mapInPandas(run, ROW)
    return found.select(F.col("name").cast(id_type(df, id_col)).alias("id"), *[c.split()[0] for c in ROW.split(", ")[1:]])
