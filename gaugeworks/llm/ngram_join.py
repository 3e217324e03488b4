"""Exact Jaccard self-join of documents on word n-grams, and its components.

A text's set holds 64-bit hashes of its distinct n-word shingles. Rows with equal sets
are one class; classes are joined, and a class id is 64 bits of a digest of its set.

*Candidates* (universe partition, pigeonhole). Two sets of sizes a and b link only if
their symmetric difference is at most d = floor((a + b)(1 - t) / (1 + t)). Sizes fall into
bands; pairs within a band, or across the border of two, have a scheme with the largest
such d. A scheme cuts the hash universe into d + 1 + spare units. A segment of one unit
takes one from the allowance if the sets differ there and is indexed by its subset; one
of two units takes two if they differ by two, so it is indexed by its subset and by the
subsets with one deletion. By the pigeonhole every linked pair shares an entry.
How many segments get two units is allocated by cost from the counts of the bands: index
rows against expected accidental matches.

A passage that many texts share would make each pair of them meet. So a set is indexed by its
rare shingles first: dropping the frequent ones from all sets makes no symmetric difference
larger, and the pigeonhole holds. Segments that are empty, or would be after a deletion,
match anything and make no entry; a set that has no more units of them than the spare ones
shares an entry with all it links with, however many the other set has. Only sets with more
are indexed by all their shingles too, and if too many segments are still empty, by these.
Frequent shingles are told by counts of hash slots over all texts (lossy counts: a partition
reports slots it met often), so the mark is the same for every text.

*Verification* is exact on whole sets. Before it, a parity bitmap of two to four bits a shingle (their
Hamming distance is a lower bound of the symmetric difference) drops most pairs that
don't link. Only what decides components is verified: first each class against its
nearest fellow among the smallest ids of its index entries; then, of each two
components that still share entries, the closest pair that isn't verified; at
last every remaining pair. Entries with many members are compared in blocks.

Set hashes stand for shingles: 64 bits, so two different shingles of one pair of texts
agree with a chance of about 1e-13 for texts of a thousand words.

Defined cases: a null text, or one without words, has an empty set and links with nothing; a
text with fewer than n words has its whole sequence as one shingle; repeated rows and
equal texts are one class; a null id is ignored as component id unless all are null; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HEAVY_PARTS, blocks, drop_rows, fresh, id_type, join_groups, keep_matching, lean, materialize, mix, release, text_buffers, word_hashes

#: Ratio of a band's largest to its smallest size, as a power of the threshold.
BAND_POWER = 3
#: Share of shingles that unrelated texts are taken to have in common, and the cost of
#: one accidental match in index rows: both only steer the allocation.
COMMON_SHARE, MATCH_COST = 0.02, 0.25
#: Words of the brief bitmap, which goes with every index entry that is compared.
BRIEF = 16
#: Most members of an entry that one task compares at once; more are dealt in blocks.
BLOCK_MEMBERS = 2048
#: Pairs that a batch of blocks gathers before only the closest of two components are kept.
CLOSEST_ROWS = 1 << 20
FILTER_BITS = 1 << 24
#: Slots of shingle counts: so many a row, within these bounds.
SLOTS_A_ROW, SLOTS_LEAST, SLOTS_MOST = 16, 1 << 18, 1 << 24
#: A slot counts as frequent from so many shingles on, and so many times the average.
FREQUENT, FREQUENT_TIMES = 64, 8
#: Fewest shingles that a partition reports of a slot.
REPORTED = 8


@dataclass(frozen=True)
class Rule:
    """Link when den * |A & B| >= num * |A | B|, on shingles of ``words`` words."""

    words: int = 3
    num: int = 90
    den: int = 100

    def distance(self, total: int) -> int:
        """Largest symmetric difference of two linked sets whose sizes add up to ``total``."""
        return total * (self.den - self.num) // (self.den + self.num)


# ------------------------------------------------------------------ sets


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, counts = word_hashes(raw, offsets)
    ends = np.cumsum(counts)
    n = len(h) - words + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k in range(words):
        rolled += mix(h[k : k + max(n, 0)] + np.uint64(k + 1)) * np.uint64(2 * k + 3)
    rolled = mix(rolled)
    out = []
    for end, c in zip(ends.tolist(), counts.tolist(), strict=True):
        if c >= words:
            out.append(np.unique(rolled[end - c : end - words + 1]))
        elif c:
            whole = hashlib.blake2b(h[end - c : end].tobytes(), digest_size=8).digest()
            out.append(np.frombuffer(whole, np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the set in each of at least 64 BRIEF, about 2n to 4n cells, as 64-bit words."""
    cells = max(64 * BRIEF, 1 << (2 * len(s) - 1).bit_length())
    cell = (mix(s + np.uint64(77)) & np.uint64(cells - 1)).astype(np.int64)
    odd = (np.bincount(cell, minlength=cells) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap (last axis) over fewer cells."""
    return np.bitwise_xor.reduce(bits.reshape(*bits.shape[:-1], -1, words), axis=-2)


# ------------------------------------------------------------------ schemes


@dataclass(frozen=True)
class Scheme:
    """Sets of size lo to hi share it; ``single`` one-unit segments come first, then ``double``."""

    number: int
    lo: int
    hi: int
    allowance: int
    spare: int
    single: int
    double: int

    def cuts(self) -> np.ndarray:
        units = self.single + 2 * self.double
        edges = [*range(self.single), *range(self.single, units, 2)]
        return np.array([(e << 64) // units for e in edges[1:]], np.uint64)


def spans(rule: Rule, largest: int) -> list[tuple[int, int, int]]:
    """(lo, hi, allowance) of each band and border; only those that allow a difference."""
    out, lo, grow = [], 1, (rule.den / rule.num) ** BAND_POWER
    while lo <= largest:
        hi = max(lo, int(lo * grow) - 1)
        out.append((lo, hi, rule.distance(2 * hi)))
        above = hi * rule.den // rule.num
        out.append((-(-(hi + 1) * rule.num // rule.den), above, rule.distance(hi + above)))
        lo = hi + 1
    return [x for x in out if x[2] > 0]


def allocate(number: int, lo: int, hi: int, allowance: int, rows: int, mean: float) -> Scheme:
    """The cheapest division for ``rows`` sets of ``mean`` size."""
    spare = 1
    for _ in range(4):
        units = allowance + 1 + spare
        empty = units * math.exp(-max(lo, 1) / units)
        spare = math.ceil(empty + 4 * math.sqrt(empty))
    units = allowance + 1 + spare
    fill, apart = mean / units, 1 - COMMON_SHARE
    best = None
    for double in sorted({0, units // 4, units // 2}):
        single = units - 2 * double
        entries = single + double * (1 + 2 * fill)
        accident = single * (math.exp(-2 * fill * apart) - math.exp(-2 * fill)) + double * math.exp(-4 * fill * apart) * (1 + 4 * fill * apart)
        cost = rows * entries + MATCH_COST * rows * rows / 2 * accident
        if best is None or cost < best[0]:
            best = (cost, Scheme(number, lo, hi, allowance, spare, single, double))
    return best[1]


class Index:
    """Index entries of sets under all schemes."""

    def __init__(self, schemes: list[Scheme]):
        self.schemes = schemes
        self.lows = np.array([s.lo for s in schemes])
        self.highs = np.array([s.hi for s in schemes])
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _table(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.tables:
            s = self.schemes[k]
            salts = mix(np.arange(s.single + s.double, dtype=np.uint64) + np.uint64((s.number + 1) << 32))
            self.tables[k] = s.cuts(), salts
        return self.tables[k]

    def entries(self, s: np.ndarray, rare: np.ndarray | None = None) -> np.ndarray:
        """Entries of the set ``s``; ``rare`` marks the shingles that aren't frequent."""
        n, out = len(s), []
        for k in np.flatnonzero((self.lows <= n) & (n <= self.highs)).tolist():
            if rare is not None:
                some, able = self._segments(k, s[rare], 0)
                out.append(some)
                if able:
                    continue
            out.append(self._segments(k, s, 1)[0])
        return mix(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)

    def _segments(self, k: int, s: np.ndarray, salt: int) -> tuple[np.ndarray, bool]:
        """(entries, whether the segments left out have at most the spare units)."""
        scheme, n, salt = self.schemes[k], len(s), np.uint64(salt << 60)
        cuts, salts = self._table(k)
        codes = mix(s + np.uint64(5))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes, out=sums[1:])
        at = np.concatenate([[0], np.searchsorted(s, cuts), [n]])
        size = np.diff(at)
        subset = sums[at[1:]] - sums[at[:-1]] + salts + salt
        one = scheme.single
        able = int((size[:one] == 0).sum()) + 2 * int((size[one:] < 2).sum()) <= scheme.spare
        whole = not able and salt  # nothing else is left to find it by
        out = [subset if whole else subset[size > 0]]
        if scheme.double:
            tail = at[one]
            own = np.repeat(subset[one:], size[one:]) - codes[tail:]
            out.append(own if whole else own[np.repeat(size[one:], size[one:]) > 1])
        return np.concatenate(out), able


# ------------------------------------------------------------------ passes over the texts


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _each_block(batch, column: int, words: int):
    offsets, raw = text_buffers(batch.column(column))
    for lo, hi in blocks(offsets):
        yield lo, hi, shingle_sets(raw, offsets[lo : hi + 1], words)


def classes_of(rows: DataFrame, words: int, kind: str, slots: int) -> DataFrame:
    """(id, h, n, key, bits, brief) of each row; key is null for an empty set, h is the text's hash.

    One more row a partition has ``slots`` and ``counts``: the slots in which it met many shingles.
    """
    maps_type, kinds = pa.list_(pa.int64()), pa.list_(pa.int32())

    def run(batches):
        id_type, total = None, np.zeros(slots, np.int32)
        for batch in batches:
            id_type = batch.column(0).type
            for lo, hi, sets in _each_block(batch, 1, words):
                if any(len(s) for s in sets):
                    at, times = np.unique(_slot(np.concatenate(sets), slots), return_counts=True)
                    total[at] += times.astype(np.int32)
                maps = [bitmap(s) if len(s) else None for s in sets]
                brief = [x if x is None else fold(x, BRIEF).view(np.int64) for x in maps]
                none = pa.nulls(hi - lo, kinds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()), pa.array([x if x is None else x.view(np.int64) for x in maps], maps_type), pa.array(brief, maps_type), none, none],
                    names=["id", "h", "n", "key", "bits", "brief", "slots", "counts"],
                )
        often = np.flatnonzero(total >= REPORTED).astype(np.int32)
        if len(often):
            own = [pa.nulls(1, t) for t in (id_type, pa.int64(), pa.int64(), pa.int64(), maps_type, maps_type)]
            yield pa.RecordBatch.from_arrays([*own, pa.array([often], kinds), pa.array([total[often]], kinds)], names=["id", "h", "n", "key", "bits", "brief", "slots", "counts"])

    return rows.withColumn("h", F.xxhash64("text")).mapInArrow(lean(run), f"id {kind}, h long, n long, key long, bits array<long>, brief array<long>, slots array<int>, counts array<int>")


def _slot(s: np.ndarray, slots: int) -> np.ndarray:
    return (mix(s + np.uint64(33)) & np.uint64(slots - 1)).astype(np.int64)


def frequent_slots(reports: DataFrame, slots: int, shingles: int) -> np.ndarray:
    """A bit a slot: whether its shingles count as frequent."""
    least = max(FREQUENT, FREQUENT_TIMES * shingles // slots)
    pairs = reports.select(F.explode(F.arrays_zip("slots", "counts")).alias("p")).groupBy("p.slots").agg(F.sum("p.counts").alias("c"))
    marks = pairs.where(F.col("c") >= least).selectExpr("slots div 64 AS w", "shiftleft(1L, cast(slots % 64 AS int)) AS b").groupBy("w").agg(F.bit_or("b").alias("v")).toPandas()
    table = np.zeros(slots // 64, np.int64)
    table[marks["w"].to_numpy(np.int64)] = marks["v"].to_numpy(np.int64)
    return table.view(np.uint64)


def entries_of(rows: DataFrame, words: int, schemes: list[Scheme], classes: DataFrame, total: int, frequent: np.ndarray) -> DataFrame:
    """(key, entries) of one row of each class that some scheme takes.

    Rows that don't stand for their class are passed over: of classes with more than
    1/1024 of all rows exactly (there are fewer than 1024 such), of others by a filter
    of fixed size; what it lets through only repeats entries.
    """
    least = min((s.lo for s in schemes), default=0)
    heavy = {r["key"]: r["id"] for r in classes.where(F.col("rows") > max(1, total // HEAVY_PARTS)).select("key", "id").collect()}
    shared = rows.sparkSession.sparkContext.broadcast((_filter_bits(classes.select("id")), heavy, frequent))

    def run(batches):
        index = Index(schemes)
        for batch in batches:
            bits, large, often = shared.value
            batch = _passed(batch, bits)
            ids = batch.column(0).to_pylist() if large else None
            for lo, _, sets in _each_block(batch, 1, words):
                keys = [set_key(s) if len(s) >= least else None for s in sets]
                own = [i for i, k in enumerate(keys) if k is not None and (k not in large or ids[lo + i] == large[k])]
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in own], pa.int64()), pa.array([index.entries(sets[i], _rare(sets[i], often)) for i in own], pa.list_(pa.int64()))], names=["key", "entries"])

    return rows.withColumn("p", _place()).mapInArrow(lean(run), "key long, entries array<long>")


def _rare(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    at = _slot(s, 64 * len(frequent))
    return ((frequent[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)) == 0


def _place():
    return F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS).cast("long"))


def _filter_bits(wanted: DataFrame) -> np.ndarray:
    """A filter of fixed size (2 MB) over the ids of ``wanted``."""
    marks = wanted.select(_place().alias("p")).selectExpr("cast(p div 64 as int) AS w", "shiftleft(1L, cast(p % 64 AS int)) AS b").groupBy("w").agg(F.bit_or("b").alias("v")).toPandas()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[marks["w"].to_numpy(np.int64)] = marks["v"].to_numpy(np.int64)
    return table.view(np.uint64)


def _passed(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    p = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
    return batch.take(pa.array(np.flatnonzero((bits[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1))))


def sets_of(rows: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """(key, items) for at least the rows whose id is in ``wanted``; wrong hits are harmless."""
    shared = rows.sparkSession.sparkContext.broadcast(_filter_bits(wanted))

    def run(batches):
        for batch in batches:
            for _, _, sets in _each_block(_passed(batch, shared.value), 1, words):
                own = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], names=["key", "items"])

    return rows.withColumn("p", _place()).mapInArrow(lean(run), "key long, items binary")


# ------------------------------------------------------------------ pairs


def _near(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """``pairs`` (x, y) that size and bitmap allow, with their Hamming distance."""
    one = classes.select(F.col("key").alias("x"), F.col("n").alias("nx"), F.col("bits").alias("bx"))
    two = classes.select(F.col("key").alias("y"), F.col("n").alias("ny"), F.col("bits").alias("by"))
    joined = pairs.join(one, "x").join(two, "y").where(F.lit(rule.den) * F.least("nx", "ny") >= F.lit(rule.num) * F.greatest("nx", "ny")).select("x", "y", "nx", "ny", "bx", "by")

    def run(batches):
        for batch in batches:
            apart = np.zeros(batch.num_rows, np.int32)
            for i, (a, b) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                a, b = a.values.to_numpy().view(np.uint64), b.values.to_numpy().view(np.uint64)
                words = min(len(a), len(b))
                apart[i] = np.bitwise_count(fold(a, words) ^ fold(b, words)).sum()
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            near = pa.array(np.flatnonzero(apart <= total * (rule.den - rule.num) // (rule.den + rule.num)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(near), batch.column(1).take(near), pa.array(apart).take(near)], names=["x", "y", "apart"])

    return joined.mapInArrow(lean(run), "x long, y long, apart int")


def verify(pairs: DataFrame, rows: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The (x, y) that link, by exact intersection of their sets."""
    keys = pairs.select(F.col("x").alias("key")).union(pairs.select("y")).distinct()
    sets = materialize(sets_of(rows, rule.words, keys.join(classes, "key").select("id")).join(keys, "key", "left_semi"), "sets")
    joined = pairs.join(sets.select(F.col("key").alias("x"), F.col("items").alias("a")), "x").join(sets.select(F.col("key").alias("y"), F.col("items").alias("b")), "y")

    def run(batches):
        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                s, t = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.concatenate([s, t])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if rule.den * common >= rule.num * (len(s) + len(t) - common):
                    keep.append(i)
            yield batch.select(["x", "y"]).take(pa.array(keep, pa.int64()))

    links = materialize(joined.select("x", "y", "a", "b").mapInArrow(lean(run), "x long, y long"), "links")
    release(sets)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, by least labels and pointer jumps."""
    both = materialize(edges.select("x", "y").union(edges.select("y", "x")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(heard, "node").select("node", F.least("label", "m").alias("to"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        step = materialize(step.join(jump, "to").select("node", F.least("to", "further").alias("label"), "was"), "labels")
        labels = step.select("node", "label")
        if step.where("label <> was").isEmpty():
            return labels


def _labelled(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs of different components, with the labels lx < ly (or the ids themselves)."""
    if labels is None:
        return pairs.withColumn("lx", F.col("x")).withColumn("ly", F.col("y"))
    for c in ("x", "y"):
        pairs = pairs.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")), c, "left")
        pairs = pairs.withColumn(f"l{c}", F.coalesce(f"l{c}", c))
    return pairs.where("lx <> ly")


def _relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after more links: components of the graph of labels, carried over."""
    if labels is None:
        return components(links)
    over = components(_labelled(links, labels).select(F.col("lx").alias("x"), F.col("ly").alias("y")))
    nodes = labels.union(over.join(labels, "node", "left_anti"))  # labels of classes that had none
    up = over.select(F.col("node").alias("label"), F.col("label").alias("up"))
    return materialize(nodes.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")


def _across(members: DataFrame, classes: DataFrame, labels: DataFrame | None, rule: Rule, closest: bool) -> DataFrame:
    """(x, y): pairs that share an entry, lie in different components and may link by their briefs.

    With ``closest`` only the closest pair of each two components in an entry's block: no block
    makes all its pairs, and every two components that may link are among them.
    """
    rows = members
    if labels is not None:
        rows = rows.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    else:
        rows = rows.withColumn("label", F.col("key"))
    mixed = rows.groupBy("entry").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("f")).where("a <> b").select("entry", "f")
    rows = rows.join(mixed, "entry").join(classes.select("key", "n", "brief"), "key")
    parts = F.ceil(F.col("f") / F.lit(BLOCK_MEMBERS))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)))
    rows = rows.select("entry", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "key", "label", "n", "brief")
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "entry", "p", "q").sortWithinPartitions("entry", "p", "q")

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            whole = table.to_batches()[0] if table.num_rows else None
            if whole is None:
                continue
            rest, done = _groups(whole, rule, closest, last=False)
            yield from done
        if rest is not None and rest.num_rows:
            yield from _groups(rest, rule, closest, last=True)[1]

    return rows.mapInArrow(lean(run), "x long, y long").distinct()


def _groups(batch: pa.RecordBatch, rule: Rule, closest: bool, last: bool):
    """(rows of the group that may go on, results of the complete groups)."""
    marks = np.stack([batch.column(i).to_numpy() for i in range(3)])
    edges = np.concatenate([[0], np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
    stop = len(edges) - 1 if last else len(edges) - 2
    own, key, label, n = (batch.column(i).to_numpy() for i in range(3, 7))
    bits = batch.column(7).flatten().to_numpy().reshape(-1, BRIEF).view(np.uint64)
    ends = np.repeat(edges[1 : stop + 1], np.diff(edges[: stop + 1]))  # of the group of each row
    cross = marks[1, : len(ends)] != marks[2, : len(ends)]
    out, left, step = [], np.arange(len(ends)), 0
    while True:  # rows a step apart in their group, for all groups at once
        step += 1
        left = left[left + step < ends[left]]
        if len(left) == 0:
            break
        i, j = left, left + step
        fits = (label[j] != label[i]) & (rule.den * np.minimum(n[j], n[i]) >= rule.num * np.maximum(n[j], n[i])) & (key[j] != key[i])
        fits &= ~cross[i] | (own[j] != own[i])
        i, j = i[fits], j[fits]
        apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1)
        near = apart <= (n[j] + n[i]) * (rule.den - rule.num) // (rule.den + rule.num)
        i, j, apart = i[near], j[near], apart[near]
        if len(i):
            out.append((np.minimum(key[j], key[i]), np.maximum(key[j], key[i]), np.minimum(label[j], label[i]), np.maximum(label[j], label[i]), ends[i], apart))
        if closest and sum(len(c[0]) for c in out) > CLOSEST_ROWS:
            out = [_closest(out)]
    rest = batch.slice(int(edges[stop])) if not last else None
    done = []
    if out:
        x, y = (_closest(out) if closest else [np.concatenate(c) for c in zip(*out, strict=True)])[:2]
        done.append(pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"]))
    return rest, done


def _closest(found: list[tuple]) -> tuple:
    """Of pairs (x, y, lesser label, greater label, group, apart) the closest of each group and two labels."""
    x, y, lo, hi, group, apart = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((y, x, apart, hi, lo, group))
    marks = np.stack([group[order], lo[order], hi[order]])
    first = order[np.concatenate([[True], (marks[:, 1:] != marks[:, :-1]).any(axis=0)])]
    return tuple(c[first] for c in (x, y, lo, hi, group, apart))


def link_classes(rows: DataFrame, classes: DataFrame, rule: Rule, total: int, frequent: np.ndarray) -> DataFrame | None:
    """(node, label) of all classes that link with another, or None if none does."""
    sizes = classes.groupBy("n").agg(F.count("*").alias("c")).toPandas()  # as many rows as there are sizes
    schemes = []
    for k, (lo, hi, allowance) in enumerate(spans(rule, int(sizes["n"].max()) if len(sizes) else 0)):
        own = sizes[(sizes["n"] >= lo) & (sizes["n"] <= hi)]
        if own["c"].sum() > 1:
            schemes.append(allocate(k, lo, hi, allowance, int(own["c"].sum()), float((own["n"] * own["c"]).sum() / own["c"].sum())))
    if not schemes:
        return None
    index = entries_of(rows, rule.words, schemes, classes, total, frequent)
    entry = Window.partitionBy("entry")
    members = index.select("key", F.explode("entries").alias("entry"))
    members = members.withColumn("last", F.max("key").over(entry)).withColumn("first", F.min("key").over(entry))
    members = materialize(members.where("first <> last").select("entry", "key", "first"), "members")
    # each class against the nearest of the smallest ids of its entries
    stars = members.where("key <> first").select(F.col("first").alias("x"), F.col("key").alias("y")).distinct()
    tried = _near(stars, classes, rule).groupBy("y").agg(F.min_by("x", F.struct("apart", "x")).alias("x")).select("x", "y")
    tried = materialize(tried, "tried")
    links = verify(tried, rows, classes, rule)
    labels = None if links.isEmpty() else components(links)
    # what may still link across components: the closest pairs first; then, between components
    # that these leave apart, all pairs, again the closest first
    skip = tried.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    seen = materialize(_across(members, classes, labels, rule, True), "pairs")
    labels = _settle(_near(seen.join(skip, ["x", "y"], "left_anti"), classes, rule), rows, classes, labels, rule)
    apart = materialize(_labelled(seen, labels).select(F.least("lx", "ly").alias("lx"), F.greatest("lx", "ly").alias("ly")).distinct(), "apart")
    if not apart.isEmpty():
        ends = apart.select(F.col("lx").alias("l")).union(apart.select("ly")).distinct()
        inside = members if labels is None else members.join(labels.withColumnRenamed("node", "key"), "key", "left")
        inside = inside.withColumn("l", F.col("key") if labels is None else F.coalesce("label", "key")).join(ends, "l", "left_semi").select("entry", "key")
        pairs = _labelled(_across(inside, classes, labels, rule, False).join(skip, ["x", "y"], "left_anti"), labels)
        pairs = pairs.select("x", "y", F.least("lx", "ly").alias("lx"), F.greatest("lx", "ly").alias("ly")).join(apart, ["lx", "ly"], "left_semi")
        labels = _settle(_near(pairs.select("x", "y"), classes, rule), rows, classes, labels, rule)
    release(members, tried, seen, apart)
    return labels


def _settle(pairs: DataFrame, rows: DataFrame, classes: DataFrame, labels: DataFrame | None, rule: Rule) -> DataFrame | None:
    """Labels after the links among ``pairs``: the closest of each two components first, then all."""
    pairs = materialize(pairs, "pairs")
    for k in range(3):
        if pairs.isEmpty():
            break
        left = materialize(_labelled(pairs, labels), "pairs")
        ends = [F.least("lx", "ly"), F.greatest("lx", "ly")]
        chosen = left if k == 2 else left.groupBy(*[e.alias(f"e{i}") for i, e in enumerate(ends)]).agg(F.min_by(F.struct("x", "y"), F.struct("apart", "x", "y")).alias("p")).select("p.x", "p.y")
        chosen = materialize(chosen.select("x", "y"), "chosen")
        if chosen.isEmpty():
            break
        more = verify(chosen, rows, classes, rule)
        if not more.isEmpty():
            labels = _relabel(labels, more)
        pairs = left.select("x", "y", "apart").join(chosen, ["x", "y"], "left_anti")
    return labels


def near_duplicates(df: DataFrame, id_col: str, text_col: str, rule: Rule = Rule()) -> DataFrame:
    """(id, n_shingles, component_id): one row for each input row.

    component_id is the smallest id that links reach, the row's own included.
    """
    return _components(df, id_col, text_col, rule).drop("h")


def _components(df: DataFrame, id_col: str, text_col: str, rule: Rule) -> DataFrame:
    """``near_duplicates`` with ``h``, a hash of each row's text."""
    rows = _texts(df, id_col, text_col)
    slots = min(SLOTS_MOST, max(SLOTS_LEAST, 1 << (SLOTS_A_ROW * df.count()).bit_length()))
    every = materialize(classes_of(rows, rule.words, id_type(df, id_col), slots), "classes")
    found = every.where(F.col("slots").isNull())
    filled = found.where(F.col("key").isNotNull())
    classes = materialize(filled.groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("brief").alias("brief"), F.count("*").alias("rows")), "keys")
    total, shingles = filled.agg(F.count("*"), F.sum("n")).first()
    frequent = frequent_slots(every.where(F.col("slots").isNotNull()), slots, shingles or 0)
    labels = link_classes(rows, classes, rule, total, frequent)
    if labels is None:
        whole = classes.select("key", "rows", F.col("id").alias("component_id"))
    else:
        named = materialize(classes.join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", "id", "rows", F.coalesce("label", "key").alias("label")), "named")
        least = materialize(named.groupBy("label").agg(F.min("id").alias("component_id"), F.count("*").alias("parts")), "least")
        whole = join_groups(named, least, "label", "parts", named.count()).select("key", "rows", "component_id")
    whole = materialize(whole, "components")
    release(classes)
    placed = join_groups(filled.select("id", "h", "n", "key"), whole, "key", "rows", total)
    empty = found.where(F.col("key").isNull()).select("id", "h", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return placed.select("id", "h", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def keep_rows(df: DataFrame, id_col: str, text_col: str, rule: Rule) -> DataFrame:
    """The rows of ``df`` that stay, all their columns: of each component the one with the smallest id.

    Of equal rows with that id one stays; rows without words all stay, and so do rows that
    share the smallest id but not the text.
    """
    found = materialize(_components(df, id_col, text_col, rule), "components")
    stays = F.col("id").eqNullSafe(F.col("component_id"))
    mark = fresh(df, "_h")
    rows = df.withColumn(mark, F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    match = [(id_col, "id"), (mark, "h")]
    kept = drop_rows(rows, found.where(~stays), match)
    repeated = found.where(stays & (F.col("n_shingles") > 0)).groupBy("id", "h").agg(F.count("*").alias("c")).where("c > 1")
    if not repeated.isEmpty():
        kept = drop_rows(kept, repeated, match).unionByName(keep_matching(kept, repeated, match).dropDuplicates([id_col, mark]))
    return kept.drop(mark)
