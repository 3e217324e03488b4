"""Exact deduplication with a cuckoo-filter index over text digests.

``CuckooIndex`` keeps 16-bit fingerprints of live SHA-256 digests in buckets of four
slots, each with the stored key beside it. A lookup probes the two buckets a
fingerprint allows; a hit counts only if the stored key in that bucket equals the
digest. Digests can be deleted; a failed insertion or a load over 90 % doubles the
table and refills it from the stored keys.

A deduplication runs the index twice: each map task folds its own rows into groups (so
a hot text leaves a task as one row), then each task of the digest-partitioned
exchange merges these partial groups. A group: largest id, number of rows.

Defined cases: null text is empty text; a null id is less than any other; of repeated
rows with the largest id exactly one stays; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_rows, fresh, join_groups, keep_matching, materialize, partitions, unfold

SLOTS = 4
MAX_KICKS = 200
MAX_LOAD = 0.9


class CuckooIndex:
    """A cuckoo filter whose slots point to stored keys; a key's record is its number."""

    def __init__(self, buckets: int = 1024):
        self.keys: list[bytes | None] = []  # stored keys by record number
        self.free: list[int] = []
        self.resizes = 0
        self.false_hits = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.n = buckets
        self.prints = np.zeros((buckets, SLOTS), np.uint16)
        self.records = np.full((buckets, SLOTS), -1, np.int64)
        self.live = 0

    @staticmethod
    def _split(key: bytes) -> tuple[int, int]:
        word = int.from_bytes(key[:8], "little")
        return (word & 0xFFFF) or 1, word >> 16

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & (self.n - 1))

    def _slot(self, key: bytes) -> tuple[int, int] | None:
        mark, rest = self._split(key)
        first = rest & (self.n - 1)
        for b in (first, self._other(first, mark)):
            for s in range(SLOTS):
                if self.prints[b, s] == mark:
                    if self.keys[self.records[b, s]] == key:
                        return b, s
                    self.false_hits += 1
        return None

    def find(self, key: bytes) -> int | None:
        """Record number of a live key, or None."""
        at = self._slot(key)
        return None if at is None else int(self.records[at])

    def maybe(self, keys: list[bytes]) -> np.ndarray:
        """Filter answer for many keys at once: False is certain, True is to be verified."""
        words = np.frombuffer(b"".join(k[:8] for k in keys), "<u8")
        marks = np.maximum(words & np.uint64(0xFFFF), 1).astype(np.int64)
        first = ((words >> np.uint64(16)) & np.uint64(self.n - 1)).astype(np.int64)
        second = first ^ ((marks * 0x5BD1E995) & (self.n - 1))
        small = marks.astype(np.uint16)[:, None]
        return (self.prints[first] == small).any(axis=1) | (self.prints[second] == small).any(axis=1)

    def insert(self, key: bytes) -> int:
        """Add a key that isn't live; returns its record number."""
        if self.free:
            record = self.free.pop()
            self.keys[record] = key
        else:
            record = len(self.keys)
            self.keys.append(key)
        if self.live + 1 > MAX_LOAD * self.n * SLOTS or not self._place(key, record):
            self._grow()
        return record

    def _place(self, key: bytes, record: int) -> bool:
        mark, rest = self._split(key)
        bucket = rest & (self.n - 1)
        for b in (bucket, self._other(bucket, mark)):
            for s in range(SLOTS):
                if self.records[b, s] < 0:
                    self.prints[b, s], self.records[b, s] = mark, record
                    self.live += 1
                    return True
        for kick in range(MAX_KICKS):
            s = (record + kick) % SLOTS
            mark, self.prints[bucket, s] = int(self.prints[bucket, s]), mark
            record, self.records[bucket, s] = int(self.records[bucket, s]), record
            bucket = self._other(bucket, mark)
            for s in range(SLOTS):
                if self.records[bucket, s] < 0:
                    self.prints[bucket, s], self.records[bucket, s] = mark, record
                    self.live += 1
                    return True
        return False  # the record left over is placed by _grow(), from its stored key

    def _grow(self) -> None:
        buckets = self.n
        while True:
            buckets *= 2
            self.resizes += 1
            self._clear(buckets)
            if all(self._place(k, r) for r, k in enumerate(self.keys) if k is not None):
                return

    def delete(self, key: bytes) -> int | None:
        """Remove a live key; returns its record number, which is free from now on."""
        at = self._slot(key)
        if at is None:
            return None
        record = int(self.records[at])
        self.prints[at], self.records[at] = 0, -1
        self.keys[record] = None
        self.free.append(record)
        self.live -= 1
        return record


class GroupIndex:
    """Largest id and number of rows for each live digest."""

    def __init__(self):
        self.index = CuckooIndex()
        self.top: list[int | None] = []
        self.size: list[int] = []

    def add(self, digests: list[bytes], ids: list, sizes: list[int]) -> None:
        """Fold rows in; a size below 0 takes rows away, and a digest whose last row goes is deleted."""
        hits = self.index.maybe(digests) if digests else ()
        fresh = False  # insertions of this batch aren't in ``hits``
        for digest, key, n, hit in zip(digests, ids, sizes, hits, strict=True):
            record = self.index.find(digest) if hit or fresh else None
            if record is None:
                if n <= 0:
                    continue
                record, fresh = self.index.insert(digest), True
                if record == len(self.top):
                    self.top.append(key)
                    self.size.append(n)
                else:
                    self.top[record], self.size[record] = key, n
                continue
            self.size[record] += n
            if n > 0 and key is not None and (self.top[record] is None or key > self.top[record]):
                self.top[record] = key
            if self.size[record] <= 0:
                self.index.delete(digest)

    def rows(self) -> tuple[list[bytes], list, list[int]]:
        live = [(k, self.top[r], self.size[r]) for r, k in enumerate(self.index.keys) if k is not None]
        return tuple(map(list, zip(*live, strict=True))) if live else ([], [], [])


def _fold(batches, schema: pa.Schema):
    groups = GroupIndex()
    for batch in batches:
        groups.add(*(batch.column(k).to_pylist() for k in range(3)))
    digests, ids, sizes = groups.rows()
    for at in range(0, len(digests), 10_000):
        part = slice(at, at + 10_000)
        yield pa.RecordBatch.from_arrays([pa.array(x[part], f.type) for x, f in zip((digests, ids, sizes), schema, strict=True)], schema=schema)


def digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest): SHA-256 of the text's UTF-8 bytes, null as empty."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return df.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def fold_groups(rows: DataFrame) -> DataFrame:
    """(digest, id, n) rows to one (digest, keep_id, group_size) for each live digest."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(rows.schema)
    spec = rows.schema

    def run(batches):
        return _fold(batches, schema)

    partial = rows.mapInArrow(run, spec)
    whole = partial.repartition(partitions(rows.sparkSession), "digest").mapInArrow(run, spec)
    return whole.select("digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size"))


def verdicts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, copies, keep_id, group_size): one row for each distinct (id, digest)."""
    keyed = digests(df, id_col, text_col)
    groups = materialize(fold_groups(keyed.select("digest", "id", F.lit(1).cast("long").alias("n"))), "groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    rows = keyed.groupBy("id", "digest").agg(F.count("*").alias("copies"))
    return join_groups(rows, groups, "digest", "group_size", total)


def exact_dedup(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, keep_id, group_size, kept): one row for each input row."""
    placed = unfold(verdicts(df, id_col, text_col), "copies", "copy")
    return placed.select("id", "digest", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)).alias("kept"))


def keep_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Texts aren't shuffled where the list of dropped rows is small enough to broadcast
    (``drop_rows`` checks it); of repeated rows with the largest id, one stays.
    """
    found = materialize(verdicts(df, id_col, text_col), "verdicts")
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    mark = fresh(df, "_hash")
    rows = df.withColumn(mark, F.unhex(F.sha2(text.cast("binary"), 256)))
    match = [(id_col, "id"), (mark, "digest")]
    kept = drop_rows(rows, found.where(~stays), match)
    repeated = found.where(stays & (F.col("copies") > 1))
    if not repeated.isEmpty():
        once = drop_rows(kept, repeated, match)
        kept = once.unionByName(keep_matching(kept, repeated, match).dropDuplicates([id_col, mark]))
    return kept.drop(mark)
