"""Helpers shared by the corpus operators.

Every operator first projects its input to internally named columns, so extra
input columns, whatever their names, neither clash nor travel through shuffles.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one numpy pass works on; longer texts are cut at white space.
BLOCK_BYTES = 1 << 20
#: Most words whose ids a worker keeps.
CACHE_WORDS = 1 << 19


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(id_col, divisor: int):
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_type(df: DataFrame, id_col: str) -> str:
    return df.select(F.col(f"`{id_col}`").alias("i")).schema["i"].dataType.simpleString()


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; installed on driver and executors alike."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


# ------------------------------------------------------------------ shared storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the cluster names none (tests in one JVM) a temporary folder is set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="gaugeworks-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Options of the writer by table: the words of lines fit their file's dictionary, so that one takes some 19 bits instead of 64.
STORED_AS = {"line-words": {"parquet.dictionary.page.size": str(8 << 20)}}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    The table survives lost executors. It goes with ``release`` or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gw-{name}-{uuid.uuid4().hex}"
    df.write.options(**STORED_AS.get(name, {})).parquet(path)
    atexit.register(_remove, spark, path)
    spark.sparkContext._jvm.System.gc()  # Spark frees the shuffle files of a finished job when its driver collects garbage
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for table in tables:
        _remove(table.sparkSession, table.stored_at)


def dense_array(rows: DataFrame, place: str, value: str, size: int) -> DataFrame:
    """One row and column ``all``: ``value`` at each ``place`` below ``size``, 0 where ``rows`` has none."""
    block, kind = 1 << 12, rows.schema[value].dataType.simpleString()
    at = F.col("at").cast("long")
    rows = rows.select(F.col(place).cast("long").alias("at"), value)
    every = rows.sparkSession.range(size).select(F.col("id").alias("at")).join(rows, "at", "left").select("at", F.coalesce(value, F.lit(0).cast(kind)).alias(value))
    runs = every.groupBy(F.expr(f"at div {block}").alias("block")).agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), value))).alias("run"))
    runs = runs.select("block", F.transform("run", lambda x: x[value]).alias("run"))
    whole = runs.agg(F.sort_array(F.collect_list(F.struct("block", "run"))).alias("runs"))
    return materialize(whole.select(F.flatten(F.transform("runs", lambda x: x["run"])).alias("all")), "array")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ------------------------------------------------------------------ skew-safe joins

#: A key with more than total / HEAVY_PARTS rows is heavy; so there are fewer than
#: HEAVY_PARTS heavy keys at any size of input, which bounds the broadcast.
HEAVY_PARTS = 1024


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one-row-per-key ``groups`` when keys are skewed.

    ``size`` is a key's number of rows. Heavy keys (fewer than ``HEAVY_PARTS``) are
    broadcast, so their rows stay where they are; the rest meets in a shuffle join
    in which no key has more than total / HEAVY_PARTS rows.
    """
    heavy = F.col(size) > max(1, total // HEAVY_PARTS)
    hot = F.broadcast(groups.where(heavy))
    marks = F.broadcast(groups.where(heavy).select(key))
    cold_rows = rows.join(marks, key, "left_anti")
    return rows.join(hot, key).unionByName(cold_rows.join(groups.where(~heavy), key))


#: Most rows of a key list that is broadcast; a longer one meets the rows in a shuffle join.
BROADCAST_ROWS = 1 << 18


def _matched(rows: DataFrame, keys: DataFrame, match: list[tuple[str, str]], how: str) -> DataFrame:
    names = [fresh(rows, f"_key{i}") for i in range(len(match))]
    keys = keys.select(*[F.col(k).alias(n) for n, (_, k) in zip(names, match, strict=True)])
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    on = F.lit(True)
    for n, (c, _) in zip(names, match, strict=True):
        on = on & F.col(f"`{c}`").eqNullSafe(F.col(n))
    return rows.join(keys, on, how)


def drop_rows(rows: DataFrame, keys: DataFrame, match: list[tuple[str, str]]) -> DataFrame:
    """Rows whose (null-safe) columns equal no row of ``keys``; ``match``: (row column, key column)."""
    return _matched(rows, keys, match, "left_anti")


def keep_matching(rows: DataFrame, keys: DataFrame, match: list[tuple[str, str]]) -> DataFrame:
    return _matched(rows, keys, match, "left_semi")


def unfold(df: DataFrame, count: str, index: str, step: int = 1 << 16) -> DataFrame:
    """Repeat each row ``count`` times, numbered from 0; no array has over ``count / step`` or ``step`` items."""
    n = F.col(count).cast("long")
    df = df.where(n > 0).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(step).cast("long"))))
    return df.withColumn(index, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + step - 1, n - 1)))).drop("_from")


# ------------------------------------------------------------------ Arrow text blocks


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets int64 of length n + 1, bytes) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, (_, offs, data) = len(column), column.buffers()
    if n == 0 or offs is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, raw


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most ``limit`` bytes together, or one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


# ------------------------------------------------------------------ workers' memory


def give_back() -> None:
    """Memory that this worker's allocators hold free goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc's only
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """``run`` of a ``mapInArrow``, giving back what it leaves: a worker lives on, and its executor pays for it in later stages."""

    def all_batches(batches):
        yield from run(batches)
        give_back()

    return all_batches


# ------------------------------------------------------------------ 64-bit hashing


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
_BASE = U64(0xD1342543DE82EF95)
_INVERSE = U64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][: n + 1]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of texts, A-Z lowered.

    ``offsets`` bounds the texts in ``raw``. Returns (hashes, counts a text).
    Texts over ``BLOCK_BYTES`` are worked off in parts cut at white space, so
    working memory doesn't follow the longest text.
    """
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for lo, hi in blocks(offsets):
        a, b = int(offsets[lo]), int(offsets[hi])
        if hi == lo + 1 and b - a > BLOCK_BYTES:
            at = a
            while at < b:
                end = min(at + BLOCK_BYTES, b)
                if end < b:
                    back = np.flatnonzero(_SPACE[raw[at:end]])
                    if len(back):
                        end = at + int(back[-1]) + 1
                    else:
                        while end < b and not _SPACE[raw[end]]:
                            end += 1
                h, c = _words(raw[at:end], np.array([0, end - at]))
                hashes.append(h)
                counts[lo] += c[0]
                at = end
        else:
            h, c = _words(raw[a:b], offsets[lo : hi + 1] - a)
            hashes.append(h)
            counts[lo:hi] = c
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def _words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds) - 1, np.int64)
    inside = ~_SPACE[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODES[_LOWER[raw]] * up, out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return h, np.diff(np.searchsorted(starts, bounds))


class IdCache:
    """Ids of words by 64-bit key, kept in flat arrays; forgets all beyond ``CACHE_WORDS`` words."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.slots = np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def missing(self, distinct: np.ndarray) -> np.ndarray:
        """Positions of the keys that aren't known; all are, if these wouldn't fit any more."""
        if len(self.keys) + len(distinct) > CACHE_WORDS:
            self.forget()
        if len(self.keys) == 0:
            return np.arange(len(distinct))
        at = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
        return np.flatnonzero(self.keys[at] != distinct)

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """New keys with their ids one after the other."""
        slots = np.arange(len(keys)) + len(self.starts) - 1
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        order = np.argsort(keys)
        where = np.searchsorted(self.keys, keys[order])
        self.keys, self.slots = np.insert(self.keys, where, keys[order]), np.insert(self.slots, where, slots[order])

    def gather(self, distinct: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, running number of ids before each word)."""
        slot = self.slots[np.searchsorted(self.keys, distinct)][inverse]
        sizes = self.starts[slot + 1] - self.starts[slot]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[np.repeat(self.starts[slot] - total[:-1], sizes) + np.arange(total[-1])], total
