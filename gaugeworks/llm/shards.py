"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A row's key is hashed to 64 bits; the jump function maps it to one of n shards with no
ring table. Going from n to n + 1 shards moves only the rows that the new shard takes.

Slots are numbered without a gap in each shard by two levels: a cell (12 further bits
of a digest of key, size and content) has a count, the counts' running sum over at most
shards * 4096 cells gives each cell's offset, and rows are ordered within their cell.
Identical rows are counted before any shuffle, so neither a hot key nor copies of a row
gather in one task's memory.

Defined cases: a null key is hashed as empty text; a null text has no bytes (size 8,
crc32 0); repeated rows get a slot each; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, unfold

CELL_BITS = 12


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each uint64 key."""
    if shards < 1:
        raise ValueError("at least one shard")
    keys = keys.astype(np.uint64)
    at, ahead = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        at[live] = ahead[live]
        keys[live] = keys[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((keys[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[live] = ((at[live] + 1).astype(np.float64) * step).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def shard_rows(df: DataFrame, id_col: str, text_col: str, shards: int) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard), one row for each input row."""

    @F.pandas_udf("struct<shard int, grown_shard int>")
    def place(key: pd.Series) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(key), ">u8").astype(np.uint64)
        return pd.DataFrame({"shard": jump(keys.copy(), shards).astype(np.int32), "grown_shard": jump(keys.copy(), shards + 1).astype(np.int32)})

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.groupBy("id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    rows = rows.withColumn("p", place(F.unhex(F.substring(F.md5(name.cast("binary")), 1, 16))))
    cell = F.conv(F.substring(F.md5(F.concat_ws(":", name, "size", "text_crc32").cast("binary")), 1, CELL_BITS // 4), 16, 10).cast("int")
    rows = materialize(rows.select("id", "size", "text_crc32", "copies", "p.shard", "p.grown_shard", cell.alias("cell")), "shards")
    cells = rows.groupBy("shard", "cell").agg(F.sum("copies").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("shard", "cell", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("shard", "cell").orderBy("id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("copies").over(inner), F.lit(0))).join(F.broadcast(cells), ["shard", "cell"])
    placed = unfold(placed, "copies", "k")
    slot = F.col("offset") + F.col("before") + F.col("k")
    return placed.select("id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")
