"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every run of 1 to 3 code points is hashed to one of
``2 ** bits`` buckets. Training counts all labelled texts (no sample), in numpy a
block at a time, summed by Spark over (label, bucket). The log-probability matrix is broadcast
in blocks of at most ``max_labels`` labels, in the labels' order, so neither the driver nor a
worker makes more than one at a time; each block is a step of the same stage that hands on a
row's best label so far and the mass of all. Scoring gathers the matrix only at the buckets
that occur. Log probabilities are fixed-point integers, so a score depends neither on batches
nor on the order of rows.

Defined cases: a null or empty text, or one without a letter, gets ``und`` and score
0; equal scores give the label that sorts first; rows with a null label aren't learned
from; without any labelled row every text gets ``und``; repeated rows count, and are
answered, one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize, mix

UNKNOWN = "und"
#: Fixed-point scale of log probabilities.
SCALE = 1 << 20
#: Code points worked on at once.
BLOCK_CHARS = 1 << 18
ORDERS = 3
#: A text whose best label has a smaller posterior has no language: all others together are likelier.
MAJORITY = 0.5


@dataclass(frozen=True)
class Model:
    """A block of labels; ``further`` makes the next one."""

    labels: list[str]
    prior: np.ndarray  # int64 [labels]
    logp: np.ndarray  # int64 [labels, 2**bits + 1]; the last column is 0
    bits: int
    further: Callable[[], Model] | None = None


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, row of each part, bounds of the parts).

    A text over the block size goes in parts that overlap by ORDERS - 1, and only
    n-grams that begin before the overlap are counted in a part.
    """
    parts, rows, size = [], [], 0
    for i, t in enumerate(texts):
        low = t.lower() if t else ""
        for at in range(0, len(low), BLOCK_CHARS):
            piece = low[at : at + BLOCK_CHARS + ORDERS - 1]
            if size + len(piece) > BLOCK_CHARS and parts:
                yield _joined(parts), np.array(rows), np.cumsum([0, *map(len, parts)])
                parts, rows, size = [], [], 0
            parts.append(piece)
            rows.append(i)
            size += len(piece)
    if parts:
        yield _joined(parts), np.array(rows), np.cumsum([0, *map(len, parts)])


def _joined(parts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_buckets(points: np.ndarray, bounds: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """For each order the bucket of the n-gram that begins at each code point.

    2**bits stands where the n-gram would leave its part or begins in an overlap.
    """
    ends = np.repeat(bounds[1:], np.diff(bounds))
    lengths = np.diff(bounds)
    starts = np.repeat(bounds[:-1], lengths)
    at = np.arange(len(points))
    owned = at - starts < BLOCK_CHARS
    h = np.zeros(len(points), np.uint64)
    for n in range(1, ORDERS + 1):
        shifted = np.zeros(len(points), np.uint64)
        shifted[: len(points) - n + 1] = points[n - 1 :]
        h = mix(h + shifted * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n))
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
        bucket[(at + n > ends) | ~owned] = 1 << bits
        yield bucket


def _count(batches, bits: int):
    width = (1 << bits) + 1
    totals: dict[str, np.ndarray] = {}
    seen: dict[str, int] = {}
    for batch in batches:
        texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for x in labels:
            seen[x] = seen.get(x, 0) + 1
        names = sorted(set(labels))
        code = {x: k for k, x in enumerate(names)}
        own = np.array([code[x] for x in labels], np.int64)
        for points, rows, bounds in _blocks(texts):
            lift = np.repeat(own[rows], np.diff(bounds)) * width
            total = np.zeros(len(names) * width, np.int64)
            for bucket in gram_buckets(points, bounds, bits):
                total += np.bincount(lift + bucket, minlength=len(total))
            for k, x in enumerate(names):
                part = total[k * width : (k + 1) * width]
                totals[x] = totals[x] + part if x in totals else part.copy()
    for x, n in seen.items():
        counts = totals.get(x, np.zeros(width, np.int64))[:-1]
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x] * (len(hit) + 1), pa.string()), pa.array(np.append(hit, -1), pa.int32()), pa.array(np.append(counts[hit], n), pa.int64())],
            names=["label", "bucket", "n"],
        )


def train(df: DataFrame, text_col: str, label_col: str, bits: int = 15, max_labels: int = 512, smoothing: float = 0.5) -> Model:
    """Count every labelled row; at most ``max_labels * (2**bits + 1)`` sums reach the driver at a time."""
    rows = df.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{label_col}`").cast("string").alias("label"))
    rows = rows.where(F.col("label").isNotNull())
    sums = materialize(rows.mapInArrow(lambda it: _count(it, bits), "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")), "gram-counts")
    seen = sums.where("bucket = -1").select("label", "n").toPandas()  # a row for each label
    names, total = sorted(seen["label"]), max(int(seen["n"].sum()), 1)

    def block(first: int) -> Model:
        labels = names[first : first + max_labels]
        counts = np.zeros((len(labels), (1 << bits) + 1))
        if labels:
            found = sums.where(F.col("label").between(labels[0], labels[-1])).toPandas()
            where = found["label"].map({x: k for k, x in enumerate(labels)}).to_numpy(np.int64)
            counts[where, found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy()  # bucket -1 is the last column
        texts, counts = counts[:, -1].copy(), counts[:, :-1] + smoothing
        logp = np.zeros((len(labels), (1 << bits) + 1), np.int64)
        if labels:
            logp[:, :-1] = np.rint(np.log(counts / counts.sum(axis=1, keepdims=True)) * SCALE)
        prior = np.rint(np.log(texts / total) * SCALE).astype(np.int64)
        return Model(labels, prior, logp, bits, (lambda: block(first + max_labels)) if first + max_labels < len(names) else None)

    return block(0)


def _sums(model: Model, texts: list[str | None]) -> np.ndarray:
    """Log probability of each label (rows) and text."""
    sums = np.tile(model.prior[:, None], (1, len(texts)))
    for points, rows, bounds in _blocks(texts) if model.labels else ():
        for bucket in gram_buckets(points, bounds, model.bits):
            for k in range(len(model.labels)):
                run = np.zeros(len(bucket) + 1, np.int64)
                np.cumsum(model.logp[k][bucket], out=run[1:])
                np.add.at(sums[k], rows, run[bounds[1:]] - run[bounds[:-1]])
    return sums


def _best(model: Model, texts: list[str | None], before=None) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """Best label, its log probability, and the mass of all labels relative to it, with those of ``before``; None without a letter."""
    sums = _sums(model, texts)
    labels, best, mass = ([None] * len(texts), np.zeros(len(texts), np.int64), np.zeros(len(texts))) if before is None else (list(before[0]), before[1].copy(), before[2].copy())
    pick = sums.argmax(axis=0) if model.labels else None
    for i, t in enumerate(texts):
        if pick is None or not t or not has_letter(t):
            continue
        top, own = sums[pick[i], i], np.exp(np.maximum((sums[:, i] - sums[pick[i], i]) / SCALE, -700)).sum()
        if labels[i] is None or top > best[i]:
            carried = 0.0 if labels[i] is None else mass[i] * np.exp(max((best[i] - top) / SCALE, -700))
            labels[i], best[i], mass[i] = model.labels[pick[i]], top, own + carried
        else:
            mass[i] += own * np.exp(max((top - best[i]) / SCALE, -700))
    return labels, best, mass


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Predicted label and its posterior probability for each text, among this block's labels."""
    labels, _, mass = _best(model, texts)
    return [x if x is not None else UNKNOWN for x in labels], np.array([1.0 / m if x is not None else 0.0 for x, m in zip(labels, mass, strict=True)])


def scored(rows: DataFrame, model: Model, text_col: str) -> tuple[DataFrame, tuple[str, str, str]]:
    """``rows`` with three columns more, whose names follow: best label or null, its log probability, mass."""
    names = tuple(fresh(rows, f"_{c}") for c in ("label", "best", "mass"))
    width, at = len(rows.columns), rows.columns.index(text_col)
    kinds = (pa.string(), pa.int64(), pa.float64())
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.LongType(), T.DoubleType()), strict=True))])
    block: Model | None = model
    while block is not None:
        shared, first = rows.sparkSession.sparkContext.broadcast(Model(block.labels, block.prior, block.logp, block.bits)), block is model

        def run(batches, shared=shared, first=first):
            for batch in batches:
                before = None if first else (batch.column(width).to_pylist(), *(batch.column(width + k).to_numpy(zero_copy_only=False) for k in (1, 2)))
                found = _best(shared.value, batch.column(at).to_pylist(), before)
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *(pa.array(x, t) for x, t in zip(found, kinds, strict=True))], names=[*batch.schema.names[:width], *names])

        rows = rows.mapInArrow(run, schema)
        block = block.further() if block.further else None
    return rows, names


def predict(df: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(id, lang_pred, score) of every row, from its text alone."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found, (label, _, mass) = scored(rows, model, "text")
    return found.select("id", F.coalesce(label, F.lit(UNKNOWN)).alias("lang_pred"), F.when(F.col(label).isNotNull(), 1 / F.col(mass)).otherwise(0.0).alias("score"))


def keep_rows(df: DataFrame, model: Model, text_col: str) -> DataFrame:
    """The rows of ``df`` whose text has a language, all their columns; each row is decided by its own text, never by its id.

    A text without a letter has none, and one whose best label has less than ``MAJORITY`` of the
    posterior. The label alone is no reason, and a model without labels decides by letters only.
    """
    rows, (label, _, mass) = scored(df, model, text_col)
    if not model.labels:
        return rows.where(F.col(f"`{text_col}`").rlike(r"\p{L}")).select(*[F.col(f"`{c}`") for c in df.columns])
    return rows.where(F.col(label).isNotNull() & (F.col(mass) * MAJORITY <= 1)).select(*[F.col(f"`{c}`") for c in df.columns])
