"""Language-model scoring by deleted interpolation of n-gram estimates.

    p(w | h) = l2[b] c(hw) / c(h) + l1[b] c(w) / N + l0[b] / (V + 1)

where b is the bucket of the context's count, floor(log2 c(h)) + 1 (0 for an unseen
context, which has l2 = 0). Counts are of all training texts. The mixture weights of a
bucket maximise, by expectation-maximisation, the likelihood of the fold of training
texts with crc32(id) mod 7 = ``FOLD`` under counts from which that fold is deleted.

Counting and look-up move blocks, not words: texts are gathered into chunks, written
once as a table (distinct word hashes and the sequence of their numbers). Each chunk
sends its distinct n-gram hashes with counts, sorted and packed, to hash buckets;
a bucket adds up equal hashes and answers each chunk with the totals in the order asked.
So a task holds one chunk, or one bucket's share of the distinct n-grams, and no word is
hot. Weights need a histogram of (bucket, log p2, log p1) only, in 1/16 octaves, whose
size doesn't follow the corpus.

Words are hashed to 64 bits. Defined cases: null text is empty text, one end token;
repeated rows count and are scored each; without training texts all counts are 0 and
N = V = 0; weights of buckets the fold never meets are those of the nearest lower bucket
that it does, else equal; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, id_type, lean, materialize, mix, partitions, remainder, text_buffers, word_hashes

CHUNK_BYTES = 8 << 20
FOLD = 3
STEPS = 16
END = np.uint64(0x5851F42D4C957F2D)
#: Chunks whose n-grams make up a hash bucket, at least 64 buckets: so a bucket's size
#: doesn't follow the corpus.
CHUNKS_A_BUCKET, LEAST_BITS = 4, 6
EM_ROUNDS = 40


# ------------------------------------------------------------------ packed arrays


def squeeze(values: np.ndarray) -> bytes:
    """Compressed byte planes of an unsigned array."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def expand(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=np.uint64(0)))


def expand_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob, np.uint64), dtype=np.uint64)


# ------------------------------------------------------------------ chunks


def chunk_table(df: DataFrame, id_col: str, text_col: str, held_out) -> DataFrame:
    """(chunk, fold, ids, held, sizes, words, seq): one row for about ``CHUNK_BYTES`` of text.

    Texts of the fold are in chunks of their own.
    """
    kind = id_type(df, id_col)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    rows = rows.withColumn("fold", (remainder(F.col("id"), 7) == FOLD) & ~F.col("held"))

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        waiting = {False: [], True: []}
        size = {False: 0, True: 0}

        def flush(fold):
            nonlocal made
            ids = pa.concat_arrays([w[0] for w in waiting[fold]])
            held = np.concatenate([w[1] for w in waiting[fold]])
            words = np.concatenate([w[2] for w in waiting[fold]])
            counts = np.concatenate([w[3] for w in waiting[fold]])
            waiting[fold].clear()
            size[fold] = 0
            tokens = np.insert(words, np.cumsum(counts), END)
            distinct, seq = np.unique(tokens, return_inverse=True)
            made += 1
            row = [pa.array([(part << 32) + made], pa.int64()), pa.array([fold]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
            row += [pa.array([held]), pa.array([counts + 1], pa.list_(pa.int64())), pa.array([squeeze_sorted(distinct)]), pa.array([squeeze(seq.astype(np.uint32))])]
            return pa.RecordBatch.from_arrays(row, names=["chunk", "fold", "ids", "held", "sizes", "words", "seq"])

        for batch in batches:
            folds = np.array(batch.column(3).to_pylist(), bool)
            for fold in (False, True):
                own = batch.take(pa.array(np.flatnonzero(folds == fold)))
                offsets, raw = text_buffers(own.column(1))
                lo = 0
                while lo < len(own):
                    hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES - size[fold], "right")) - 1)
                    hi = min(hi, len(own))
                    h, c = word_hashes(raw, offsets[lo : hi + 1])
                    waiting[fold].append((own.column(0).slice(lo, hi - lo), np.array(own.column(2).slice(lo, hi - lo).to_pylist(), bool), h, c))
                    size[fold] += int(offsets[hi] - offsets[lo])
                    lo = hi
                    if size[fold] >= CHUNK_BYTES or lo < len(own):
                        yield flush(fold)
        for fold in (False, True):
            if waiting[fold]:
                yield flush(fold)

    schema = f"chunk long, fold boolean, ids array<{kind}>, held array<boolean>, sizes array<long>, words binary, seq binary"
    return materialize(rows.mapInArrow(lean(run), schema), "chunks")


def _grams(words: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bigram hashes, ascending, and each token's number among them."""
    before = np.empty(len(seq), np.uint64)
    before[1:] = words[seq[:-1]]
    before[:1] = END
    return np.unique(mix(mix(before + np.uint64(11)) + words[seq] * np.uint64(0x9FB21C651E98DF25)), return_inverse=True)


def _requests(chunks: DataFrame, bits: int) -> DataFrame:
    """(bucket, order, chunk, fold, hashes, counts): distinct n-grams of each chunk by 2**bits hash buckets."""

    def run(batches):
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                words, seq = expand_sorted(r["words"]), expand(r["seq"], np.uint32)
                learn = np.repeat(~np.array(r["held"], bool), r["sizes"])
                pairs, own = _grams(words, seq)
                rows = []
                for order, hashes, number in ((1, words, seq), (2, pairs, own)):
                    counts = np.bincount(number[learn], minlength=len(hashes)).astype(np.uint32)
                    cuts = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
                    for b in np.flatnonzero(np.diff(cuts)).tolist():
                        at = slice(cuts[b], cuts[b + 1])
                        rows.append((b, order, r["chunk"], r["fold"], squeeze_sorted(hashes[at]), squeeze(counts[at])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "order", "chunk", "fold", "hashes", "counts"])

    return chunks.mapInArrow(lean(run), "bucket int, order int, chunk long, fold boolean, hashes binary, counts binary")


def _answer(table: pa.Table) -> pa.Table:
    """One bucket and order: add up equal hashes and answer each chunk."""
    rows = table.to_pylist()
    hashes = [expand_sorted(r["hashes"]) for r in rows]
    counts = [expand(r["counts"], np.uint32) for r in rows]
    cuts = np.cumsum([0, *map(len, hashes)])
    distinct, number = np.unique(np.concatenate(hashes), return_inverse=True)
    total, fold = np.zeros(len(distinct), np.uint64), np.zeros(len(distinct), np.uint64)
    del hashes, distinct
    for r, c, a, b in zip(rows, counts, cuts, cuts[1:], strict=False):  # a chunk's hashes are distinct
        total[number[a:b]] += c
        if r["fold"]:
            fold[number[a:b]] += c
    order, bucket = rows[0]["order"], rows[0]["bucket"]
    out = [(r["chunk"], bucket, order, r["fold"], squeeze(total[number[a:b]]), squeeze(fold[number[a:b]]) if r["fold"] else None, None, None, None) for r, a, b in zip(rows, cuts, cuts[1:], strict=False)]
    if order == 1:
        out.append((None, bucket, 0, False, None, None, int(total.sum()), int((total > 0).sum()), int(fold.sum())))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    names = ["chunk", "bucket", "order", "fold", "total", "deleted", "n", "v", "n_fold"]
    give_back()
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def count_table(chunks: DataFrame) -> DataFrame:
    bits = max(LEAST_BITS, (chunks.count() // CHUNKS_A_BUCKET).bit_length())
    asked = _requests(chunks, bits)
    schema = "chunk long, bucket int, order int, fold boolean, total binary, deleted binary, n long, v long, n_fold long"
    return materialize(asked.groupBy("bucket", "order").applyInArrow(_answer, schema), "counts")


# ------------------------------------------------------------------ per-chunk counts


def _counts(chunk: dict, answers: list[dict], field: str) -> dict:
    """Counts of each token, its context and their bigram."""
    words, seq = expand_sorted(chunk["words"]), expand(chunk["seq"], np.uint32)
    pairs, own = _grams(words, seq)
    found = {}
    for order, size in ((1, len(words)), (2, len(pairs))):
        parts = sorted((a["bucket"], a[field]) for a in answers if a["order"] == order)
        found[order] = np.concatenate([expand(x, np.uint64) for _, x in parts]).astype(np.float64)
        if len(found[order]) != size:
            raise ValueError("answers don't belong to this chunk")
    token = found[1][seq]
    end = found[1][np.searchsorted(words, END)]
    return {"token": token, "context": np.concatenate([[end], token[:-1]]), "pair": found[2][own]}


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.frexp(context)[1], 0).astype(np.int64)


def _paired(chunks: DataFrame, counts: DataFrame, run, schema: str) -> DataFrame:
    answers = counts.where(F.col("chunk").isNotNull()).select("chunk", "bucket", "order", "total", "deleted")

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left.to_pylist()[0], right.to_pylist())
        give_back()
        return out

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(pair, schema)


def _level(p: np.ndarray) -> np.ndarray:
    """Log2 in steps of 1/16 octave; -1 for 0."""
    return np.where(p > 0, np.rint(-np.log2(np.where(p > 0, p, 1.0)) * STEPS), -1).astype(np.int64)


def learn_weights(chunks: DataFrame, counts: DataFrame, n: int, v: int, n_fold: int) -> np.ndarray:
    """Weights (l2, l1, l0) of each bucket, from the fold under counts without it."""
    rest = max(n - n_fold, 1)

    def levels(chunk: dict, answers: list[dict]) -> pa.Table:
        whole, own = _counts(chunk, answers, "total"), _counts(chunk, answers, "deleted")
        left = {k: whole[k] - own[k] for k in whole}
        p2 = np.divide(left["pair"], left["context"], out=np.zeros(len(left["pair"])), where=left["context"] > 0)
        frame = pd.DataFrame({"b": bucket_of(left["context"]), "k2": _level(p2), "k1": _level(left["token"] / rest)})
        sums = frame.groupby(["b", "k2", "k1"]).size().rename("c").reset_index()
        return pa.Table.from_pandas(sums.astype("int64"), preserve_index=False)

    fold = chunks.where("fold")
    hist = _paired(fold, counts.where("fold"), levels, "b long, k2 long, k1 long, c long").groupBy("b", "k2", "k1").agg(F.sum("c").alias("c")).toPandas()
    return expectation_maximisation(hist, v)


def expectation_maximisation(hist: pd.DataFrame, v: int) -> np.ndarray:
    top = 65
    weights = np.full((top, 3), 1 / 3)
    seen = np.zeros(top, bool)
    for b, part in hist.sort_values(["b", "k2", "k1"]).groupby("b"):
        p = np.zeros((len(part), 3))
        for col, k in ((0, "k2"), (1, "k1")):
            level = part[k].to_numpy()
            p[:, col] = np.where(level >= 0, 2.0 ** (-np.maximum(level, 0) / STEPS), 0)
        p[:, 2] = 1 / (v + 1)
        c, w = part["c"].to_numpy(float), np.full(3, 1 / 3)
        if b == 0:
            p[:, 0], w = 0, np.array([0, 0.5, 0.5])
        for _ in range(EM_ROUNDS):
            share = p * w
            share *= (c / share.sum(axis=1))[:, None]
            w = share.sum(axis=0) / c.sum()
        weights[b], seen[b] = np.maximum(w, 1e-9) / np.maximum(w, 1e-9).sum(), True
    for b in range(1, top):
        if not seen[b] and seen[b - 1] and b > 1:
            weights[b], seen[b] = weights[b - 1], True
    weights[0] = [0, *(weights[0][1:] / weights[0][1:].sum())]
    return weights


def score_documents(df: DataFrame, id_col: str, text_col: str, held_out) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    ``held_out`` is a boolean column expression over ``df``: rows not learned from.
    """
    kind = id_type(df, id_col)
    chunks = chunk_table(df, id_col, text_col, held_out)
    counts = count_table(chunks)
    n, v, n_fold = (x or 0 for x in counts.agg(F.sum("n"), F.sum("v"), F.sum("n_fold")).first())
    weights = learn_weights(chunks, counts, n, v, n_fold)

    def score(chunk: dict, answers: list[dict]) -> pa.Table:
        c = _counts(chunk, answers, "total")
        sizes = np.array(chunk["sizes"], np.int64)
        at = np.cumsum(sizes) - sizes
        w = weights[bucket_of(c["context"])]
        p2 = np.divide(c["pair"], c["context"], out=np.zeros(len(c["pair"])), where=c["context"] > 0)
        p = w[:, 0] * p2 + w[:, 1] * c["token"] / max(n, 1) + w[:, 2] / (v + 1)
        base = np.log10((c["token"] + 1) / (n + v + 1))
        known = np.add.reduceat((c["token"] > 0).astype(np.int64), at)
        return pa.table([pa.array(chunk["ids"], ids_kind), pa.array(chunk["held"]), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), n, np.int64)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(p), at))], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    ids_kind = to_arrow_type(df.schema[id_col].dataType)
    return _paired(chunks, counts, score, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
