"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Sources share a budget (a share of all words) by weight; a target ends at ``most`` times its
source's words, and what is left over is shared by weight among the rest. The sharing is
Newton's method on a concave function of the price of one weight: each round is one sum over
the table of sources, and only two numbers come to the driver.

A source whose target is k times its words and a remainder takes all its rows k times, and
once more the rows whose hash is below a threshold. Thresholds are nested: a larger budget
takes what a smaller one takes. They are found without sorting: words are summed by source
and the leading bits of the hash, the bucket in which the running sum passes the remainder is
the boundary, and only its rows are summed again by the next bits, until one hash is left.
Rows of that hash are taken as long as that brings the source nearer to its target. A last
filter compares each row's hash with its source's threshold.

The hash is md5 of the id and of the text's md5, so other rows, partitions and reruns don't
change it. Texts are read once, into a narrow table; a source is never gathered in one task,
as sums are combined before each shuffle.

Defined cases: a null text has no words; a null source is a source of its own, the last;
sources without words have target 0; a null id is hashed as empty text; equal rows (id,
source and text) share a hash and are told apart by number only at the boundary; rows
without words are never taken; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.issues import positions

from .common import BROADCAST_ROWS, fresh, join_groups, materialize, release, unfold

WEIGHTS = (5, 2, 1)
#: Hexadecimal digits of the hash that one histogram resolves, and all it has.
DIGITS, ALL_DIGITS = 3, 32
WORDS = r"[^\x20\x09-\x0D]+"
EXACT = "decimal(38,0)"


def _key(source):
    """A source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _hash(id_col, text_col):
    name = F.coalesce(id_col.cast("string"), F.lit(""))
    text = F.coalesce(text_col.cast("string"), F.lit(""))
    return F.md5(F.concat(name, F.lit(":"), F.md5(text.cast("binary"))).cast("binary"))


def sized_rows(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, key, source, size, h): the only pass over the texts."""
    id_, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    size = F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    return df.select(id_.alias("id"), _key(source).alias("key"), source.cast("string").alias("source"), size.alias("size"), _hash(id_, text).alias("h"))


# ------------------------------------------------------------------ targets


def targets(rows: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = 3) -> DataFrame:
    """(key, source, source_size, weight, members, target), one row a source.

    ``share`` is the budget as a part of all words, at most ``most``.
    """
    if not 0 <= share <= most or min(weights) <= 0:
        raise ValueError("a share from 0 to the cap and positive weights are needed")
    sums = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("members"))
    place = positions(sums.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.col("position") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = materialize(place.select("key", "source", "source_size", weight.alias("weight"), "members"), "sources")
    whole = sources.agg(F.sum(F.col("source_size").cast(EXACT)).alias("s"), F.sum(F.col("weight").cast(EXACT)).alias("w")).first()
    budget, free = Decimal(int(share * int(whole["s"] or 0))), whole["w"] or Decimal(1)
    cap = F.col("source_size").cast(EXACT) * most
    price, count = (budget, free), -1
    while True:  # price: words of one weight, as a fraction; it only grows
        above = F.col("weight").cast(EXACT) * F.lit(price[0]).cast(EXACT) > cap * F.lit(price[1]).cast(EXACT)
        held = sources.where(above).agg(F.count("*").alias("n"), F.sum(cap).alias("c"), F.sum(F.col("weight").cast(EXACT)).alias("w")).first()
        if held["n"] == count or held["w"] == free:
            break
        count = held["n"]
        price = (budget - (held["c"] or 0), free - (held["w"] or 0))
    shared = (F.col("weight").cast(EXACT) * F.lit(price[0]).cast(EXACT)).cast("double") / F.lit(price[1]).cast(EXACT).cast("double")
    return sources.withColumn("target", F.when(above, cap.cast("double")).otherwise(shared))


# ------------------------------------------------------------------ thresholds


def _few(rows: DataFrame, key: str = "key") -> DataFrame:
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def thresholds(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(key, edge, rest) for sources with a remainder: rows below the hash ``edge`` are taken once
    more, and of those at ``edge`` as many as ``rest`` words allow."""
    spare = F.col("target") - F.col("repeats") * F.col("source_size")
    goal = sources.where("source_size > 0").withColumn("repeats", F.floor(F.col("target") / F.col("source_size"))).withColumn("rest", spare).where("rest > 0")
    open_ = materialize(goal.select("key", "rest"), "mix-goals")
    inside = rows.where("size > 0").select("key", "size", "h").join(_few(open_), "key")
    spent, found = [open_], []
    for depth in range(0, ALL_DIGITS, DIGITS):
        bucket = F.substring("h", depth + 1, DIGITS).alias("bucket")
        sums = inside.groupBy("key", bucket).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"), F.min("h").alias("low"), F.max("h").alias("high"))
        # at most 16**DIGITS buckets a source meet in one window
        ahead = sums.withColumn("before", F.expr("coalesce(sum(n) OVER (PARTITION BY key ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)"))
        edge = ahead.where("before < rest AND before + n >= rest").select("key", "bucket", F.expr("rest - before").alias("rest"), "low", "high")
        edge = materialize(edge, "mix-edges")
        spent.append(edge)
        found.append(edge.where("low = high").select("key", F.col("low").alias("edge"), "rest"))
        more = edge.where("low < high").select("key", "bucket", F.col("rest").alias("rest_in"))
        if more.isEmpty():
            break
        inside = inside.select("key", "size", "h", bucket).join(_few(more), ["key", "bucket"]).select("key", "size", "h", F.col("rest_in").alias("rest"))
        inside = materialize(inside, "mix-inside")
        spent.append(inside)
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    whole = materialize(whole, "mix-thresholds")
    release(*spent)
    return whole


def mix(df: DataFrame, id_col: str, text_col: str, source_col: str, weights=WEIGHTS, share: float = 1.0, most: int = 3) -> DataFrame:
    """(id, source, h, size, source_size, target, times): one row for each input row, and how often the mix takes it."""
    rows = materialize(sized_rows(df, id_col, text_col, source_col), "mix-rows")
    sources = targets(rows, weights, share, most)
    edges = thresholds(rows, sources)
    plan = sources.join(edges, "key", "left").select("key", "source_size", "target", "members", "edge", "rest", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("repeats"))
    plan = materialize(plan, "mix-plan")
    release(edges)
    if plan.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        placed = rows.join(F.broadcast(plan), "key")
    else:
        placed = join_groups(rows, plan, "key", "members", rows.count())
    placed = placed.drop("key", "members")
    at_edge = F.coalesce(F.col("h") == F.col("edge"), F.lit(False)) & (F.col("size") > 0)
    once = F.coalesce(F.col("h") < F.col("edge"), F.lit(False))
    columns = ["id", "source", "h", "size", "source_size", "target"]
    sure = placed.where(~at_edge).select(*columns, F.when(F.col("size") > 0, F.col("repeats") + once.cast("long")).otherwise(0).cast("long").alias("times"))
    equal = placed.where(at_edge).groupBy(*columns, "repeats", "rest").agg(F.count("*").alias("copies"))
    equal = unfold(equal, "copies", "k")
    done, next_ = F.col("k") * F.col("size"), (F.col("k") + 1) * F.col("size")
    nearer = (done < F.col("rest")) & ((next_ <= F.col("rest")) | (next_ - F.col("rest") <= F.col("rest") - done))
    return sure.unionByName(equal.select(*columns, (F.col("repeats") + nearer.cast("long")).cast("long").alias("times")))


def mixed_rows(df: DataFrame, id_col: str, text_col: str, source_col: str, **rule) -> DataFrame:
    """``df``'s rows as the mix takes them, repeats included, with ``copy`` counting from 0."""
    answers = mix(df, id_col, text_col, source_col, **rule).where("times > 0")
    # equal rows differ at most by one in how often they are taken; a number for each joins them one to one
    key, hash_name, copy = (fresh(df, n) for n in ("_source", "_hash", "copy"))
    total = answers.groupBy(_key(F.col("source")).alias("_k"), F.col("h").alias("_h")).agg(F.sum("times").alias("_times"))
    rows = df.withColumn(key, _key(F.col(f"`{source_col}`"))).withColumn(hash_name, _hash(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))
    one = rows.dropDuplicates([key, hash_name])
    return unfold(one.join(total, (F.col(key) == F.col("_k")) & (F.col(hash_name) == F.col("_h"))).drop("_k", "_h", key, hash_name), "_times", copy).drop("_times")
