"""Secret scans with multipart credential linking, in DataFrame functions only.

Base findings are matches of three fixed patterns. Linking adds weak candidates:
identifiers (user or client names), short or unlabelled secrets, and endpoints, which are
too common to report alone. Each part of a text is an interval of code points; two
parts are in scope of one another if they don't overlap and at most ``scope`` code
points lie between them. Reported are

* a weak identifier with a secret (weak or base) in scope,
* a weak secret with an identifier (weak or base access key) or endpoint in scope,
* an endpoint with both an identifier and a secret in scope.

The interval join is a sweep: each part contributes its end and its start as points; a
running maximum of ends (and, backwards, minimum of starts) by role gives the nearest
part of each role on either side. No pair of parts is ever made, and the only shuffle
carries lengths of matches and of the gaps between them, by row.

Defined cases: null text is empty; rows are told apart by id (null included) and text
digest, and repeated rows get equal answers, one each; a match inside another of the
same role is swept like any other; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh, unfold

SCOPE = 200


def _word(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# Fixed values of the base scan: kinds, patterns and least lengths.
ASSIGN = f"({_word('password')}|{_word('passwd')}|{_word('secret')}|{_word('token')}|{_word('api')}_?{_word('key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")

# Weak candidates of the linking step.
IDENT = f"({_word('username')}|{_word('user')}|{_word('login')}|{_word('account')}|{_word('client')}_?{_word('id')}|{_word('key')}_?{_word('id')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9_.@+-]+)"
TOKEN = "[A-Za-z0-9+/_=-]{16,}"
ENDPOINT = "[a-z][a-z0-9+.-]{1,20}://[^\\x20\\x09-\\x0D\"'<>]+|[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}(:[0-9]+)?"
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "ident": IDENT, "token": TOKEN, "endpoint": ENDPOINT}
ORDER = {k: i for i, k in enumerate(KINDS)}
#: The part each kind can play: identifier, secret or endpoint.
ROLES = {"assign": "s", "access": "i", "hex": "s", "ident": "i", "token": "s", "endpoint": "e"}


def _fits(kind: str, m):
    """Whether a match counts; matches that don't still take up their place."""
    if kind == "assign":
        return F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    if kind == "ident":
        return F.length(F.regexp_extract(m, IDENT, 2)) >= 3
    if kind == "token":
        return m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
    return F.lit(True)


def _found(kind: str, text):
    """array<struct(kind, k, gap, width, fits)>: each match with the text before it."""
    pattern = KINDS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(
        matches,
        F.split(text, pattern, -1),
        lambda m, gap: F.struct(F.lit(kind).alias("kind"), F.length(gap).cast("long").alias("gap"), F.length(m).cast("long").alias("width"), (m.isNotNull() & F.coalesce(_fits(kind, m), F.lit(False))).alias("fits")),
    )
    parts = F.transform(parts, lambda x, i: F.struct(x["kind"].alias("kind"), i.alias("k"), x["gap"].alias("gap"), x["width"].alias("width"), x["fits"].alias("fits")))
    none = F.array().cast("array<struct<kind:string,k:int,gap:bigint,width:bigint,fits:boolean>>")
    return F.when(F.size(matches) > 0, F.filter(parts, lambda x: x["width"].isNotNull())).otherwise(none)


def parts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, kind, start, end) of every match, and for each row one of kind ``row``.

    Rows stay partitioned by (id, digest), which later windows and groups reuse.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    mark = F.array(F.struct(F.lit("row").alias("kind"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("gap"), F.lit(0).cast("long").alias("width"), F.lit(True).alias("fits")))
    rows = rows.select("id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), F.explode(F.concat(mark, *[_found(k, F.col("text")) for k in KINDS])).alias("p"))
    rows = rows.select("id", "digest", "p.*")
    # repeated rows meet here as equal records and are counted before the shuffle
    rows = rows.groupBy("id", "digest", "kind", "k", "gap", "width", "fits").agg(F.count("*").alias("copies"))
    before = Window.partitionBy("id", "digest", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("width")).over(before)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("width")).where("fits")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``parts`` with ``keep``: base parts, row marks, and weak parts whose complement is in scope."""
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[F.col("kind")]
    points = found.withColumn("role", role).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    # at side 0 a part ends and begins to count for later ones; at side 1 it starts and looks back
    points = points.withColumn("at", F.when(F.col("side") == 0, F.col("end")).otherwise(F.col("start")))
    back = Window.partitionBy("id", "digest").orderBy("at", "side", "kind", "start").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("id", "digest").orderBy(F.col("at").desc(), F.col("side").desc(), F.col("kind"), F.col("start")).rowsBetween(Window.unboundedPreceding, 0)
    near = {}
    for r in "ise":
        last = F.max(F.when((F.col("role") == r) & (F.col("side") == 0), F.col("end"))).over(back)
        following = F.min(F.when((F.col("role") == r) & (F.col("side") == 1), F.col("start"))).over(ahead)
        near[f"near_{r}"] = F.when(F.col("side") == 1, F.coalesce(F.col("start") - last <= scope, F.lit(False))).otherwise(F.coalesce(following - F.col("end") <= scope, F.lit(False)))
    swept = points.select("id", "digest", "kind", "start", "end", "copies", *[c.alias(k) for k, c in near.items()])
    whole = swept.groupBy("id", "digest", "kind", "start", "end").agg(F.max("copies").alias("copies"), *[F.max(k).alias(k) for k in near])
    keep = (
        F.when(F.col("kind") == "ident", F.col("near_s"))
        .when(F.col("kind") == "token", F.col("near_i") | F.col("near_e"))
        .when(F.col("kind") == "endpoint", F.col("near_i") & F.col("near_s"))
        .otherwise(F.lit(True))
    )
    return whole.withColumn("keep", keep)


def scan(df: DataFrame, id_col: str, text_col: str, scope: int = SCOPE) -> DataFrame:
    """(id, digest, found): one row for each input row.

    ``found`` is an array of (start, rank, kind, end), by start, then kind; digest is the
    MD5 of the text.
    """
    rank = F.create_map(*[F.lit(x) for pair in ORDER.items() for x in pair])[F.col("kind")]
    part = F.struct("start", rank.alias("rank"), "kind", "end")
    rows = linked(parts(df, id_col, text_col), scope)
    rows = rows.groupBy("id", "digest").agg(
        F.max(F.when(F.col("kind") == "row", F.col("copies"))).alias("copies"),
        F.array_sort(F.collect_list(F.when(F.col("keep") & (F.col("kind") != "row"), part))).alias("found"),
    )
    return unfold(rows, "copies", "copy").select("id", "digest", "found")


def spans(found, kinds=tuple(KINDS)):
    """``kind:start:end`` of the kinds named, comma-joined."""
    own = F.filter(found, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count(found, kind: str):
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")


def redact(df: DataFrame, id_col: str, text_col: str, found: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``df`` with every found interval of the text replaced by ``mask``; other rows as they are.

    ``found`` is the result of ``scan``. Overlapping intervals are masked as one.
    """
    names = df.columns
    id_name, digest_name, found_name, hash_name = (fresh(df, n) for n in ("_id", "_digest", "_found", "_hash"))
    hits = found.where(F.size("found") > 0).dropDuplicates(["id", "digest"]).select(F.col("id").alias(id_name), F.col("digest").alias(digest_name), F.col("found").alias(found_name))
    body = F.col(f"`{text_col}`").cast("string")
    rows = df.withColumn(hash_name, F.unhex(F.md5(F.coalesce(body, F.lit("")).cast("binary"))))
    if (hits.agg(F.sum(F.size(found_name) + 1)).first()[0] or 0) <= BROADCAST_ROWS:
        hits = F.broadcast(hits)
    rows = rows.join(hits, F.col(f"`{id_col}`").eqNullSafe(F.col(id_name)) & (F.col(hash_name) == F.col(digest_name)), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, x):
        gap = F.substring(body, (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        inside = x["start"] < acc["at"]
        return F.struct(F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mask))).alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    masked = F.aggregate(F.col(found_name), start, step, lambda acc: F.concat(acc["out"], F.substring(body, (acc["at"] + 1).cast("int"), F.length(body))))
    changed = F.when(F.col(found_name).isNull(), body).otherwise(masked)
    return rows.withColumn(text_col, changed).select(*[F.col(f"`{c}`") for c in names])
