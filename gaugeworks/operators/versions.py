"""Versions, requirements as intervals of versions, and the best version of each requirement.

A version (semantic versioning 2.0; build metadata don't count) becomes a text key that sorts as
versions do. A requirement is a union (``||``) of conjunctions (``,``) of comparators: ``=``,
``>``, ``>=``, ``<``, ``<=``, ``^`` (also without a sign), ``~``, ``*`` and ``1.2.*``, with minor
and patch left out or not. Each conjunction is one interval of keys, from the highest lower
bound to the lowest upper one. A pre-release matches only if a comparator of the conjunction
names a pre-release of the same three numbers.

``resolve`` finds the highest version in each interval by one sweep over a package's versions and
interval ends: the last version before the end, if it isn't below the start. Only conjunctions
that name pre-releases meet those, by an equi-join on the package and the three numbers.

Defined cases: what is no version has a null key and is left out; a requirement with an
unreadable comparator has no intervals; an empty one, or ``*``, takes any release.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBER = r"0|[1-9]\d*"
VERSION = rf"^\s*[vV=]?\s*({NUMBER})\.({NUMBER})\.({NUMBER})(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\s*$"
PARTIAL = rf"^\s*(=|>=|<=|>|<|\^|~)?\s*(?:[vV]?({NUMBER})(?:\.({NUMBER}|[*xX]))?(?:\.({NUMBER}|[*xX]))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?|([*xX]))\s*$"
#: Sorts behind the keys of all pre-releases of the same numbers, and behind all keys.
RELEASE, LAST = "~", "~~"
DIGITS = 20


def _padded(n: Column) -> Column:
    return F.lpad(n.cast("string"), DIGITS, "0")


def _pre(text: Column) -> Column:
    """Key of a pre-release: its parts, numbers before words, each ended by a mark below all others."""
    return F.array_join(F.transform(F.split(text, r"\."), lambda x: F.concat(F.when(x.rlike(r"^\d+$"), F.concat(F.lit("1"), F.lpad(x, DIGITS, "0"))).otherwise(F.concat(F.lit("2"), x)), F.lit("!"))), "")


def _key(major: Column, minor: Column, patch: Column, pre: Column) -> Column:
    return F.concat(_padded(major), F.lit("."), _padded(minor), F.lit("."), _padded(patch), F.when(F.coalesce(pre, F.lit("")) == "", RELEASE).otherwise(_pre(pre)))


def version_key(text: Column) -> Column:
    """A text that sorts as versions do; null for what is none."""
    part = [F.regexp_extract(text, VERSION, k) for k in range(1, 5)]
    return F.when(text.rlike(VERSION), _key(*part))


def triple(key: Column) -> Column:
    """The three numbers of a key."""
    return F.substring(key, 1, 3 * DIGITS + 2)


def is_release(key: Column) -> Column:
    return key.endswith(RELEASE)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bounds(comparator: Column) -> Column:
    """Struct (low, high, pre): keys from ``low`` on and below ``high``; ``pre`` is the triple of a named pre-release. Null if unreadable."""
    part = F.array(*[F.regexp_extract(comparator, PARTIAL, k) for k in range(1, 7)])
    return F.when(comparator.rlike(PARTIAL), _let(part, lambda p: _bounds_of([p[k] for k in range(6)])))


def _bounds_of(part: list[Column]) -> Column:
    sign = F.when(part[0] == "", "^").otherwise(part[0])
    given = [F.when(p.rlike(r"^\d+$"), p.cast("decimal(20,0)")) for p in part[1:4]]
    wild = part[2].isin("*", "x", "X") | part[3].isin("*", "x", "X")
    sign = F.when((part[0] == "") & wild, "=").otherwise(sign)
    zero, one = F.lit(0).cast("decimal(20,0)"), F.lit(1).cast("decimal(20,0)")
    major, minor, patch = given[0], F.coalesce(given[1], zero), F.coalesce(given[2], zero)
    pre = F.when(given[2].isNotNull(), part[4]).otherwise("")
    low = _key(major, minor, patch, pre)

    def upto(a, b, c):
        """Below all versions of these numbers and on, their pre-releases included."""
        return F.concat(_padded(a), F.lit("."), _padded(b), F.lit("."), _padded(c))

    after = F.when(given[1].isNull(), upto(major + one, zero, zero)).when(given[2].isNull(), upto(major, minor + one, zero))
    behind = F.concat(low, F.lit(" "))  # the next key after ``low``
    caret = F.when((major > zero) | given[1].isNull(), upto(major + one, zero, zero)).when((minor > zero) | given[2].isNull(), upto(major, minor + one, zero)).otherwise(upto(major, minor, patch + one))
    tilde = F.when(given[1].isNull(), upto(major + one, zero, zero)).otherwise(upto(major, minor + one, zero))
    start = F.when(given[2].isNull(), upto(major, minor, patch)).otherwise(low)
    least, most = F.lit(""), F.lit(LAST)
    bounds = (
        F.when(part[5] != "", F.struct(least.alias("low"), most.alias("high")))
        .when(sign == "=", F.struct(start.alias("low"), F.coalesce(after, behind).alias("high")))
        .when(sign == ">", F.struct(F.coalesce(after, behind).alias("low"), most.alias("high")))
        .when(sign == ">=", F.struct(start.alias("low"), most.alias("high")))
        .when(sign == "<", F.struct(least.alias("low"), start.alias("high")))
        .when(sign == "<=", F.struct(least.alias("low"), F.coalesce(after, behind).alias("high")))
        .when(sign == "~", F.struct(start.alias("low"), tilde.alias("high")))
        .otherwise(F.struct(start.alias("low"), caret.alias("high")))
    )
    return _let(bounds, lambda b: F.struct(b["low"].alias("low"), b["high"].alias("high"), F.when(pre != "", triple(low)).alias("pre")))


def intervals(requirement: Column) -> Column:
    """Array of structs (low, high, pre) of a requirement; null if a comparator is unreadable."""

    def one(conjunction):
        return _let(F.transform(F.filter(F.split(conjunction, ","), lambda c: F.trim(c) != ""), _bounds), joint)

    def joint(each):
        bounds = F.transform(each, lambda b: b["low"]), F.transform(each, lambda b: b["high"])
        known = F.forall(each, lambda b: b.isNotNull())
        return F.when(known, F.struct(F.coalesce(F.array_max(bounds[0]), F.lit("")).alias("low"), F.coalesce(F.array_min(bounds[1]), F.lit(LAST)).alias("high"), F.array_distinct(F.array_compact(F.transform(each, lambda b: b["pre"]))).alias("pre")))

    parts = F.transform(F.split(requirement, r"\|\|"), one)
    return _let(parts, lambda each: F.when(F.forall(each, lambda p: p.isNotNull()), each))


def satisfies(key: Column, requirement: Column) -> Column:
    """Whether a version, by its key, fulfils a requirement; null if either is unreadable."""
    return within(key, intervals(requirement))


def within(key: Column, ranges: Column) -> Column:
    """The same by a requirement's ``intervals``, for requirements that many rows share."""
    fits = F.exists(ranges, lambda i: (key >= i["low"]) & (key < i["high"]) & (is_release(key) | F.array_contains(i["pre"], triple(key))))
    return F.when(key.isNotNull(), fits)


def resolve(requirements: DataFrame, versions: DataFrame) -> DataFrame:
    """(package, requirement, version): the highest of ``versions`` (package, version) that fulfils each requirement, null if none does."""
    known = versions.select("package", "version", version_key(F.col("version")).alias("key")).where("key IS NOT NULL").dropDuplicates(["package", "key"])
    asked = requirements.select("package", "requirement").distinct()
    each = asked.withColumn("i", F.explode(intervals(F.col("requirement")))).select("package", "requirement", "i.low", "i.high", "i.pre").where("low < high")
    marks = known.where(is_release(F.col("key"))).select("package", F.col("key").alias("at"), F.lit(1).alias("side"), F.struct("key", "version").alias("found"))
    ends = each.select("package", F.col("high").alias("at"), F.lit(0).alias("side"), F.struct("requirement", "low").alias("asked"))
    before = Window.partitionBy("package").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    swept = marks.unionByName(ends, allowMissingColumns=True).withColumn("found", F.last("found", ignorenulls=True).over(before)).where("side = 0 AND found.key >= asked.low")
    releases = swept.select("package", "asked.requirement", "found")
    named = each.withColumn("triple", F.explode("pre")).join(known.where(~is_release(F.col("key"))).withColumn("triple", triple(F.col("key"))), ["package", "triple"]).where("key >= low AND key < high")
    early = named.select("package", "requirement", F.struct("key", "version").alias("found"))
    best = releases.unionByName(early).groupBy("package", "requirement").agg(F.max("found").alias("found"))
    return asked.join(best, ["package", "requirement"], "left").select("package", "requirement", F.col("found.version").alias("version"))
