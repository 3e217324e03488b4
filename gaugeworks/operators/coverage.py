"""Line-coverage arrays: summaries, merging, totals and path transformers.

``hits`` holds one value a line: below 0 omitted, 0 missed, above 0 covered.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(covered, uncovered):
    """Per cent covered; 0 where nothing counts."""
    return F.coalesce(F.try_divide(covered * F.lit(100.0), covered + uncovered), F.lit(0.0))


def summarize(df: DataFrame) -> DataFrame:
    """Counts of a row: exactly -1 is omitted, 0 missed, all else (also other negatives) covered."""

    def n(test) -> Column:
        return F.size(F.filter("hits", test)).cast("bigint")

    return df.withColumns({"omit": n(lambda x: x == -1), "missed": n(lambda x: x == 0), "covered": n(lambda x: (x != 0) & (x != -1)), "total": F.size("hits").cast("bigint")})


def merge_reports(df: DataFrame) -> DataFrame:
    """(path, hits): reports of a path merged, cut to the shortest.

    A line is the least value where any report omits it, else the sum. Lines are summed
    by (path, position), which the map side combines; no task holds a path's reports. A
    report also counts itself at position -1, so one pass tells which lines all reports have.
    """
    marked = F.concat(F.array(F.lit(0).cast("bigint")), F.coalesce("hits", F.array().cast("array<bigint>")))
    lines = df.select("path", F.posexplode(marked).alias("pos", "hit"))
    merged = lines.groupBy("path", "pos").agg(F.min("hit").alias("low"), F.sum("hit").alias("sum"), F.count("*").alias("reports"))
    value = F.when(F.col("low") < 0, F.col("low")).otherwise(F.col("sum"))
    rows = merged.groupBy("path").agg(F.array_sort(F.collect_list(F.struct((F.col("pos") - 1).alias("pos"), "reports", value.alias("v")))).alias("rows"))
    every = F.filter(F.slice("rows", F.lit(2), F.size("rows")), lambda r: r["reports"] == F.col("rows")[0]["reports"])
    return rows.select("path", F.transform(every, lambda r: r["v"]).alias("hits"))


def combined_totals(df: DataFrame) -> DataFrame:
    """One row of totals with hits added up raw by (path, line): -1 + 1 counts as uncovered."""
    lines = df.select("path", F.posexplode("hits").alias("pos", "hit")).groupBy("path", "pos").agg(F.sum("hit").alias("hit"))
    return _totals(lines)


def totals(df: DataFrame) -> DataFrame:
    """One row of totals over hits as they are."""
    return _totals(df.select(F.explode("hits").alias("hit")))


def _totals(lines: DataFrame) -> DataFrame:
    counts = lines.agg(F.count_if(F.col("hit") > 0).alias("covered"), F.count_if(F.col("hit") == 0).alias("uncovered"), F.count_if(F.col("hit") < 0).alias("omitted"), F.count("*").alias("total"))
    return counts.withColumn("pct", F.round(_share(F.col("covered"), F.col("uncovered")), 6))


def report_total(df: DataFrame) -> DataFrame:
    """Printed total: sums of summaries, per cent cut to whole numbers."""
    sums = summarize(df).agg(*[F.sum(c).cast("bigint").alias(c) for c in ("covered", "missed", "omit", "total")])
    return sums.withColumn("pct", F.floor(_share(F.col("covered"), F.col("missed"))).cast("bigint"))


# ------------------------------------------------------------------ path transformers

# Path prefixes of checkouts on CI machines, tried in this order.
CI_PREFIXES = (
    r"^/?home/circleci/project/",
    r"^/?(home|Users)/runner/work/[^/]+/[^/]+/",
    r"^/?github.com/[^/]+/[^/]+/",
    r"^/?(home|Users)/travis/build/[^/]+/[^/]+/",
    r"^/?(home|Users)/jenkins/jobs/[^/]+/workspace/",
    r"^/?Users/distiller/[^/]+/",
    r"^/?(home|Users)/[^/]+/workspace/[^/]+/[^/]+/",
)


def strip_prefix(path, prefix: str):
    """Drop a leading run of whole components."""
    root = prefix.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def fix_path(path):
    """Slashes for back-slashes, no drive, and the first CI prefix that matches removed."""
    unix = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^.:/", "")
    first = "|".join(f"(?:{p})" for p in CI_PREFIXES)  # all begin at ^, so the first that matches is taken, once
    return F.regexp_replace(unix, first, "")


def strip_dot_slash(path):
    return F.regexp_replace(path, r"^\./", "")


def add_prefix(path, prefix: str):
    return F.concat(F.lit(prefix.rstrip("/") + "/"), F.regexp_replace(path, "^/+", ""))


def prepend_source_dir(df: DataFrame, listing: DataFrame, dirs: list[str]) -> DataFrame:
    """Path under the first of ``dirs`` where ``listing`` (path) has it; else unchanged."""
    if not dirs:
        return df
    order = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(d.rstrip("/") + "/").alias("d")) for i, d in enumerate(dirs)]))
    candidates = df.select("path").distinct().withColumn("c", order).select("path", "c.k", F.concat("c.d", "path").alias("candidate"))
    found = candidates.join(listing.select(F.col("path").alias("candidate")).distinct(), "candidate", "left_semi")
    first = found.groupBy("path").agg(F.min_by("candidate", "k").alias("placed"))
    return df.join(first, "path", "left").withColumn("path", F.coalesce("placed", "path")).drop("placed")


def glob_regex(glob: str, within_names: bool = False) -> str:
    """Regular expression of a glob. ``*`` and ``?`` match slashes too, so ``*.min.*`` holds in any directory.

    ``within_names``: they don't (names of configuration files); ``**`` spans directories either way.
    """
    out, i = "", 0
    any_ = "[^/]" if within_names else "."
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + any_ + "*", i + 1
        elif glob[i] == "?":
            out, i = out + any_, i + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(x, within_names)[5:-1] for x in glob[i + 1 : end].split(",")) + ")", end + 1
        elif glob[i] == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return "(?s)^" + out + "$"


def matches(path, globs) -> Column:
    """Whether any glob matches."""
    return reduce(lambda a, b: a | b, [path.rlike(glob_regex(g)) for g in globs], F.lit(False))


def ignore(df: DataFrame, globs: list[str]) -> DataFrame:
    return df.where(~matches(F.col("path"), globs))


def publish_chain(df: DataFrame, root: str, ignored: list[str], prefix: str | None = None, listing: DataFrame | None = None, source_dirs=(), strip: str | None = None) -> DataFrame:
    """The publishing transformers in their order; manual prefix options switch the CI fixer off."""
    df = summarize(df).withColumn("path", strip_prefix(F.col("path"), strip or root))
    if prefix is None and strip is None:
        df = df.withColumn("path", fix_path(F.col("path")))
    df = df.withColumn("path", strip_dot_slash(F.col("path")))
    if listing is not None:
        df = prepend_source_dir(df, listing, list(source_dirs))
    df = ignore(df, ignored)
    if prefix is not None:
        df = df.withColumn("path", add_prefix(F.col("path"), prefix))
    return df.withColumn("path", strip_dot_slash(F.col("path")))


def transform_chain(df: DataFrame, root: str, prefix: str | None = None) -> DataFrame:
    path = strip_dot_slash(fix_path(strip_prefix(F.col("path"), root)))
    return df.withColumn("path", path if prefix is None else add_prefix(path, prefix))


def existing(df: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows whose file is in the listing."""
    return df.join(listing.select("path").distinct(), "path", "left_semi")


def validate(df: DataFrame, listing: DataFrame, threshold: float = 90.0) -> DataFrame:
    """One row: files found and missing, their share, and a status."""
    paths = df.select("path").distinct().join(listing.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    counts = paths.agg(F.count_if("there").alias("files_present"), F.count_if(F.col("there").isNull()).alias("files_missing"), F.count("*").alias("total_files"))
    share = F.coalesce(F.try_divide(F.col("files_present") * F.lit(100.0), F.col("total_files")), F.lit(0.0))
    status = F.when(F.col("total_files") == 0, "NO_COVERAGE_DATA").when(share >= threshold, "VALID").otherwise("INVALID")
    return counts.withColumns({"coverage_percentage": F.round(share, 6), "status": status})


def found_missing(df: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, found) of each distinct path."""
    return df.select("path").distinct().join(listing.select("path").distinct().withColumn("there", F.lit(True)), "path", "left").select("path", F.coalesce("there", F.lit(False)).alias("found"))


def missing_metadata() -> Column:
    """The first of commit_sha, reference and commit_time that is null or empty; null if an upload has them all."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    return F.coalesce(*[F.when(empty(c), F.lit(c)) for c in ("commit_sha", "reference", "commit_time")])
