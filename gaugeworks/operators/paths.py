"""Path predicates, directory roll-ups and ancestor joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coverage import matches

# Largest source file and paths never analysed unless asked for.
MAX_FILE_BYTES = 2_098_000
SUMS = ("files", "classes", "functions", "lines", "code_lines", "complexity", "lcom4")


def globs(df: DataFrame, include: Sequence[str], keep: bool = True) -> DataFrame:
    test = matches(F.col("path"), include)
    return df.where(test if keep else ~test)


def keep_by_patterns(path: Column, patterns: Sequence[str]) -> Column:
    """Exclude patterns where the last match wins; ``!pattern`` takes a path back in."""
    out = F.lit(True)
    for p in patterns:
        again = p.startswith("!")
        out = F.when(matches(path, [p.lstrip("!")]), F.lit(again)).otherwise(out)
    return out


def under(path: Column, prefix: str) -> Column:
    """Component-wise prefix."""
    return (path == prefix) | path.startswith(prefix.rstrip("/") + "/")


def first_match(*rewrites: Column) -> Column:
    """OR of rewriting predicates: the first that isn't null decides."""
    return F.coalesce(*rewrites)


def shebang_language(text: Column, interpreters: dict[str, str]) -> Column:
    """Language by the interpreter of the first line, also behind env; versions are cut off."""
    line = F.regexp_extract(text, r"^#!\s*([^\n]*)", 1)
    command = F.regexp_replace(line, r"^\S*/env\s+(-\S+\s+)*", "")
    name = F.regexp_replace(F.regexp_extract(command, r"^(?:\S*/)?([^/\s]+)", 1), r"[0-9.]+$", "")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in interpreters.items() for x in pair]), name)


def ancestors(path: Column) -> Column:
    """Directories above a path, the nearest last; none for a bare name."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def roll_up(stats: DataFrame, sums: Sequence[str] = SUMS) -> DataFrame:
    """Sums of every file in each directory above it; null counts as 0.

    Map tasks add up what they can before the shuffle by directory, so a root that all
    files share isn't gathered row by row.
    """
    rows = stats.select(F.explode(ancestors(F.col("path"))).alias("path"), *sums)
    return rows.groupBy("path").agg(*[F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in sums]).select(F.lit("DIRECTORY").alias("kind"), "path", *sums)


def grand_total(stats: DataFrame, sums: Sequence[str] = SUMS) -> DataFrame:
    return stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in sums]).select(F.lit("TOTAL").alias("kind"), F.lit("TOTAL").alias("path"), *sums)


def depth_at_most(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.size(F.split("path", "/")) <= n)


def stats_order(df: DataFrame, column: str = "path", limit: int | None = None) -> DataFrame:
    """Names ascend, numbers descend; equal ones by name."""
    out = df.orderBy("path") if column == "path" else df.orderBy(F.desc(column), "path")
    return out if limit is None else out.limit(limit)


def deepest(df: DataFrame, markers: DataFrame, name: str) -> DataFrame:
    """``name``: the deepest marker directory (path) that is an ancestor; null if none is.

    Ancestors are exploded and joined by equality; distinct directories only, so files of
    one directory share the look-up.
    """
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    rows = df.withColumn("_dir", parent)
    dirs = rows.select("_dir").distinct().withColumn("_up", F.explode(F.concat(F.array(F.lit("")), ancestors(F.concat("_dir", F.lit("/x"))))))
    found = dirs.join(markers.select(F.col("path").alias("_up")).distinct(), "_up").groupBy("_dir").agg(F.max_by("_up", F.length("_up")).alias(name))
    return rows.join(found, "_dir", "left").drop("_dir")


def changed_only(files: DataFrame, changed: DataFrame) -> DataFrame:
    return files.join(changed.select("path").distinct(), "path", "left_semi")


def split_cached(targets: DataFrame, cache: DataFrame, key: str = "digest") -> DataFrame:
    """``targets`` with ``hit``: whether their digest is in the cache."""
    return targets.join(cache.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def plugins_for(paths: DataFrame, globs_of: dict[str, Sequence[str]]) -> DataFrame:
    """(plugin, files): files that any glob of a plugin matches; plugins are few, paths are read once."""
    hits = F.array_compact(F.array(*[F.when(matches(F.col("path"), g), F.lit(p)) for p, g in sorted(globs_of.items())]))
    return paths.select(F.explode(hits).alias("plugin")).groupBy("plugin").agg(F.count("*").alias("files"))


def sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in seeded random order."""
    return df.orderBy(F.xxhash64(F.lit(seed), "path"), "path").limit(n)


def source_roots(files: DataFrame) -> DataFrame:
    """Java and Kotlin roots ``**/src/*/{java,kotlin}``, without test, build and node_modules ones."""
    roots = files.select(F.regexp_extract("path", r"^((?:.*/)?src/[^/]+/(?:java|kotlin))/", 1).alias("root")).where("root <> ''").distinct()
    words = F.transform(F.regexp_extract_all("root", F.lit("[A-Z]+(?![a-z])|[A-Z]?[a-z]+"), F.lit(0)), F.lower)
    skip = F.arrays_overlap(words, F.array(*[F.lit(w) for w in ("test", "tests", "testing", "tester", "build")])) | F.array_contains(F.split("root", "/"), "node_modules")
    return roots.where(~skip).orderBy("root")


# Paths that no analysis looks at unless told to.
DEFAULT_EXCLUDES = (
    "*_min.*", "*-min.*", "*.min.*", "**/.yarn/**", "**/*.d.ts", "**/bower_components/**", "**/build/**", "**/cache/**", "**/config/**", "**/db/**", "**/deps/**", "**/dist/**", "**/extern/**",
    "**/external/**", "**/fixtures/**", "**/generated/**", "**/Godeps/**", "**/gradlew/**", "**/mvnw/**", "**/node_modules/**", "**/protos/**", "**/seed/**", "**/target/**", "**/testdata/**", "**/vendor/**",
)


def analysed(df: DataFrame, excludes: Sequence[str] = DEFAULT_EXCLUDES, tests: Sequence[str] = (), exclude_tests: bool = False) -> DataFrame:
    """Rows whose path no exclude takes out; patterns of tests are excludes, the last ones, where tests are excluded."""
    patterns = [*excludes, *(tests if exclude_tests else ())]
    return df.where(keep_by_patterns(F.col("path"), patterns))


def plugin_excluded(pairs: DataFrame, excludes: dict[str, Sequence[str]]) -> DataFrame:
    """(plugin, path) pairs without those that an exclude of their own plugin matches."""
    hit = F.lit(False)
    for plugin, patterns in excludes.items():
        hit = hit | ((F.col("plugin") == plugin) & matches(F.col("path"), patterns))
    return pairs.where(~hit)


def requested(rows: DataFrame, filters: Sequence[str]) -> DataFrame:
    """Rows whose path is one of the filters, matches one, or lies in one that is a directory; all with a path if there are none."""
    rows = rows.where(F.col("path").isNotNull())
    if not filters:
        return rows
    inside = F.lit(False)
    for f in filters:
        inside = inside | under(F.col("path"), f) | matches(F.col("path"), [f])
    return rows.where(inside)
