"""Files of a tree as a walk finds them: ignore rules, size, links, chosen paths.

Ignore files are rows (dir, contents): rules hold for what lies below their directory. A file
or directory is decided by the deepest directory that has a matching rule, and there by the
last one; a rule with ``!`` takes it back in. What lies in an ignored directory is ignored
whatever other rules say.

Every directory above a file is decided once, not once for each file. Rules that name a file or
directory plainly match by an equi-join on (directory, name); others, whose number decides
whether they are broadcast, join on their directory and match by a regular expression that is
built from the pattern in SQL.

Patterns: ``*`` and ``?`` within a name, ``[...]``, ``**/`` and ``/**`` over directories, ``\\``
before a character; with a slash at the start or within they start at the rule's directory, else
they match names at any depth; a slash at the end asks for a directory.

Defined cases: null or empty ignore files have no rules; ``#`` begins a comment, blanks at the
end don't count; null paths are left out; a file listed twice is found twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.paths import MAX_FILE_BYTES, ancestors, under
from ..storage import stored

#: Most rules or ignored directories that are broadcast; more meet the paths in a shuffle join.
BROADCAST_ROWS = 1 << 18
#: Never walked, whatever the rules say.
ALWAYS = ".git/"
# Parts of a pattern, longest first.
TOKENS = r"^\*\*/|/\*\*/|/\*\*$|\*+|\?|\[[!^]?\]?[^\]]*\]|\\.|."


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def pattern_regex(pattern: Column) -> Column:
    """The regular expression of a pattern without ``!`` and outer slashes."""

    def piece(t):
        quoted = F.concat(F.lit("\\Q"), F.when(t.startswith("\\"), F.substring(t, 2, 1)).otherwise(t), F.lit("\\E"))
        inner = F.substring(t, F.lit(2), F.length(t) - 1)
        kind = F.when(inner.startswith("!") | inner.startswith("^"), F.concat(F.lit("[^/"), F.substring(inner, F.lit(2), F.length(inner)))).otherwise(F.concat(F.lit("(?!/)["), inner))
        return (
            F.when(t == "**/", "(?:.*/)?").when(t == "/**/", "/(?:.*/)?").when(t == "/**", "/.+")
            .when(t.startswith("*"), "[^/]*").when(t == "?", "[^/]").when(t.startswith("[") & (F.length(t) > 2), kind).otherwise(quoted)
        )

    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(F.regexp_extract_all(pattern, F.lit("(?s)" + TOKENS), F.lit(0)), piece), ""), F.lit("$"))


def rules(ignore_files: DataFrame) -> DataFrame:
    """(dir, nth, again, directories, anchored, plain, regex) of (dir, contents); ``dir`` is '' for the root."""
    rows = ignore_files.select("dir", F.posexplode(F.split("contents", "\r?\n")).alias("nth", "line"))
    line = F.regexp_replace("line", r"(?<!\\)[ \t]+$", "")
    rows = rows.select("dir", "nth", line.alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    rows = rows.withColumn("again", F.col("line").startswith("!")).withColumn("line", F.regexp_replace("line", "^!", ""))
    rows = rows.withColumn("directories", F.col("line").endswith("/")).withColumn("line", F.regexp_replace("line", "/$", ""))
    rows = rows.withColumn("anchored", F.col("line").contains("/")).withColumn("line", F.regexp_replace("line", "^/", "")).where("line <> ''")
    plain = ~F.col("anchored") & ~F.col("line").rlike(r"[*?\[\\]")
    return rows.select("dir", "nth", "again", "directories", "anchored", F.when(plain, F.col("line")).alias("plain"), pattern_regex(F.col("line")).alias("regex"))


def ignored(paths: DataFrame, ignore_files: DataFrame) -> DataFrame:
    """(entry) of files of ``paths`` (path), and directories above them, that a rule ignores; not what lies in them."""
    dirs = paths.select(F.explode(ancestors(F.col("path"))).alias("entry"), F.lit(True).alias("directory"))
    entries = stored(dirs.unionByName(paths.select(F.col("path").alias("entry"), F.lit(False).alias("directory"))).distinct(), "walk-entries")
    above = entries.withColumn("dir", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("entry")))))
    above = above.withColumn("name", F.element_at(F.split("entry", "/"), -1))
    own = stored(rules(ignore_files), "walk-rules")
    fits = F.col("directory") | ~F.col("directories")
    plain = above.join(_few(own.where("plain IS NOT NULL").withColumnRenamed("plain", "name")), ["dir", "name"]).where(fits)
    below = F.when(F.col("dir") == "", F.col("entry")).otherwise(F.substring("entry", F.length("dir") + 2, F.length("entry")))
    others = above.join(_few(own.where("plain IS NULL").drop("plain")), "dir").where(fits)
    others = others.withColumn("below", below).where(F.expr("rlike(if(anchored, below, name), regex)"))
    hits = plain.select("entry", "directory", "dir", "nth", "again").unionByName(others.select("entry", "directory", "dir", "nth", "again"))
    deep = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    decided = hits.groupBy("entry", "directory").agg(F.max_by("again", F.struct(deep, "nth")).alias("again"))
    return decided.where("NOT again").select("entry", "directory")


def walk(files: DataFrame, ignore_files: DataFrame, roots: Sequence[str] = (), max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """The rows of ``files`` (path, size, link) that a walk of ``roots``, or of all, comes to.

    Links and files of over ``max_bytes`` are passed over, hidden files aren't. A root that is
    ignored itself is walked all the same, and so is what lies in it as far as rules below let it.
    """
    some = files.where(F.col("path").isNotNull() & ~F.coalesce("link", F.lit(False)) & (F.col("size") <= max_bytes))
    if roots:
        chosen = F.lit(False)
        for r in roots:
            chosen = chosen | under(F.col("path"), r)
        some = some.where(chosen)
    always = ignore_files.sparkSession.createDataFrame([("", ALWAYS)], "dir string, contents string")
    own = ignore_files.groupBy("dir").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("rank", F.lit(0)) if "rank" in ignore_files.columns else F.lit(0), "contents"))), lambda x: x["contents"]), "\n").alias("contents"))
    out = stored(ignored(some.select("path"), own), "walk-ignored")
    git = ignored(some.select("path"), always)
    steps = some.select("path", F.posexplode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("_k", "entry")).withColumn("directory", F.col("entry") != F.col("path"))
    if roots:
        inside = F.lit(False)  # entries at or above a root don't decide
        for r in roots:
            inside = inside | under(F.col("entry"), r) & (F.col("entry") != r.rstrip("/"))
        steps = steps.where(inside)
    gone = steps.join(_few(out.unionByName(git).distinct()), ["entry", "directory"], "left_semi").select("path").distinct()
    return some.join(gone, "path", "left_anti").select(*files.columns)
