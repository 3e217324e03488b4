"""Path, roll-up and look-up queries, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import FILES_SQL, ISSUES_SQL, STATS_SQL, dealt, files, issues, stats
from ..catalog import query
from ..functions import text as X
from ..operators import coverage, paths
from ..operators.issues import positions
from ..sources import walks

PATHS_SQL = f"WITH {ISSUES_SQL}, p AS (SELECT DISTINCT path FROM issues)"
SUMS = ", ".join(f"CAST(sum(coalesce({c}, 0)) AS BIGINT) AS {c}" for c in paths.SUMS)


def distinct_paths(t):
    return issues(t).select("path").distinct()


@query("f02_globs", f"{PATHS_SQL} SELECT path FROM p WHERE regexp_matches(path, '^pkg[0-3]/(?:.*/)?f[^/]*1\\.py$')")
def f02(t):
    """Paths that a glob includes."""
    return paths.globs(distinct_paths(t), ["pkg[0-3]/**/f*1.py"])


@query("f03_exclude_groups", f"{PATHS_SQL} SELECT path, CASE WHEN regexp_matches(path, 'f[^/]*5\\.py$') THEN false WHEN regexp_matches(path, '^pkg1/mod[^/]*/') THEN true WHEN starts_with(path, 'pkg1/') THEN false ELSE true END AS kept FROM p")
def f03(t):
    """Exclude patterns; the last match wins."""
    return distinct_paths(t).withColumn("kept", paths.keep_by_patterns(F.col("path"), ["pkg1/**", "!pkg1/mod*/**", "**/f*5.py"]))


@query("f05_prefix", f"{PATHS_SQL} SELECT path FROM p WHERE starts_with(path, 'pkg2/mod3/') OR path = 'pkg2/mod3'")
def f05(t):
    """Paths under a directory."""
    return distinct_paths(t).where(paths.under(F.col("path"), "pkg2/mod3"))


@query("f06_first_match", f"{PATHS_SQL} SELECT path, CASE WHEN starts_with(path, 'pkg0/') THEN 'core' WHEN regexp_matches(path, '7\\.py$') THEN 'seven' END AS tag FROM p WHERE starts_with(path, 'pkg0/') OR regexp_matches(path, '7\\.py$')")
def f06(t):
    """OR of predicates that rewrite the row; the first match decides."""
    tag = paths.first_match(F.when(F.col("path").startswith("pkg0/"), "core"), F.when(F.col("path").rlike(r"7\.py$"), "seven"))
    return distinct_paths(t).withColumn("tag", tag).where("tag IS NOT NULL")


@query("x10_language_by_extension", "SELECT p_partkey, ['python', 'rust', 'typescript', NULL, 'java'][1 + p_partkey % 5] AS language FROM part")
def x10(t):
    """Languages by file extension."""
    names = F.element_at(F.array(*[F.lit(n) for n in ("a/x.py", "b.RS", "c.d.ts", "Makefile", "q/Z.java")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t("part").select("p_partkey", X.language_of(names).alias("language"))


@query("f08_shebang", "SELECT p_partkey, ['python', 'shell', 'ruby', NULL, 'shell'][1 + p_partkey % 5] AS language FROM part")
def f08(t):
    """Languages by interpreter line."""
    heads = F.element_at(F.array(*[F.lit(n) for n in ("#!/usr/bin/env python3.11\nx", "#! /bin/bash -e\n", "#!/usr/bin/env -S ruby\n", "no line", "#!/usr/local/bin/sh")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t("part").select("p_partkey", paths.shebang_language(heads, {"python": "python", "bash": "shell", "sh": "shell", "ruby": "ruby"}).alias("language"))


UP_SQL = f"""WITH {STATS_SQL}, parts AS (SELECT *, string_split(path, '/') AS s FROM stats), up AS (SELECT unnest(range(1, len(s))) AS k, * FROM parts),
  dirs AS (SELECT array_to_string(s[1:k], '/') AS dir, * FROM up), rolled AS (SELECT 'DIRECTORY' AS kind, dir AS path, {SUMS} FROM dirs GROUP BY dir)"""


@query("a06_directory_rollup", f"{UP_SQL} SELECT * FROM rolled")
def a06(t):
    """Sums of each directory."""
    return paths.roll_up(stats(t))


@query("a07_grand_total", f"WITH {STATS_SQL} SELECT 'TOTAL' AS kind, 'TOTAL' AS path, {SUMS} FROM stats")
def a07(t):
    """Sums over everything."""
    return paths.grand_total(stats(t))


@query("a11_stats_by_directory", f"WITH {STATS_SQL} SELECT split_part(path, '/', 1) AS dir, count(*) AS n, CAST(max(coalesce(lcom4, 0)) AS BIGINT) AS lcom4 FROM stats WHERE kind = 'FILE' GROUP BY 1")
def a11(t):
    """File stats grouped; LCOM4 is a maximum."""
    return stats(t).where("kind = 'FILE'").groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("dir")).agg(F.count("*").alias("n"), F.max(F.coalesce("lcom4", F.lit(0))).cast("bigint").alias("lcom4"))


@query("f29_directory_depth", f"{UP_SQL} SELECT path FROM rolled WHERE len(string_split(path, '/')) <= 2")
def f29(t):
    """Directories down to a depth."""
    return paths.depth_at_most(paths.roll_up(stats(t)), 2).select("path")


@query("o04_sorted_stats", f"WITH {STATS_SQL} SELECT path, lines FROM stats ORDER BY lines DESC, path LIMIT 25")
def o04(t):
    """The 25 longest files."""
    return paths.stats_order(stats(t).select("path", "lines"), "lines", 25)


@query("o04_stats_positions", f"WITH {STATS_SQL} SELECT path, lines, row_number() OVER (ORDER BY lines DESC, path) AS position FROM stats")
def o04_positions(t):
    """Every file with its place by length."""
    return positions(paths.stats_order(stats(t).select("path", "lines"), "lines"))


@query("o05_limited_names", f"{UP_SQL} SELECT path, lines FROM rolled ORDER BY path LIMIT 10")
def o05(t):
    """The first ten directories by name."""
    return paths.stats_order(paths.roll_up(stats(t)).select("path", "lines"), "path", 10)


DEEPEST = """up AS (SELECT DISTINCT path, unnest(list_concat([''], list_transform(range(1, len(string_split(path, '/'))), lambda k: array_to_string(string_split(path, '/')[1:k], '/')))) AS dir FROM p)"""


def markers(t):
    return distinct_paths(t).select(F.explode(F.array(F.lit(""), F.lit("pkg1"), F.lit("pkg1/mod3"), F.lit("pkg4/mod10"), F.lit("pkg5"))).alias("path")).distinct()


MARKERS = "m(path) AS (VALUES (''), ('pkg1'), ('pkg1/mod3'), ('pkg4/mod10'), ('pkg5'))"


@query("j10_deepest_config", f"{PATHS_SQL}, {MARKERS}, {DEEPEST} SELECT p.path, max_by(m.path, length(m.path)) AS config FROM p JOIN up USING (path) JOIN m ON m.path = up.dir GROUP BY p.path")
def j10(t):
    """The deepest configuration above a file."""
    return paths.deepest(distinct_paths(t), markers(t), "config")


@query("j11_nearest_marker", f"{PATHS_SQL}, {MARKERS}, {DEEPEST} SELECT p.path, max_by(m.path, length(m.path)) AS root FROM p LEFT JOIN (SELECT up.path AS target, m.path FROM up JOIN m ON m.path = up.dir AND m.path <> '') m ON m.target = p.path GROUP BY p.path")
def j11(t):
    """The nearest directory with a marker, or none."""
    return paths.deepest(distinct_paths(t), markers(t).where("path <> ''"), "root")


@query("j08_issues_of_entries", f"WITH {ISSUES_SQL}, e AS (SELECT DISTINCT path FROM issues WHERE path LIKE '%3.py') SELECT e.path, count(i.id) AS n FROM e LEFT JOIN issues i ON i.path = e.path AND i.level = 50 GROUP BY e.path")
def j08(t):
    """Workspace entries with their issues; issues of other paths are dropped."""
    rows = issues(t)
    return rows.where("path LIKE '%3.py'").select("path").distinct().join(rows.where("level = 50").select("path", "id"), "path", "left").groupBy("path").agg(F.count("id").alias("n"))


@query("j13_cache_join", f"WITH {FILES_SQL}, c AS (SELECT md5(contents) AS digest FROM files WHERE path LIKE 'src1%') SELECT path, md5(contents) IN (SELECT digest FROM c) AS hit FROM files")
def j13(t):
    """Targets whose digest is cached."""
    targets = files(t).select("path", X.content_digest(F.col("contents")).alias("digest"))
    return paths.split_cached(targets, targets.where("path LIKE 'src1%'")).select("path", "hit")


@query("j16_plugins_for_paths", f"{PATHS_SQL} SELECT 'a' AS plugin, count(*) AS files FROM p WHERE regexp_matches(path, '^(?:.*/)?[^/]*\\.py$') UNION ALL SELECT 'b', count(*) FROM p WHERE regexp_matches(path, '^pkg6/')")
def j16(t):
    """Files of each plugin by globs."""
    return paths.plugins_for(distinct_paths(t), {"a": ["**/*.py"], "b": ["pkg6/**"]})


@query("s03_changed_files", f"WITH {FILES_SQL} SELECT path FROM files WHERE path LIKE '%/en/%' AND path IN (SELECT path FROM files WHERE path LIKE 'src1%')")
def s03(t):
    """Changed files that exist."""
    return paths.changed_only(files(t).where("path LIKE '%/en/%'").select("path"), files(t).where("path LIKE 'src1%'"))


@query("s04_size_limit", f"WITH {FILES_SQL} SELECT path, strlen(contents) AS bytes FROM files WHERE strlen(contents) <= 4000")
def s04(t):
    """Files up to a size."""
    return files(t).select("path", F.octet_length("contents").cast("bigint").alias("bytes")).where("bytes <= 4000")


@query("s10_source_files", f"WITH {FILES_SQL} SELECT path, md5(contents) AS digest FROM files WHERE contents IS NOT NULL")
def s10(t):
    """Readable files with their digests."""
    return files(t).where("contents IS NOT NULL").select("path", X.content_digest(F.col("contents")).alias("digest"))


@query("s20_source_roots", "SELECT DISTINCT 'app' || (p_partkey % 20) || '/src/main/java' AS root FROM part WHERE p_partkey % 3 = 0")
def s20(t):
    """Source roots of Java projects, without tests."""
    kind = F.element_at(F.array(F.lit("main/java"), F.lit("test/java"), F.lit("integrationTest/kotlin")), (F.col("p_partkey") % 3 + 1).cast("int"))
    path = F.concat(F.lit("app"), (F.col("p_partkey") % 20).cast("string"), F.lit("/src/"), kind, F.lit("/com/A.java"))
    return paths.source_roots(t("part").select(path.alias("path")))


@query("a23_text_lines", f"""WITH {FILES_SQL}, l AS (SELECT path, unnest(string_split(contents, chr(10))) AS line FROM files)
  SELECT path, count(*) AS lines, count(*) FILTER (trim(line) = '') AS blank_lines, count(*) FILTER (starts_with(line, '#')) AS comment_lines FROM l GROUP BY path""")
def a23(t):
    """Lines of texts: all, blank and comments."""
    lines = F.split("contents", "\n")
    count = lambda test: F.size(F.filter(lines, test)).cast("bigint")
    return files(t).where("contents IS NOT NULL").select("path", F.size(lines).cast("bigint").alias("lines"), count(lambda x: F.trim(x) == "").alias("blank_lines"), count(lambda x: x.startswith("#")).alias("comment_lines"))


@query("x03_digests", "SELECT p_partkey, md5(p_name) AS digest, md5(unhex(hex(p_name)) || unhex(md5(p_brand))) AS node FROM part")
def x03(t):
    """Content and structural digests."""
    return t("part").select("p_partkey", X.content_digest(F.col("p_name")).alias("digest"), X.node_digest(F.col("p_name"), F.array(F.md5(F.col("p_brand").cast("binary")))).alias("node"))


@query("x05_effort", "SELECT l_orderkey, l_linenumber, CAST(10 + l_linenumber * 5 AS BIGINT) AS effort FROM lineitem")
def x05(t):
    """Effort in minutes."""
    return t("lineitem").select("l_orderkey", "l_linenumber", X.effort_minutes(10, F.col("l_linenumber"), 5).alias("effort"))


@query("x07_level_names", "SELECT o_orderkey, CAST(CASE lower(split_part(o_orderpriority, '-', 2)) WHEN 'high' THEN 50 WHEN 'medium' THEN 40 WHEN 'low' THEN 30 ELSE 0 END AS BIGINT) AS level FROM orders")
def x07(t):
    """Levels by name."""
    return t("orders").select("o_orderkey", X.level_from_name(F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)))).alias("level"))


@query("x12_words", "SELECT p_partkey, 'get,http,response,2' AS words FROM part")
def x12(t):
    """Words of identifiers."""
    return t("part").select("p_partkey", F.array_join(X.words(F.lit("getHTTPResponse_2")), ",").alias("words"))


@query("x17_versions", "SELECT p_partkey, p_size > 9 OR (p_size = 9 AND p_partkey % 30 >= 12) AS newer FROM part")
def x17(t):
    """Versions compared by number."""
    own = F.concat(F.lit("v"), "p_size", F.lit("."), F.col("p_partkey") % 30, F.lit(".1"))
    return t("part").select("p_partkey", (X.version_parts(own) >= X.version_parts(F.lit("9.12"))).alias("newer"))


@query("f30_glob_ignores", f"{PATHS_SQL} SELECT path FROM p WHERE NOT regexp_matches(path, '^pkg[0-9]+/mod(1|2)/') ")
def f30(t):
    """Paths outside alternatives of a glob."""
    return coverage.ignore(distinct_paths(t), ["pkg*/mod{1,2}/**"])


def tree(t):
    """Six files a part in nested directories, and the ignore files of the tree: rules of the root, of each third directory, and one that takes files back in."""
    names = F.array(*[F.lit(x) for x in ("a.py", "b.log", "keep.log", "build/x.o", "lib/build", ".git/config")])
    top = F.concat(F.lit("d"), F.pmod("p_partkey", F.lit(9)).cast("string"), F.lit("/p"), F.col("p_partkey").cast("string"))
    files = dealt(t("part")).withColumn("name", F.explode(names)).select(F.concat(top, F.lit("/"), "name").alias("path"), F.lit(10).cast("long").alias("size"), (F.col("p_size") % 10 == 0).alias("link"), "p_size")
    files = files.withColumn("size", F.when((F.col("p_size") % 10 == 1) & F.col("path").endswith(".py"), 3_000_000).otherwise(F.col("size"))).drop("p_size")
    own = t("part").select(F.concat(F.lit("d"), F.pmod("p_partkey", F.lit(9)).cast("string")).alias("dir")).distinct().where("CAST(substring(dir, 2) AS int) % 3 = 0").select("dir", F.lit("!keep.log\n").alias("contents"))
    root = own.sparkSession.createDataFrame([("", "*.log\nbuild/\n# comment\n"), ("d1", "/p*/a.py\n"), ("d2", "*\n!b.log\n")], "dir string, contents string")
    return files, root.unionByName(own)


@query("s02_walked_files", """WITH f AS (SELECT 'd' || (p_partkey % 9) || '/p' || p_partkey AS top, p_partkey % 9 AS d, p_size % 10 AS s, unnest(['a.py', 'b.log', 'keep.log', 'build/x.o', 'lib/build', '.git/config']) AS name FROM part)
  SELECT top || '/' || name AS path FROM f WHERE s <> 0 AND d <> 2 AND CASE name WHEN 'a.py' THEN d <> 1 AND s <> 1 WHEN 'keep.log' THEN d % 3 = 0 WHEN 'lib/build' THEN true ELSE false END""")
def s02(t):
    """Files that ignore files of nested directories, sizes and links leave."""
    return walks.walk(*tree(t)).select("path")


@query("s02_walked_from_roots", """WITH f AS (SELECT 'd' || (p_partkey % 9) || '/p' || p_partkey AS top, p_partkey % 9 AS d, p_size % 10 AS s, unnest(['a.py', 'keep.log', 'lib/build']) AS name FROM part)
  SELECT top || '/' || name AS path FROM f WHERE s <> 0 AND d IN (0, 4) AND CASE name WHEN 'a.py' THEN s <> 1 WHEN 'keep.log' THEN d % 3 = 0 ELSE true END""")
def s02_roots(t):
    """The same of two directories only."""
    return walks.walk(*tree(t), roots=["d0", "d4/"]).select("path")


@query("s04_ignored_entries", "SELECT DISTINCT 'd' || (p_partkey % 9) || '/p' || p_partkey || '/build' AS entry FROM part WHERE p_partkey % 9 <> 2 UNION ALL SELECT DISTINCT 'd2/p' || p_partkey FROM part WHERE p_partkey % 9 = 2 UNION ALL SELECT DISTINCT 'd2/p' || p_partkey || u.x FROM part, unnest(['/build', '/lib', '/.git']) AS u(x) WHERE p_partkey % 9 = 2")
def s04_ignored(t):
    """Directories that a rule ignores."""
    files, rules = tree(t)
    return walks.ignored(files.select("path"), rules).where("directory").select("entry")
