"""Fixes of linters from their output to patched files, byte offsets, and the issue cache, over inputs made from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import dealt
from ..catalog import query
from ..operators import offsets, patches
from ..operators.issue_cache import DAY_MS, IssueCache
from ..sources import fixes
from ..storage import scratch

def key():
    return F.col("p_partkey").cast("string")


def linted(t, contents: str, output: str):
    """A file a part and the tool's output on it; both are SQL expressions."""
    rows = dealt(t("part")).select("p_partkey", F.concat(F.lit("p"), key()).alias("path"), F.expr(contents).alias("contents"), F.expr(output).alias("output"))
    return rows.select("path", "contents"), rows.select(key().alias("file"), "output")


def fixed(files, suggestions):
    """Files with all suggestions applied that fit."""
    rows = suggestions.withColumn("position", F.col("nth").cast("bigint"))
    return patches.apply_patches(files, patches.build_patches(rows, files)).select("path", "contents")


CODE = "concat('é = ', p_partkey, '\\ny = 2\\nz\\n')"


@query("l25_ruff_fixed", "SELECT 'p' || p_partkey AS path, 'e = N' || chr(10) || 'y = 2' || chr(10) || 'z' || chr(10) AS contents FROM part WHERE p_partkey % 5 <> 0")
def l25_fixed(t):
    """Files with Ruff's edits, by line and column behind a character of two bytes; a fifth leave the file."""
    place = "named_struct('row', {0}, 'column', {1})".format
    edit = "named_struct('content', {0}, 'location', {1}, 'end_location', {2})".format
    two = edit("'N'", place("1", "5"), place("if(p_partkey % 5 = 0, 99, 1)", "5 + length(string(p_partkey))"))
    files, outputs = linted(t, CODE, f"to_json(array(named_struct('code', 'R1', 'filename', concat('p', p_partkey), 'fix', named_struct('edits', array({edit(repr('e'), place('1', '1'), place('1', '2'))}, {two})))))")
    return fixed(files, fixes.ruff(outputs))


@query("l26_shellcheck_fixed", "SELECT 'p' || p_partkey AS path, 'é = ' || p_partkey || chr(10) || 'y = ' || p_size || chr(10) || 'z' || chr(10) AS contents FROM part WHERE p_size <> 2")
def l26_fixed(t):
    """Files with ShellCheck's replacements; where nothing changes there is no patch."""
    fix = "named_struct('replacements', array(named_struct('line', 2, 'column', 5, 'endLine', 2, 'endColumn', 6, 'replacement', string(p_size))))"
    files, outputs = linted(t, CODE, f"to_json(array(named_struct('file', concat('p', p_partkey), 'code', 1, 'fix', {fix})))")
    return fixed(files, fixes.shellcheck(outputs))


@query("l11_eslint_suggestions", """SELECT 'p' || p_partkey AS path, 'fix' AS id, CAST(5 + length(CAST(p_partkey AS VARCHAR)) + 1 AS BIGINT) AS start_byte, 'const' AS data FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT 'p' || p_partkey, 's' || u.k, CAST(u.k AS BIGINT), 'x' FROM part, range(2) u(k) WHERE p_partkey % 3 <> 0""")
def l11_suggestions(t):
    """ESLint's fixes, their characters counted in bytes of the source, or its suggestions."""
    fix = "if(p_partkey % 3 = 0, named_struct('range', array(4 + length(string(p_partkey)) + 1, 4 + length(string(p_partkey)) + 2), 'text', 'const'), null)"
    others = "transform(array(0, 1), k -> named_struct('messageId', concat('s', k), 'desc', 'd', 'fix', named_struct('range', array(k, k), 'text', 'x')))"
    _, outputs = linted(t, CODE, f"to_json(array(named_struct('filePath', concat('p', p_partkey), 'source', {CODE}, 'messages', array(named_struct('ruleId', 'r', 'line', 1, 'column', 1, 'fix', {fix}, 'suggestions', {others})))))")
    rows = fixes.eslint(outputs).withColumn("r", F.col("replacements")[0])
    return rows.select("path", "id", F.col("r.start_byte").alias("start_byte"), F.col("r.data").alias("data"))


LINES = "concat('é = 1\\nkeep\\nkeep\\nx', p_partkey, '\\nend\\n')"
DELTA = """named_struct('dictionary', concat('x', p_partkey, '\\ny\\nend\\n'), 'ops', array(named_struct('equalLines', named_struct('line_count', 2), 'diffOp', null),
  named_struct('equalLines', null, 'diffOp', named_struct('delete', named_struct('range', array(0, 2 + length(string(p_partkey)))), 'insert', null)),
  named_struct('equalLines', null, 'diffOp', named_struct('delete', null, 'insert', named_struct('range', array(2 + length(string(p_partkey)), 4 + length(string(p_partkey))))))))"""
BIOME = f"""to_json(named_struct('diagnostics', array(named_struct('category', 'lint/x', 'severity', if(p_partkey % 2 = 0, 'error', 'information'), 'description', p_name,
  'location', named_struct('path', named_struct('file', concat('p', p_partkey)), 'span', array(17, 18 + length(string(p_partkey))), 'sourceCode', if(p_partkey % 7 = 0, null, {LINES})),
  'advices', named_struct('advices', array(named_struct('diff', null), named_struct('diff', {DELTA})))))))"""


@query("l07_biome", """SELECT 'p' || p_partkey AS path, p_name AS message, CAST(CASE WHEN p_partkey % 2 = 0 THEN 50 ELSE 40 END AS BIGINT) AS level, CAST(CASE WHEN p_partkey % 7 <> 0 THEN 4 END AS BIGINT) AS start_line,
  CAST(CASE WHEN p_partkey % 7 <> 0 THEN 1 END AS BIGINT) AS start_column, CAST(CASE WHEN p_partkey % 7 <> 0 THEN 2 + length(CAST(p_partkey AS VARCHAR)) END AS BIGINT) AS end_column FROM part""")
def l07(t):
    """Biome's issues; spans of bytes as lines and columns."""
    _, outputs = linted(t, LINES, BIOME)
    return fixes.biome(outputs).select("path", "message", "level", "start_line", "start_column", "end_column")


@query("l07_biome_fixed", "SELECT 'p' || p_partkey AS path, 'é = 1' || chr(10) || 'keep' || chr(10) || 'keep' || chr(10) || 'y' || chr(10) || 'end' || chr(10) AS contents FROM part WHERE p_partkey % 7 <> 0")
def l07_fixed(t):
    """Files with Biome's deltas applied."""
    files, outputs = linted(t, LINES, BIOME)
    return fixed(files, fixes.biome_fixes(outputs))


@query("x09_bytes_and_places", "SELECT 'p' || p_partkey AS path, CAST(CASE WHEN p_size % 11 <= p_size % 5 THEN 3 * (p_size % 11) + 2 END AS BIGINT) AS at, CAST(CASE WHEN p_size % 11 <= p_size % 5 THEN p_size % 11 + 1 END AS BIGINT) AS line, CAST(CASE WHEN p_size % 11 <= p_size % 5 THEN 2 END AS BIGINT) AS column_ FROM part")
def x09(t):
    """Lines and columns to bytes, and back by an as-of look-up; lines behind the last have none."""
    rows = dealt(t("part")).select(F.concat(F.lit("p"), key()).alias("path"), F.expr("repeat('é\n', p_size % 5 + 1)").alias("contents"), (F.col("p_size") % 11 + 1).cast("bigint").alias("l"))
    index = offsets.line_index(rows)
    found = offsets.with_bytes(rows.select("path", "l", F.lit(2).alias("c")), index, "l", "c", "at")
    back = offsets.with_places(found.where("at IS NOT NULL").select("path", "at"), index, "at", "line", "column_")
    return back.unionByName(found.where("at IS NULL").select("path", "at", F.lit(None).cast("bigint").alias("line"), F.lit(None).cast("bigint").alias("column_")))


# ------------------------------------------------------------------ cache


def cached_parts(t):
    """Targets whose content is the part's size: files that share it share an entry."""
    return t("part").select(F.concat(F.lit("p"), key()).alias("path"), "p_size", F.md5(F.col("p_size").cast("string").cast("binary")).alias("key"))


def parse(todo):
    """p_size % 3 issues of a target."""
    return todo.withColumn("line", F.explode(F.expr("if(p_size % 3 > 0, sequence(1L, greatest(1, p_size % 3)), cast(array() AS array<bigint>))"))).select("key", "line")


def cache(t):
    spark = t("part").sparkSession
    return IssueCache(spark, scratch(spark, "cache"), "line long")


@query("u06_cached_issues", "SELECT 'p' || p_partkey AS path, p_size % 2 = 0 AS hit, CAST(u.k AS BIGINT) AS line FROM part, unnest(range(1, 1 + p_size % 3)) AS u(k)")
def u06(t):
    """Issues of all targets, half of them from the cache of a run before."""
    kept, targets = cache(t), cached_parts(t)
    kept.run(targets.where("p_size % 2 = 0"), parse, now=0)
    return kept.run(targets, parse, now=DAY_MS).select("path", "hit", "line")


@query("s19_cache_entries", "SELECT md5(CAST(p_size AS VARCHAR)) AS key, CAST(p_size % 3 AS BIGINT) AS issues FROM part GROUP BY p_size")
def s19(t):
    """Entries of a cache, those without issues too."""
    kept = cache(t)
    kept.run(cached_parts(t), parse, now=0)
    return kept.entries().groupBy("key").agg(F.count("issue").alias("issues"))


@query("k12_pruned_cache", "SELECT md5(CAST(p_size AS VARCHAR)) AS key FROM part WHERE p_size % 2 = 1 OR p_size % 4 = 0 GROUP BY p_size")
def k12(t):
    """What a cache keeps of entries published or used in the last day."""
    kept, targets = cache(t), cached_parts(t)
    kept.run(targets.where("p_size % 2 = 0"), parse, now=0)
    kept.run(targets.where("p_size % 2 = 1"), parse, now=2 * DAY_MS)
    kept.run(targets.where("p_size % 4 = 0"), parse, now=2 * DAY_MS)
    kept.prune(days=1, now=int(2.5 * DAY_MS))
    return kept.entries().where("issue IS NULL").select("key")
