"""Package versions, manifests, default excludes, requested paths and whole reports, over inputs made from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import dealt
from ..catalog import query
from ..operators import issues, paths, trees, versions
from ..operators.trees import duplicates
from ..sources import manifests
from .tree_queries import heavy

def key():
    return F.col("p_partkey").cast("string")


@query("x17_requirements", """WITH v AS (SELECT p_partkey, p_size % 3 AS a, p_partkey % 10 AS b, p_size % 4 = 0 AS pre FROM part)
  SELECT p_partkey, u.r AS requirement, CASE u.r WHEN '^1.5' THEN a = 1 AND b >= 5 AND NOT pre WHEN '~1.5.0' THEN a = 1 AND b = 5 AND NOT pre WHEN '>=0.3, <1.2 || =2.*' THEN (a = 0 AND b >= 3 OR a = 1 AND b < 2 OR a = 2) AND NOT pre
    WHEN '>=1.4.0-beta' THEN (NOT pre OR (a = 1 AND b = 4)) AND (a > 1 OR a = 1 AND b >= 4) WHEN '^0.7' THEN a = 0 AND b = 7 AND NOT pre END AS fits FROM v, unnest(['^1.5', '~1.5.0', '>=0.3, <1.2 || =2.*', '>=1.4.0-beta', '^0.7']) AS u(r)""")
def x17_requirements(t):
    """Which versions fulfil five requirements, a quarter of them pre-releases."""
    own = F.concat(F.col("p_size") % 3, F.lit("."), F.col("p_partkey") % 10, F.lit(".0"), F.when(F.col("p_size") % 4 == 0, "-rc.1").otherwise(""))
    asked = [F.struct(F.lit(r).alias("requirement"), versions.intervals(F.lit(r)).alias("ranges")) for r in ("^1.5", "~1.5.0", ">=0.3, <1.2 || =2.*", ">=1.4.0-beta", "^0.7")]
    keyed = dealt(t("part").select("p_partkey", "p_size")).select("p_partkey", versions.version_key(own).alias("key"))
    rows = keyed.select("p_partkey", "key", F.explode(F.array(*asked)).alias("asked"))
    return rows.select("p_partkey", "asked.requirement", versions.within(F.col("key"), F.col("asked.ranges")).alias("fits"))


def packages(t):
    """A manifest and a lock file a part: package lib-(size % 5) asked for as ^(size % 3).(key % 4), locked at (size % 3).(key % 10).1, and a tool of its own."""
    lib = F.concat(F.lit("lib-"), F.col("p_size") % 5)
    asked = F.to_json(F.struct(F.create_map(lib, F.concat(F.lit("^"), F.col("p_size") % 3, F.lit("."), F.col("p_partkey") % 4)).alias("dependencies"), F.create_map(F.lit("tool"), F.lit("*")).alias("devDependencies")))
    version = F.struct(F.concat(F.col("p_size") % 3, F.lit("."), F.col("p_partkey") % 10, F.lit(".1")).alias("version"))
    locked = F.to_json(F.struct(F.create_map(F.concat(F.lit("node_modules/"), lib), version, F.lit("node_modules/a/node_modules/b"), version).alias("packages")))
    files = F.array(F.struct(F.lit("package.json").alias("name"), asked.alias("contents")), F.struct(F.lit("package-lock.json").alias("name"), locked.alias("contents")))
    return t("part").withColumn("f", F.explode(files)).select(F.concat(F.lit("d"), key(), F.lit("/"), "f.name").alias("path"), "f.contents")


@query("s25_dependencies", "SELECT 'd' || p_partkey || '/package.json' AS path, 'dependencies' AS section, 'lib-' || (p_size % 5) AS package, '^' || (p_size % 3) || '.' || (p_partkey % 4) AS requirement FROM part UNION ALL SELECT 'd' || p_partkey || '/package.json', 'devDependencies', 'tool', '*' FROM part")
def s25(t):
    """What manifests ask for."""
    return manifests.node_dependencies(packages(t))


@query("s25_resolved", """WITH p AS (SELECT 'lib-' || (p_size % 5) AS package, p_size % 3 AS a, p_partkey % 10 AS b, p_partkey % 4 AS m FROM part),
  r AS (SELECT DISTINCT package, a, m FROM p), v AS (SELECT package, a, b FROM p)
  SELECT r.package, '^' || r.a || '.' || r.m AS requirement, max(CASE WHEN v.b >= r.m AND (r.a > 0 OR v.b = r.m) THEN v.a || '.' || v.b || '.1' END) AS version FROM r LEFT JOIN v ON r.package = v.package AND r.a = v.a GROUP BY 1, 2
  UNION ALL SELECT 'tool', '*', NULL""")
def s25_resolved(t):
    """The highest version that lock files have of each requirement."""
    files = packages(t)
    return versions.resolve(manifests.node_dependencies(files), manifests.node_locked(files).where("NOT nested").select("package", "version"))


@query("s25_plugin_packages", "SELECT 'd' || p_partkey || '/package.json' AS path, 'lint' AS plugin, 'lib-' AS filter FROM part UNION ALL SELECT 'd' || p_partkey || '/package.json', 'other', 'b-4' FROM part WHERE p_size % 5 = 4 UNION ALL SELECT 'd' || p_partkey || '/package.json', 'lint', 'tool' FROM part")
def s25_plugins(t):
    """Packages that plugins look for by parts of names, but not themselves."""
    dependencies = manifests.node_dependencies(packages(t))
    filters = dependencies.sparkSession.createDataFrame([("lint", "lib-"), ("lint", "tool"), ("lint", "none"), ("tool", "tool"), ("other", "b-4")], "plugin string, filter string")
    return manifests.plugin_packages(dependencies, filters)


def workspace(t):
    names = F.array(*[F.lit(n) for n in ("src/a.py", "vendor/x.go", "a/vendor/y.go", "types/z.d.ts", "lib.min.js", "src/test_a.py", "builder/b.c", "build/b.c")])
    return t("part").select(key().alias("k"), F.explode(names).alias("n")).select(F.concat(F.lit("r"), "k", F.lit("/"), "n").alias("path"))


W = "WITH w AS (SELECT 'r' || p_partkey || '/' || u.n AS path, u.n FROM part, unnest(['src/a.py', 'vendor/x.go', 'a/vendor/y.go', 'types/z.d.ts', 'lib.min.js', 'src/test_a.py', 'builder/b.c', 'build/b.c']) AS u(n))"


@query("f09_default_excludes", f"{W} SELECT path FROM w WHERE n IN ('src/a.py', 'src/test_a.py', 'builder/b.c')")
def f09(t):
    """Paths that the default excludes leave."""
    return paths.analysed(workspace(t))


@query("f10_without_tests", f"{W} SELECT path FROM w WHERE n IN ('src/a.py', 'builder/b.c')")
def f10(t):
    """The same without tests."""
    return paths.analysed(workspace(t), tests=["**/test_*"], exclude_tests=True)


@query("f04_plugin_excludes", f"{W} SELECT u.p AS plugin, path FROM w, unnest(['ruff', 'eslint']) AS u(p) WHERE NOT (u.p = 'ruff' AND n LIKE 'src/%') AND NOT (u.p = 'eslint' AND n LIKE '%.js')")
def f04(t):
    """Pairs of plugin and path without a plugin's own excludes."""
    pairs = workspace(t).withColumn("plugin", F.explode(F.array(F.lit("ruff"), F.lit("eslint"))))
    return paths.plugin_excluded(pairs, {"ruff": ["**/src/**"], "eslint": ["**/*.js"]}).select("plugin", "path")


@query("f21_requested_paths", f"{W} SELECT path FROM w WHERE path LIKE 'r1/%' OR n = 'lib.min.js'")
def f21(t):
    """Paths in a directory or of a glob that were asked for; rows without a path go."""
    rows = workspace(t).unionByName(workspace(t).limit(1).select(F.lit(None).cast("string").alias("path")))
    return paths.requested(rows, ["r1", "**/lib.min.js"])


@query("d08_requested_duplicates")
def d08(t):
    """Duplicates of the whole repository that lie in requested paths, with how many places their code has."""
    return paths.requested(duplicates(heavy(t)), ["p1.py", "p2*"]).select("path", "start_line", "rule_key", "n")


@query("a10_duplicate_groups")
def a10(t):
    """Groups of duplicates by structure."""
    return issues.by_structure(trees.duplicates(heavy(t))).select("structural_hash", "n", F.col("first.path").alias("path"), F.col("first.start_line").alias("start_line"))


def nested(t):
    place = F.struct(F.concat(F.lit("/work/repo/o"), key()).alias("path"), F.lit(1).alias("start_line"))
    fix = F.struct(F.lit("s").alias("id"), F.array(F.struct(F.concat(F.lit("/work/repository/r"), key()).alias("path"), F.lit("x").alias("data"))).alias("replacements"))
    path = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("/work/repo/p"), key())).otherwise(F.concat(F.lit("q"), key()))
    return t("part").select(path.alias("path"), F.array(place).alias("other_locations"), F.array(fix).alias("suggestions"), "p_size")


@query("p02_relative_paths", "SELECT CASE WHEN p_size % 2 = 0 THEN 'p' ELSE 'q' END || p_partkey AS path, 'o' || p_partkey AS other, '/work/repository/r' || p_partkey AS replaced FROM part")
def p02(t):
    """Paths below the root, in nested places too; a directory whose name only begins like it stays."""
    rows = issues.relative_paths(nested(t), "/work/repo")
    return rows.select("path", F.col("other_locations")[0]["path"].alias("other"), F.col("suggestions")[0]["replacements"][0]["path"].alias("replaced"))


@query("p03_metadata", "SELECT 'issues' AS kind, CAST(count(*) AS BIGINT) AS n, 'w1' AS workspace_id, NULL AS build_id FROM part UNION ALL SELECT 'stats', CAST(count(*) AS BIGINT), 'w1', NULL FROM part WHERE p_size % 2 = 0")
def p03(t):
    """Metadata in all tables of a report; a field the table has is replaced."""
    made = issues.attach_metadata({"issues": nested(t).withColumn("workspace_id", F.lit("old")), "stats": nested(t).where("p_size % 2 = 0")}, {"workspace_id": "w1", "build_id": None})
    out = None
    for name, df in made.items():
        rows = df.groupBy("workspace_id", "build_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n", "workspace_id", "build_id")
        out = rows if out is None else out.unionByName(rows)
    return out
