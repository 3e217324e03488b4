"""Issue queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import ADDED_SQL, FILES_SQL, INVOCATIONS_SQL, ISSUES_SQL, added_lines, files, invocations, issues
from ..catalog import query
from ..operators import issues as I
from ..operators.issues import Selector, TriageRule

W = f"WITH {ISSUES_SQL}"


def ids(df, *more):
    return df.select("id", *more)


@query("f12_level_filter", f"{W} SELECT id FROM issues WHERE level >= 40")
def f12(t):
    """Issues of at least medium level."""
    return ids(I.level_at_least(issues(t), 40))


@query("f13_check_filters", f"{W} SELECT id FROM issues WHERE tool = 'urgent' OR (tool = 'high' AND rule_key = 'O_N')")
def f13(t):
    """Issues of chosen plugins and rules."""
    return ids(I.check_filter(issues(t), ["urgent", "high:O-N"]))


@query("f14_ignore", f"{W} SELECT id FROM issues WHERE NOT (tool IN ('low', 'medium') AND rule_key = 'F_A' AND regexp_matches(path, '^pkg[12]/.*$'))")
def f14(t):
    """Issues that an ignore rule doesn't name."""
    return ids(I.ignore_issues(issues(t), Selector(plugins=["low", "medium"], rules=["F_A"], globs=["pkg[12]/**"])))


@query("f15_rule_match", f"{W} SELECT id FROM issues WHERE tool || ':' || rule_key IN ('low:O_N', 'F_R') OR rule_key IN ('low:O_N', 'F_R')")
def f15(t):
    """Rules named with or without their tool."""
    return ids(issues(t).where(I.rule_matches(["low:O_N", "F_R"])))


@query("f18_exclude", f"{W} SELECT id FROM issues WHERE NOT (tool = 'urgent' AND regexp_matches(path, '^(?:.*/)?mod1/[^/]*\\.py$'))")
def f18(t):
    """Issues outside a plugin's excluded globs."""
    return ids(I.exclude(issues(t), ["urgent"], ["**/mod1/*.py"]))


PLUGIN_ROWS = [("urgent", "https://rules/${rule}", "block", 0), ("high", "https://high/${rule}#x", None, 1), ("high", "unused", "comment", 2), ("low", None, "monitor", 3)]
PLUGINS_SQL = "plugins(tool, url_template, plugin_mode) AS (VALUES ('urgent', 'https://rules/${rule}', 'block'), ('high', 'https://high/${rule}#x', 'comment'), ('low', NULL, 'monitor'))"


def plugins(t):
    spark = t("region").sparkSession
    return spark.createDataFrame(PLUGIN_ROWS, "tool string, url_template string, plugin_mode string, ordinal int")


@query("p05_documentation_url", f"{W}, {PLUGINS_SQL} SELECT id, coalesce(replace(url_template, '${{rule}}', rule_key), '') AS documentation_url FROM issues LEFT JOIN plugins USING (tool)")
def p05(t):
    """Documentation links from templates."""
    return ids(I.documentation_urls(issues(t).withColumn("documentation_url", F.lit("")), plugins(t)), "documentation_url")


@query("p06_plugin_mode", f"{W}, {PLUGINS_SQL} SELECT id, coalesce(plugin_mode, 'none') AS mode FROM issues LEFT JOIN plugins USING (tool)")
def p06(t):
    """Modes by plugin (min_by skips null values of the first row)."""
    return ids(I.plugin_modes(issues(t).withColumn("mode", F.lit("none")), plugins(t).where("plugin_mode IS NOT NULL")), "mode")


RULES = [TriageRule(Selector(levels=[10, 20]), level=30), TriageRule(Selector(plugins=["high"], levels=[30]), category="CATEGORY_BUG", mode="monitor"), TriageRule(Selector(levels=[30], globs=["pkg0/**"]), ignored=True)]
TRIAGED = """one AS (SELECT * REPLACE (CASE WHEN level IN (10, 20) THEN 30 ELSE level END AS level) FROM issues),
  two AS (SELECT * REPLACE (CASE WHEN tool = 'high' AND level = 30 THEN 'CATEGORY_BUG' ELSE category END AS category), CASE WHEN tool = 'high' AND level = 30 THEN 'monitor' END AS mode FROM one),
  triaged AS (SELECT * FROM two WHERE NOT (level = 30 AND starts_with(path, 'pkg0/')))"""


@query("p07_triage", f"{W}, {TRIAGED} SELECT id, CAST(level AS BIGINT) AS level, category, mode FROM triaged")
def p07(t):
    """Triage rules, one after the other."""
    rows = I.triage(issues(t).withColumn("mode", F.lit(None).cast("string")), RULES)
    return ids(rows, F.col("level").cast("bigint").alias("level"), "category", "mode")


MARKED = "marked AS (SELECT i.*, EXISTS (SELECT 1 FROM added_lines a WHERE a.path = i.path AND a.line BETWEEN i.start_line AND greatest(i.start_line, i.end_line)) AS on_added_line FROM issues i)"


@query("j03_range_join_added_lines", f"{W}, {ADDED_SQL}, {MARKED} SELECT id, on_added_line FROM marked")
def j03(t):
    """Issues whose range meets an added line."""
    return ids(I.mark_added(issues(t), added_lines(t)), "on_added_line")


@query("f19_diff_line_filter", f"{W}, {ADDED_SQL}, {MARKED} SELECT id FROM marked WHERE on_added_line")
def f19(t):
    """Only issues on added lines."""
    return ids(I.mark_added(issues(t), added_lines(t)).where("on_added_line"))


@query("p22_check_chain", f"""{W}, {ADDED_SQL}, {PLUGINS_SQL}, {MARKED},
  kept AS (SELECT m.*, coalesce(replace(url_template, '${{rule}}', rule_key), '') AS documentation_url, coalesce(plugin_mode, 'none') AS mode FROM marked m LEFT JOIN plugins USING (tool)
    WHERE NOT (tool = 'low' AND regexp_matches(path, '^pkg3/.*$')) AND level >= 20)
  SELECT id, on_added_line, documentation_url, CASE WHEN rule_key = 'O_N' THEN 'block' ELSE mode END AS mode, CAST(CASE WHEN rule_key = 'O_N' THEN 10 ELSE level END AS BIGINT) AS level FROM kept""")
def p22(t):
    """The whole chain of the check."""
    rows = issues(t).withColumns({"documentation_url": F.lit(""), "mode": F.lit("none")})
    rows = I.check_chain(rows, added_lines(t), plugins(t).where("plugin_mode IS NOT NULL OR tool <> 'high'").unionByName(plugins(t).where("tool = 'high' AND plugin_mode IS NULL").withColumn("plugin_mode", F.lit("comment"))), [Selector(plugins=["low"], globs=["pkg3/**"])], [], 20, [TriageRule(Selector(rules=["O_N"]), level=10, mode="block")])
    return ids(rows, "on_added_line", "documentation_url", "mode", F.col("level").cast("bigint").alias("level"))


@query("f26_errored_plugins", f"{W}, {INVOCATIONS_SQL} SELECT id FROM issues WHERE tool NOT IN (SELECT plugin FROM invocations WHERE exit_code NOT IN (0, 1) AND plugin <> 'urgent')")
def f26(t):
    """Issues of plugins that didn't fail."""
    return ids(I.drop_failed_plugins(issues(t), invocations(t).where("plugin <> 'urgent'")))


@query("p29_exit_result", f"WITH {INVOCATIONS_SQL} SELECT id, CASE exit_code WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'SUCCESS' WHEN 2 THEN 'KNOWN_ERROR' ELSE 'UNKNOWN_ERROR' END AS exit_result FROM invocations")
def p29(t):
    """Exit codes classified."""
    return invocations(t).select("id", I.exit_result(F.col("exit_code"), success=(0, 1), errors=(2,)).alias("exit_result"))


@query("p28_pass_fail", f"WITH {INVOCATIONS_SQL} SELECT id, 'fail' AS rule_key, CAST(50 AS BIGINT) AS level FROM invocations WHERE exit_code <> 0")
def p28(t):
    """One issue for each failing pass/fail tool."""
    return invocations(t).where("exit_code <> 0").select("id", F.lit("fail").alias("rule_key"), F.lit(50).cast("bigint").alias("level"))


@query("p33_messages", f"""WITH {INVOCATIONS_SQL} SELECT id, CASE WHEN exit_code = 2 THEN 'invocation.concluded.error' ELSE 'invocation.concluded.success' END AS ty, plugin AS plugin_tag FROM invocations
  UNION ALL SELECT id, 'invocation.parser.error', plugin FROM invocations WHERE exit_code = 1 AND event_type = 'error'""")
def p33(t):
    """Messages about invocations, with tags."""
    tags = F.create_map(F.lit("invocation.id"), F.col("id").cast("string"), F.lit("plugin.name"), F.col("plugin"))
    rows = invocations(t).withColumn("tags", tags)
    done = rows.select("id", F.when(F.col("exit_code") == 2, "invocation.concluded.error").otherwise("invocation.concluded.success").alias("ty"), F.col("tags")["plugin.name"].alias("plugin_tag"))
    bad = rows.where("exit_code = 1 AND event_type = 'error'").select("id", F.lit("invocation.parser.error").alias("ty"), F.col("tags")["plugin.name"].alias("plugin_tag"))
    return done.unionByName(bad)


@query("p24_keys_only", "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events")
def p24(t):
    """Environments with values removed."""
    env = F.transform_values(F.from_json("props", "map<string,string>"), lambda k, v: F.lit(""))
    return t("events").select("event_id", F.array_join(F.array_sort(F.map_keys(env)), ",").alias("keys"))


@query("a08_issue_counts", f"{W} SELECT count(*) AS total_issues, count(*) FILTER (level >= 40) AS failure_issues, count(*) FILTER (category IN ('CATEGORY_VULNERABILITY', 'CATEGORY_SECRET', 'CATEGORY_DEPENDENCY_ALERT')) AS total_security_issues FROM issues")
def a08(t):
    """Totals, failures and security issues."""
    return I.issue_counts(issues(t), 40)


@query("a09_issues_by_path", f"{W} SELECT path, count(*) AS n, min(start_line) AS first_line, string_agg(id, ',' ORDER BY start_line, level DESC, message, id) AS ids FROM issues GROUP BY path")
def a09(t):
    """Issues of each path in order."""
    rows = F.array_sort(F.collect_list(F.struct("start_line", (-F.col("level")).alias("l"), "message", "id")))
    return issues(t).groupBy("path").agg(F.count("*").alias("n"), F.min("start_line").alias("first_line"), F.array_join(F.transform(rows, lambda r: r["id"]), ",").alias("ids"))


@query("a15_issues_per_tool", f"{W} SELECT tool, count(*) AS n FROM issues GROUP BY tool")
def a15(t):
    """Issues of each tool."""
    return issues(t).groupBy("tool").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("a16_invocation_rollup", f"WITH {INVOCATIONS_SQL} SELECT plugin, count(*) AS invocations, CAST(sum(exit_code) AS BIGINT) AS codes, bool_or(exit_code = 2) AS has_errors FROM invocations GROUP BY plugin")
def a16(t):
    """Invocations of each plugin summed up."""
    return invocations(t).groupBy("plugin").agg(F.count("*").alias("invocations"), F.sum("exit_code").cast("bigint").alias("codes"), F.bool_or(F.col("exit_code") == 2).alias("has_errors"))


@query("a17_unformatted_paths", f"{W} SELECT DISTINCT path FROM issues WHERE level = 20")
def a17(t):
    """Paths with format issues."""
    return I.unformatted(issues(t))


@query("a20_fixable_set", f"{W} SELECT DISTINCT rule_key, path, start_line FROM issues WHERE level >= 30")
def a20(t):
    """Distinct (rule, location) of fixable issues."""
    return issues(t).where("level >= 30").select("rule_key", "path", "start_line").dropDuplicates()


@query("o01_issue_order", f"{W} SELECT id FROM issues ORDER BY path NULLS FIRST, coalesce(start_line, 0), level DESC, message, id LIMIT 500")
def o01(t):
    """The first 500 issues of the total order."""
    return I.issue_order(issues(t), "id").limit(500).select("id")


@query("o01_issue_positions", f"{W} SELECT id, row_number() OVER (ORDER BY path NULLS FIRST, coalesce(start_line, 0), level DESC, message, id) AS position FROM issues")
def o01_positions(t):
    """Every issue with its place in the total order."""
    return I.positions(I.issue_order(issues(t), "id")).select("id", "position")


@query("o02_build_order", f"{W} SELECT id FROM issues ORDER BY tool, rule_key, path, start_line, id LIMIT 300")
def o02(t):
    """The first 300 issues of a build."""
    return I.build_order(issues(t).withColumn("driver", F.lit("check")), "id").limit(300).select("id")


@query("o02_build_positions", f"{W} SELECT id, row_number() OVER (ORDER BY tool, CASE WHEN level % 20 = 0 THEN 'check' ELSE 'audit' END, rule_key, path, start_line, id) AS position FROM issues")
def o02_positions(t):
    """Every issue with its place in a build, where tools have two drivers."""
    rows = issues(t).withColumn("driver", F.when(F.col("level") % 20 == 0, "check").otherwise("audit"))
    return I.positions(I.build_order(rows, "id")).select("id", "position")


@query("u01_report_union", f"""{W}, {INVOCATIONS_SQL} SELECT 'issue' AS record, count(*) AS n FROM (SELECT id FROM issues WHERE level >= 40 UNION ALL SELECT id FROM issues WHERE tool = 'low') UNION ALL SELECT 'invocation', count(*) FROM invocations""")
def u01(t):
    """Reports put together record by record."""
    both = issues(t).where("level >= 40").unionByName(issues(t).where("tool = 'low'"))
    return both.agg(F.count("*").alias("n")).select(F.lit("issue").alias("record"), "n").unionByName(invocations(t).agg(F.count("*").alias("n")).select(F.lit("invocation").alias("record"), "n"))


@query("u03_first_target", f"{W} SELECT path, id FROM (SELECT path, id, row_number() OVER (PARTITION BY path ORDER BY seen_at, id) AS k FROM issues) WHERE k = 1")
def u03(t):
    """The first target of each path."""
    return I.first_by(issues(t), "path", ["seen_at", "id"]).select("path", "id")


@query("w06_cap_per_file", f"{W} SELECT id, n >= 3 AS capped FROM (SELECT id, row_number() OVER (PARTITION BY tool, path ORDER BY start_line, id) AS k, count(*) OVER (PARTITION BY tool, path) AS n FROM issues) WHERE k <= 3")
def w06(t):
    """At most three issues of a file and tool."""
    return I.cap_per_file(issues(t), ["tool", "path"], 3, ["start_line", "id"]).select("id", "capped")


@query("w09_batches", f"{W}, p AS (SELECT DISTINCT tool, path FROM issues) SELECT tool, path, CAST((row_number() OVER (PARTITION BY tool ORDER BY path) - 1) // 64 AS BIGINT) AS batch FROM p")
def w09(t):
    """Targets in batches of 64."""
    return I.batches(issues(t).select("tool", "path").distinct(), ["tool"], ["path"])


@query("p04_snippets", f"""WITH {FILES_SQL}, l AS (SELECT path, string_split(contents, chr(10)) AS lines FROM files)
  SELECT path, lines[1] || chr(10) || lines[2] AS snippet, array_to_string(lines[1:least(12, len(lines))], chr(10)) AS snippet_with_context FROM l WHERE len(lines) >= 2
  UNION ALL SELECT path, NULL, NULL FROM l WHERE len(lines) < 2""")
def p04(t):
    """Snippets of lines 1 to 2, with ten lines around."""
    rows = files(t).select("path", F.lit(1).cast("bigint").alias("start_line"), F.lit(2).cast("bigint").alias("end_line"))
    return I.snippets(rows, files(t)).select("path", "snippet", "snippet_with_context")


@query("x01_truncate_snippet", f"""WITH {FILES_SQL}, l AS (SELECT path, unnest(string_split(contents, chr(10))) AS line, generate_subscripts(string_split(contents, chr(10)), 1) AS k FROM files),
  s AS (SELECT path, k, line, sum(strlen(line) + 1) OVER (PARTITION BY path ORDER BY k) AS used FROM l)
  SELECT path, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (k <= 50 AND used - 1 <= 5120), '') AS snippet FROM s GROUP BY path""")
def x01(t):
    """At most 50 whole lines and 5120 bytes."""
    from ..functions.text import truncate_snippet

    return files(t).select("path", truncate_snippet(F.col("contents")).alias("snippet"))


@query("p11_issue_paths", f"{W} SELECT id, regexp_replace(path, '^pkg1/', '') AS path FROM issues")
def p11(t):
    """Paths of tools made relative."""
    raw = F.concat(F.lit("file:///private/work/"), F.regexp_replace("path", "^pkg1/", "./"))
    return issues(t).select("id", F.regexp_replace(I.fix_issue_path(raw, root="/work"), r"^\./", "").alias("path"))


@query("p08_tab_columns", "SELECT o_orderkey, CAST(greatest(0, 20 - (o_custkey % 4) * 7) AS BIGINT) AS col FROM orders")
def p08(t):
    """Columns corrected for tabs of width 8."""
    line = F.concat(F.repeat(F.lit("\t"), (F.col("o_custkey") % 4).cast("int")), F.lit("x = 1" + " " * 40))
    return t("orders").select("o_orderkey", I.tab_columns(F.lit(20).cast("bigint"), line, 8).cast("bigint").alias("col"))
