"""Issue predicates, transformers, counts and orders.

Rows carry at least path, tool, rule_key, level, start_line and end_line.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FMT, SECURITY_CATEGORIES
from ..storage import checkpointed
from .coverage import matches

# ------------------------------------------------------------------ predicates


def level_at_least(df: DataFrame, level: int) -> DataFrame:
    return df.where(F.col("level") >= level)


def rule_id() -> Column:
    return F.concat_ws(":", "tool", "rule_key")


def check_filter(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows of any of ``plugin`` or ``plugin:rule``; - and _ are the same in rules; no names keep all."""
    if not names:
        return df
    rule = F.replace(F.col("rule_key"), F.lit("-"), F.lit("_"))
    tests = []
    for name in names:
        plugin, _, want = name.partition(":")
        test = F.col("tool") == plugin
        tests.append(test & (rule == want.replace("-", "_")) if want else test)
    return df.where(reduce(lambda a, b: a | b, tests))


def rule_matches(names: list[str]) -> Column:
    """``tool:rule`` or a bare rule."""
    return rule_id().isin(names) | F.col("rule_key").isin(names)


@dataclass(frozen=True)
class Selector:
    """Plugins, rules, levels and globs that must all match; an empty list matches everything."""

    plugins: list[str] = field(default_factory=list)
    rules: list[str] = field(default_factory=list)
    levels: list[int] = field(default_factory=list)
    globs: list[str] = field(default_factory=list)

    def test(self) -> Column:
        out = F.lit(True)
        if self.plugins:
            out = out & F.col("tool").isin(self.plugins)
        if self.rules:
            out = out & rule_matches(self.rules)
        if self.levels:
            out = out & F.col("level").isin(self.levels)
        if self.globs:
            out = out & F.coalesce(matches(F.col("path"), self.globs), F.lit(False))
        return out


def ignore_issues(df: DataFrame, rule: Selector) -> DataFrame:
    """Drop what the selector matches; rows without a path always stay."""
    return df.where(F.col("path").isNull() | ~rule.test())


def exclude(df: DataFrame, plugins: list[str], globs: list[str]) -> DataFrame:
    return df.where(~Selector(plugins=plugins, globs=globs).test())


@dataclass(frozen=True)
class TriageRule:
    match: Selector
    level: int | None = None
    category: str | None = None
    mode: str | None = None
    ignored: bool = False


def triage(df: DataFrame, rules: list[TriageRule]) -> DataFrame:
    """Rules in order; each sees what those before it changed."""
    for r in rules:
        hit = r.match.test()
        if r.ignored:
            df = df.where(~hit)
            continue
        changes = {c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in (("level", r.level), ("category", r.category), ("mode", r.mode)) if v is not None}
        df = df.withColumns(changes)
    return df


def drop_failed_plugins(df: DataFrame, invocations: DataFrame, ok=(0, 1)) -> DataFrame:
    """Issues of plugins none of whose invocations failed."""
    failed = invocations.where(~F.col("exit_code").isin(*ok)).select(F.col("plugin").alias("tool")).distinct()
    return df.join(F.broadcast(failed), "tool", "left_anti")  # few, and a shuffle by plugin would gather each one's issues in a task


# ------------------------------------------------------------------ changed lines


def mark_added(df: DataFrame, added: DataFrame, new_files: DataFrame | None = None, width: int = 64) -> DataFrame:
    """``on_added_line``: whether an added line lies in the issue's range.

    An end before the start means one line; without a path it is true; without a range any
    added line of the path will do. The range join is an equi-join: added lines are
    gathered in cells of ``width`` lines as bitmaps, a range meets only the cells it spans.
    """
    cells = added.select("path", F.floor(F.col("line") / width).alias("cell"), F.expr(f"shiftleft(1L, cast(pmod(line, {width}) AS int))").alias("bit"))
    cells = cells.groupBy("path", "cell").agg(F.bit_or("bit").alias("bits"))
    rows = df.withColumn("_row", F.struct(*[F.col(c) for c in df.columns]))
    last = F.when(F.coalesce(F.col("end_line"), F.lit(0)) < F.col("start_line"), F.col("start_line")).otherwise(F.col("end_line"))
    spans = rows.where("path IS NOT NULL AND start_line IS NOT NULL").select("path", "start_line", last.alias("last")).distinct()
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("last") / width))))
    low = F.greatest(F.col("start_line") - F.col("cell") * width, F.lit(0)).cast("int")
    high = F.least(F.col("last") - F.col("cell") * width, F.lit(width - 1)).cast("int")
    mask = F.expr("shiftleft(-1L, low) & shiftrightunsigned(-1L, 63 - high)")
    hits = spans.withColumns({"low": low, "high": high}).join(cells, ["path", "cell"]).where(mask.bitwiseAND(F.col("bits")) != 0)
    rangeless = rows.where("path IS NOT NULL AND start_line IS NULL").select("path", "start_line", last.alias("last")).distinct()
    rangeless = rangeless.join(added.select("path").distinct(), "path", "left_semi")
    hits = hits.select("path", "start_line", "last").distinct().unionByName(rangeless)
    hits = hits.select(F.col("path").alias("_path"), F.col("start_line").alias("_start"), F.col("last").alias("_last"), F.lit(True).alias("_hit"))
    same = (F.col("path") == F.col("_path")) & F.col("start_line").eqNullSafe(F.col("_start")) & F.col("last").eqNullSafe(F.col("_last"))
    out = rows.withColumn("last", last).join(hits, same, "left")  # the only shuffle of whole rows
    flag = F.when(F.col("path").isNull(), True).otherwise(F.coalesce("_hit", F.lit(False)))
    if new_files is not None:
        out = out.join(new_files.select("path").distinct().withColumn("_new", F.lit(True)), "path", "left")
        flag = flag | F.coalesce("_new", F.lit(False))
    return out.select("_row.*", flag.alias("on_added_line"))


# ------------------------------------------------------------------ transformers


def documentation_urls(df: DataFrame, plugins: DataFrame) -> DataFrame:
    """Fill an empty documentation_url from the plugin's template ``${rule}``."""
    first = plugins.groupBy("tool").agg(F.min_by("url_template", "ordinal").alias("_url"))
    made = F.replace("_url", F.lit("${rule}"), F.col("rule_key"))
    empty = F.coalesce(F.col("documentation_url"), F.lit("")) == ""
    return df.join(F.broadcast(first), "tool", "left").withColumn("documentation_url", F.when(empty, F.coalesce(made, F.lit(""))).otherwise(F.col("documentation_url"))).drop("_url")


def plugin_modes(df: DataFrame, plugins: DataFrame) -> DataFrame:
    first = plugins.groupBy("tool").agg(F.min_by("plugin_mode", "ordinal").alias("_mode"))
    found = first.withColumn("_found", F.lit(True))  # a plugin without a mode of its own takes the mode away
    return df.join(F.broadcast(found), "tool", "left").withColumn("mode", F.when(F.col("_found"), F.col("_mode")).otherwise(F.col("mode"))).drop("_mode", "_found")


def snippets(df: DataFrame, files: DataFrame, context: int = 10) -> DataFrame:
    """``snippet`` (the range) and ``snippet_with_context``; null where the range leaves the file."""
    source = files.select("path", F.split("contents", "\n").alias("_lines"))
    last = F.when(F.coalesce(F.col("end_line"), F.lit(0)) == 0, F.col("start_line")).otherwise(F.col("end_line"))
    rows = df.join(source, "path", "left").withColumn("_last", last)
    inside = (F.col("start_line") >= 1) & (F.col("_last") >= F.col("start_line")) & (F.col("_last") <= F.size("_lines")) & F.col("_lines").isNotNull()
    first = F.greatest(F.col("start_line") - context, F.lit(1))
    end = F.least(F.col("_last") + context, F.size("_lines"))
    cut = lambda a, b: F.array_join(F.slice("_lines", F.greatest(a, F.lit(1)).cast("int"), F.greatest(b - a + 1, F.lit(0)).cast("int")), "\n")
    return rows.withColumns({"snippet": F.when(inside, cut(F.col("start_line"), F.col("_last"))), "snippet_with_context": F.when(inside, cut(first, end))}).drop("_lines", "_last")


def tab_columns(column: Column, line: Column, width: int) -> Column:
    """A column counted with tabs ``width`` wide, as a count of characters."""
    before = F.substring(line, F.lit(1), F.greatest(column - 1, F.lit(0)).cast("int"))
    tabs = F.length(before) - F.length(F.replace(before, F.lit("\t"), F.lit("")))
    return F.greatest(F.lit(0), column - tabs * (width - 1))


def fix_issue_path(path: Column, prefix: str = "", root: str = "") -> Column:
    """A tool's path made relative to the workspace."""
    out = F.regexp_replace(path, "^file://", "")
    if root:
        literal = "\\Q" + root.rstrip("/").replace("\\E", "\\E\\\\E\\Q") + "\\E"
        out = F.regexp_replace(out, "^(/private)?" + literal + "/", "")
    out = F.regexp_replace(F.regexp_replace(out, r"^\./", ""), "^/", "")
    return F.concat(F.lit(prefix.rstrip("/") + "/"), out) if prefix else out


def check_chain(df: DataFrame, added: DataFrame, plugins: DataFrame, ignores: list[Selector], names: list[str], level: int, rules: list[TriageRule], only_added: bool = False) -> DataFrame:
    """The check's transformers in order. Triage is last: what it changes isn't filtered again."""
    df = mark_added(df, added)
    if only_added:
        df = df.where("on_added_line")
    for rule in ignores:
        df = ignore_issues(df, rule)
    df = level_at_least(check_filter(df, names), level)
    df = plugin_modes(documentation_urls(df, plugins), plugins)
    return triage(df, rules)


# ------------------------------------------------------------------ counts, caps and orders


def issue_counts(df: DataFrame, fail_level: int) -> DataFrame:
    return df.agg(F.count("*").alias("total_issues"), F.count_if(F.col("level") >= fail_level).alias("failure_issues"), F.count_if(F.col("category").isin(*SECURITY_CATEGORIES)).alias("total_security_issues"))


def issue_order(df: DataFrame, *ties: str) -> DataFrame:
    """Path (none first), start line (none is 0), level from high to low, message; then ``ties``."""
    return df.orderBy(F.asc_nulls_first("path"), F.coalesce("start_line", F.lit(0)), F.desc("level"), "message", *ties)


def build_order(df: DataFrame, *ties: str) -> DataFrame:
    return df.orderBy("tool", "driver", "rule_key", "path", "start_line", *ties)


def positions(ordered: DataFrame) -> DataFrame:
    """``position``: number of each row of an ordered table, from 1.

    Rows stay in the range partitions of the sort, which are written once; only their
    sizes meet in one place.
    """
    rows = ordered.withColumn("_at", F.monotonically_increasing_id())
    rows = checkpointed(rows)
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.col("_at") - F.shiftleft("_part", 33)
    return rows.join(F.broadcast(starts), "_part").withColumn("position", F.col("_start") + within + 1).drop("_at", "_part", "_start")


def cap_per_file(df: DataFrame, keys: list[str], limit: int, order: list[str]) -> DataFrame:
    """At most ``limit`` rows of a file and invocation; ``capped`` tells whose transformers are skipped."""
    best = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= limit)  # a top-n, cut before the shuffle
    return best.withColumn("capped", F.count("*").over(Window.partitionBy(*keys)) >= limit).drop("_n")


def enforce_limit(df: DataFrame, limit: int = 50_000) -> DataFrame:
    """The rows, or an error that names counts by tool if there are more than ``limit``."""
    per_tool = df.groupBy("tool").count().orderBy(F.desc("count"), "tool")
    total = df.limit(limit + 1).count()
    if total > limit:
        summary = ", ".join(f"{r['tool']}: {r['count']}" for r in per_tool.limit(100).collect())
        raise ValueError(f"more than {limit} issues ({summary})")
    return df


def unformatted(df: DataFrame) -> DataFrame:
    """Distinct paths of format issues."""
    return df.where(F.col("level") == FMT).select("path").distinct()


def batches(df: DataFrame, keys: list[str], order: list[str], size: int = 64) -> DataFrame:
    """``batch`` number within each key; at least 1 and at most 512 rows a batch."""
    size = max(1, min(size, 512))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("batch", F.floor((n - 1) / size).cast("bigint"))


def first_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def exit_result(code: Column, success=(0,), errors=(2,), no_issues=()) -> Column:
    return F.when(code.isin(*success), "SUCCESS").when(code.isin(*errors), "KNOWN_ERROR").when(code.isin(*no_issues) if no_issues else F.lit(False), "NO_ISSUES").otherwise("UNKNOWN_ERROR")


# ------------------------------------------------------------------ reports


def _relative(path: Column, prefix: str) -> Column:
    head = prefix.rstrip("/") + "/"
    return F.when(path.startswith(head), F.substring(path, len(head) + 1, 1 << 30)).otherwise(path)


def relative_paths(df: DataFrame, prefix: str) -> DataFrame:
    """``path`` below a prefix, in the columns other_locations, suggestions and fully_qualified_name too, where the table has them."""
    made = {"path": _relative(F.col("path"), prefix)}
    if "fully_qualified_name" in df.columns:
        made["fully_qualified_name"] = _relative(F.col("fully_qualified_name"), prefix)
    place = lambda x: x.withField("path", _relative(x["path"], prefix))
    if "other_locations" in df.columns:
        made["other_locations"] = F.transform("other_locations", place)
    if "suggestions" in df.columns:
        made["suggestions"] = F.transform("suggestions", lambda s: s.withField("replacements", F.transform(s["replacements"], place)))
    return df.withColumns(made)


def attach_metadata(tables: dict[str, DataFrame], metadata: dict[str, str | None]) -> dict[str, DataFrame]:
    """Each table with the metadata's fields as columns, which replace columns of these names."""
    return {name: df.withColumns({k: F.lit(v).cast("string") for k, v in metadata.items()}) for name, df in tables.items()}


def by_structure(df: DataFrame) -> DataFrame:
    """(structural_hash, n, first): groups of duplicates and their first place; issues without a hash are in none."""
    place = F.struct("path", "start_line", "end_line")
    return df.where("structural_hash IS NOT NULL").groupBy("structural_hash").agg(F.count("*").alias("n"), F.min(place).alias("first"))
