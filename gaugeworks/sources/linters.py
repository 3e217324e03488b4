"""Linter outputs parsed to issues.

Input: (file, output), a tool's whole output in a row. Each format is a schema and SQL
expressions over one reported element ``r``, so parsing is ``from_json`` and ``explode``.
Result: path, rule_key, message, level, category, start_line, start_column, end_line,
end_column, documentation_url.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("path", "rule_key", "message", "level", "category", "start_line", "start_column", "end_line", "end_column", "documentation_url")
LONG = {"level", "start_line", "start_column", "end_line", "end_column"}


def ladder(value: str, other: int | str, **steps: int) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in steps.items()) + f" ELSE {other} END"


@dataclass(frozen=True)
class Format:
    """``rows``: expression of an array of elements from the parsed output ``d``; ``lines``: one JSON document a line."""

    schema: str
    rows: str
    fields: dict[str, str] = field(default_factory=dict)
    lines: bool = False
    strict: bool = True
    where: str = "true"
    text: str = "output"


def _flat(outer: str, inner: str) -> str:
    """Elements of ``inner`` of each of ``outer``, as structs (f, m)."""
    return f"flatten(transform(coalesce({outer}, array()), f -> transform(coalesce(f.{inner}, array()), m -> struct(f, m))))"


def _mapped(outer: str, inner: str) -> str:
    return f"flatten(transform(map_entries({outer}), e -> transform(coalesce(e.value{inner}, array()), m -> struct(e.key AS f, m))))"


MSG = "message string"
FORMATS: dict[str, Format] = {
    "actionlint": Format("array<struct<message:string,filepath:string,line:bigint,column:bigint,kind:string,end_column:bigint>>", "d", {"path": "r.filepath", "rule_key": "r.kind", "message": "r.message", "level": "40", "category": "'CATEGORY_LINT'", "start_line": "r.line", "start_column": "r.column", "end_line": "r.line", "end_column": "r.end_column"}),
    "ast_grep": Format("array<struct<file:string,ruleId:string,severity:string,message:string,range:struct<start:struct<line:bigint,column:bigint>,`end`:struct<line:bigint,column:bigint>>>>", "d", {"path": "r.file", "rule_key": "r.ruleId", "message": "if(r.message = '', concat('AST pattern match found: ', r.ruleId), r.message)", "level": ladder("r.severity", 40, error=50, warning=40, hint=30, info=30), "category": "'CATEGORY_LINT'", "start_line": "r.range.start.line + 1", "start_column": "r.range.start.column + 1", "end_line": "r.range.`end`.line + 1", "end_column": "r.range.`end`.column + 1"}),
    "bandit": Format("struct<results:array<struct<col_offset:bigint,end_col_offset:bigint,filename:string,issue_severity:string,issue_text:string,line_number:bigint,line_range:array<bigint>,more_info:string,test_id:string>>>", "d.results", {"path": "r.filename", "rule_key": "r.test_id", "message": "r.issue_text", "level": ladder("r.issue_severity", 50, low=30, medium=40, high=50), "category": "'CATEGORY_DEPENDENCY_ALERT'", "start_line": "r.line_number", "start_column": "r.col_offset", "end_line": "coalesce(element_at(r.line_range, -1), r.line_number)", "end_column": "r.end_col_offset", "documentation_url": "r.more_info"}),
    "coffeelint": Format("map<string,array<struct<level:string,message:string,lineNumber:bigint,columnNumber:bigint,lineNumberEnd:bigint,columnNumberEnd:bigint,rule:string>>>", _mapped("d", ""), {"path": "r.f", "rule_key": "r.m.rule", "message": "r.m.message", "level": ladder("r.m.level", 40, ignore=30, warn=40, error=50), "category": "if(r.m.rule LIKE '%style%', 'CATEGORY_STYLE', 'CATEGORY_LINT')", "start_line": "r.m.lineNumber", "start_column": "coalesce(r.m.columnNumber, 1)", "end_line": "coalesce(r.m.lineNumberEnd, r.m.lineNumber)", "end_column": "coalesce(r.m.columnNumberEnd, 1)"}),
    "eslint": Format("array<struct<filePath:string,messages:array<struct<ruleId:string,fatal:boolean,severity:int,message:string,line:bigint,column:bigint,endLine:bigint,endColumn:bigint>>>>", _flat("d", "messages"), {"path": "r.f.filePath", "rule_key": "coalesce(r.m.ruleId, if(r.m.fatal, 'fatal', 'error'))", "message": "r.m.message", "level": "CASE WHEN r.m.fatal THEN 50 WHEN r.m.severity = 1 THEN 30 ELSE 40 END", "category": "if(r.m.ruleId LIKE '%a11y%', 'CATEGORY_ACCESSIBILITY', 'CATEGORY_LINT')", "start_line": "r.m.line", "start_column": "r.m.column", "end_line": "r.m.endLine", "end_column": "r.m.endColumn"}),
    "golangci_lint": Format("struct<Issues:array<struct<FromLinter:string,Text:string,Severity:string,Pos:struct<Filename:string,Line:bigint,Column:bigint>>>>", "d.Issues", {"path": "r.Pos.Filename", "rule_key": "r.FromLinter", "message": "r.Text", "level": ladder("r.Severity", 40, ignore=30, warn=40, error=50), "category": "'CATEGORY_LINT'", "start_line": "r.Pos.Line", "start_column": "r.Pos.Column"}),
    "hadolint": Format("array<struct<code:string,level:string,message:string,file:string,line:bigint,column:bigint>>", "d", {"path": "r.file", "rule_key": "r.code", "message": "r.message", "level": ladder("r.level", 30, error=50, warning=40), "category": "'CATEGORY_LINT'", "start_line": "coalesce(r.line, 1)", "start_column": "coalesce(r.line, 1)"}),
    "haml_lint": Format("struct<files:array<struct<path:string,offenses:array<struct<severity:string,message:string,location:struct<line:bigint>,linter_name:string>>>>>", _flat("d.files", "offenses"), {"path": "r.f.path", "rule_key": "r.m.linter_name", "message": "r.m.message", "level": ladder("r.m.severity", 40, error=50), "category": "'CATEGORY_LINT'", "start_line": "r.m.location.line", "end_line": "r.m.location.line"}),
    "markdownlint": Format("array<struct<fileName:string,lineNumber:bigint,ruleDescription:string,ruleInformation:string,ruleNames:array<string>>>", "d", {"path": "r.fileName", "rule_key": "r.ruleNames[0]", "message": "r.ruleDescription", "level": "40", "category": "'CATEGORY_STYLE'", "start_line": "coalesce(r.lineNumber, 1)", "end_line": "coalesce(r.lineNumber, 1)", "documentation_url": "r.ruleInformation"}, strict=False),
    "mypy": Format("struct<file:string,line:bigint,column:bigint,message:string,code:string,severity:string>", "array(d)", {"path": "r.file", "rule_key": "coalesce(r.code, 'mypy_issue')", "message": "r.message", "level": ladder("r.severity", 40, error=50, warning=40, note=30), "category": "'CATEGORY_TYPE_CHECK'", "start_line": "r.line", "start_column": "greatest(1, r.column + 1)"}, lines=True, strict=False),
    "php_codesniffer": Format("struct<files:map<string,struct<messages:array<struct<message:string,source:string,type:string,line:bigint,column:bigint>>>>>", _mapped("d.files", ".messages"), {"path": "r.f", "rule_key": "r.m.source", "message": "r.m.message", "level": ladder("r.m.type", 30, ERROR=50, WARNING=40), "category": "'CATEGORY_LINT'", "start_line": "r.m.line", "start_column": "r.m.column"}),
    "phpstan": Format("struct<files:string>", _mapped("from_json(if(d.files LIKE '{%', d.files, '{}'), 'map<string,struct<messages:array<struct<message:string,line:bigint,identifier:string,tip:string>>>>')", ".messages"), {"path": "r.f", "rule_key": "r.m.identifier", "message": "r.m.message", "level": "40", "category": "'CATEGORY_LINT'", "start_line": "r.m.line", "end_line": "r.m.line", "documentation_url": "nullif(regexp_extract(r.m.tip, 'https?://[^ ]+', 0), '')"}),
    "pylint": Format("array<struct<`message-id`:string,type:string,message:string,symbol:string,path:string,line:bigint,column:bigint,endLine:bigint,endColumn:bigint>>", "d", {"path": "r.path", "rule_key": "r.symbol", "message": "r.message", "level": ladder("r.type", 30, fatal=50, error=50, refactor=40, convention=40), "category": "'CATEGORY_LINT'", "start_line": "coalesce(r.line, 1)", "start_column": "coalesce(r.line, 1)", "end_line": "coalesce(r.endLine, r.line, 1)", "end_column": "coalesce(r.endColumn, r.line, 1)"}),
    "radarlint": Format("struct<severity:string,ruleKey:string,primaryMessage:string,fileUri:string,textRange:struct<startLine:bigint,startLineOffset:bigint,endLine:bigint,endLineOffset:bigint>>", "array(d)", {"path": "r.fileUri", "rule_key": "replace(r.ruleKey, ':', '.')", "message": "r.primaryMessage", "level": ladder("coalesce(r.severity, 'MAJOR')", 40, CRITICAL=50, MAJOR=40, MINOR=30), "category": "'CATEGORY_LINT'", "start_line": "greatest(0, coalesce(r.textRange.startLine, 0))", "start_column": "greatest(0, coalesce(r.textRange.startLineOffset, 0))", "end_line": "greatest(0, coalesce(r.textRange.endLine, 0))", "end_column": "greatest(0, coalesce(r.textRange.endLineOffset, 0))"}, lines=True),
    "reek": Format("array<struct<context:string,lines:array<bigint>,message:string,smell_type:string,source:string,documentation_link:string>>", "flatten(transform(d, f -> transform(f.lines, m -> struct(f, m))))", {"path": "r.f.source", "rule_key": "r.f.smell_type", "message": "trim(concat(r.f.context, ' ', r.f.message))", "level": "40", "category": "'CATEGORY_LINT'", "start_line": "r.m", "documentation_url": "r.f.documentation_link"}),
    "ripgrep": Format("struct<type:string,data:struct<path:struct<text:string>,line_number:bigint,submatches:array<struct<match:struct<text:string>,start:bigint,`end`:bigint>>>>", "if(d.type = 'match', transform(d.data.submatches, m -> struct(d.data AS f, m)), array())", {"path": "r.f.path.text", "rule_key": "r.m.match.text", "message": "r.m.match.text", "level": "10", "category": "'CATEGORY_LINT'", "start_line": "r.f.line_number", "start_column": "r.m.start + 1", "end_line": "r.f.line_number", "end_column": "r.m.`end` + 1"}, lines=True),
    "rubocop": Format("struct<files:array<struct<path:string,offenses:array<struct<severity:string,message:string,cop_name:string,location:struct<start_line:bigint,start_column:bigint,last_line:bigint,last_column:bigint>>>>>>", _flat("d.files", "offenses"), {"path": "r.f.path", "rule_key": "r.m.cop_name", "message": "r.m.message", "level": ladder("r.m.severity", 40, error=50, fatal=50, warning=40, info=30, convention=30, refactor=30), "category": "CASE split_part(r.m.cop_name, '/', 1) WHEN 'Layout' THEN 'CATEGORY_STYLE' WHEN 'Style' THEN 'CATEGORY_STYLE' WHEN 'Performance' THEN 'CATEGORY_PERFORMANCE' ELSE 'CATEGORY_LINT' END", "start_line": "r.m.location.start_line", "start_column": "r.m.location.start_column", "end_line": "r.m.location.last_line", "end_column": "r.m.location.last_column"}),
    "ruff": Format("array<struct<code:string,message:string,filename:string,url:string,location:struct<row:bigint,column:bigint>,end_location:struct<row:bigint,column:bigint>>>", "d", {"path": "r.filename", "rule_key": "coalesce(r.code, 'error')", "message": "r.message", "level": "40", "category": "'CATEGORY_LINT'", "start_line": "r.location.row", "start_column": "r.location.column", "end_line": "r.end_location.row", "end_column": "r.end_location.column", "documentation_url": "r.url"}),
    "shellcheck": Format("array<struct<file:string,line:bigint,endLine:bigint,column:bigint,endColumn:bigint,level:string,code:bigint,message:string>>", "d", {"path": "r.file", "rule_key": "string(r.code)", "message": "r.message", "level": ladder("r.level", 30, error=50, warning=40), "category": "'CATEGORY_LINT'", "start_line": "r.line", "start_column": "r.column", "end_line": "r.endLine", "end_column": "r.endColumn"}),
    "sqlfluff": Format("array<struct<filepath:string,violations:array<struct<name:string,code:string,description:string,warning:boolean,start_line_no:bigint,start_line_pos:bigint,end_line_no:bigint,end_line_pos:bigint>>>>", _flat("d", "violations"), {"path": "r.f.filepath", "rule_key": "r.m.name", "message": "r.m.description", "level": "if(r.m.warning, 30, 40)", "category": "'CATEGORY_LINT'", "start_line": "r.m.start_line_no", "start_column": "r.m.start_line_pos", "end_line": "coalesce(r.m.end_line_no, r.m.start_line_no)", "end_column": "coalesce(r.m.end_line_pos, r.m.start_line_pos)"}),
    "stylelint": Format("array<struct<source:string,warnings:array<struct<line:bigint,column:bigint,endLine:bigint,endColumn:bigint,rule:string,severity:string,text:string>>>>", _flat("d", "warnings"), {"path": "r.f.source", "rule_key": "coalesce(r.m.rule, 'unknown')", "message": "r.m.text", "level": ladder("r.m.severity", 30, error=40), "category": "'CATEGORY_LINT'", "start_line": "coalesce(r.m.line, 1)", "start_column": "coalesce(r.m.column, 1)", "end_line": "coalesce(r.m.endLine, r.m.line, 1)", "end_column": "coalesce(r.m.endColumn, r.m.column, 1)"}, text="substring(output, greatest(1, instr(output, '[')))"),
    "terraform": Format("struct<diagnostics:array<struct<severity:string,summary:string,range:struct<filename:string,start:struct<line:bigint,column:bigint>,`end`:struct<line:bigint,column:bigint>>>>>", "d.diagnostics", {"path": "r.range.filename", "message": "r.summary", "level": ladder("r.severity", 40, error=50, warning=40), "category": "'CATEGORY_LINT'", "start_line": "r.range.start.line", "start_column": "r.range.start.column", "end_line": "r.range.`end`.line", "end_column": "r.range.`end`.column"}),
    "trufflehog": Format("struct<SourceMetadata:struct<Data:struct<Filesystem:struct<file:string,line:bigint>>>,DetectorName:string,Redacted:string>", "array(d)", {"path": "r.SourceMetadata.Data.Filesystem.file", "rule_key": "r.DetectorName", "message": "concat('Secret detected: ', r.DetectorName)", "level": "50", "category": "'CATEGORY_SECRET'", "start_line": "r.SourceMetadata.Data.Filesystem.line + 1"}, lines=True),
    "editorconfig_checker": Format("array<struct<description:string,severity:string,location:struct<path:string,lines:struct<begin:bigint,`end`:bigint>>>>", "d", {"path": "r.location.path", "rule_key": "CASE WHEN r.description LIKE 'Trailing whitespace%' THEN 'trim_trailing_whitespace' WHEN r.description LIKE 'Wrong indent%' THEN 'indent_style' WHEN r.description LIKE 'Wrong line ending%' THEN 'end_of_line' ELSE 'unknown' END", "message": "r.description", "level": "40", "category": "'CATEGORY_STYLE'", "start_line": "greatest(0, r.location.lines.begin)", "end_line": "greatest(0, r.location.lines.begin + if(r.location.lines.`end` > 0, r.location.lines.`end`, 0))"}),
    "taplo": Format("array<string>", "cast(array() AS array<string>)", {}, strict=False),
}


def parse(outputs: DataFrame, name: str) -> DataFrame:
    """Issues of the outputs of one format; a malformed document is an error where the format is strict."""
    f = FORMATS[name]
    docs = outputs.select("file", F.expr(f.text).alias("output"))
    if f.lines:
        docs = docs.select("file", F.explode(F.split("output", "\n")).alias("output")).where("trim(output) <> ''")
    docs = docs.select("file", F.from_json("output", f.schema, {"mode": "FAILFAST" if f.strict else "PERMISSIVE"}).alias("d")).where("d IS NOT NULL")
    rows = docs.select("file", F.expr(f"explode({f.rows})").alias("r")).where(f.where)
    if name == "mypy":
        rows = rows.where("r.file IS NOT NULL")
    return rows.select("file", *[F.expr(f.fields.get(c, "NULL")).cast("bigint" if c in LONG else "string").alias(c) for c in FIELDS])


def regex(outputs: DataFrame, pattern: str) -> DataFrame:
    """Lines of text output by a pattern with named groups path, line, message, code and maybe severity, col, end_line, end_col."""
    import re

    order = list(re.compile(pattern.replace("(?<", "(?P<").replace("(?P<=", "(?<=").replace("(?P<!", "(?<!")).groupindex)
    java = pattern.replace("(?P<", "(?<")
    for g in order:  # Java's group names have no underscore
        java = java.replace(f"(?<{g}>", f"(?<{g.replace('_', '')}>")
    lines = outputs.select("file", F.explode(F.split(F.replace("output", F.lit("\r"), F.lit("")), "\n")).alias("l")).where(F.col("l").rlike(java))
    group = {g: F.nullif(F.regexp_extract("l", java, i + 1), F.lit("")) for i, g in enumerate(order)}
    severity = group.get("severity", F.lit(None).cast("string"))
    number = lambda g: group[g].try_cast("bigint") if g in group else F.lit(None).cast("bigint")
    level = F.when(severity == "error", 50).when(severity == "warning", 40).when(severity.isin("info", "note"), 30).otherwise(40)
    return lines.select("file", group["path"].alias("path"), group["code"].alias("rule_key"), group["message"].alias("message"), level.cast("bigint").alias("level"), number("line").alias("start_line"), number("col").alias("start_column"), number("end_line").alias("end_line"), number("end_col").alias("end_column"))


def tsc(outputs: DataFrame) -> DataFrame:
    """``path(line,col): error CODE: message``; other lines are skipped; the category is unset."""
    pattern = r"^(.*?)\((\d+),(\d+)\): error (\S+): (.*)$"
    lines = outputs.select("file", F.explode(F.split("output", "\r?\n")).alias("l")).where(F.col("l").rlike(pattern))
    part = lambda i: F.regexp_extract("l", pattern, i)
    return lines.select("file", part(1).alias("path"), part(4).alias("rule_key"), part(5).alias("message"), F.lit(50).cast("bigint").alias("level"), part(2).cast("bigint").alias("start_line"), part(3).cast("bigint").alias("start_column"))


SARIF = (
    "runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string,helpUri:string,defaultConfiguration:struct<level:string>>>>>,"
    "results:array<struct<ruleId:string,level:string,kind:string,message:struct<text:string>,suppressions:array<struct<status:string>>,"
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:bigint,startColumn:bigint,endLine:bigint,endColumn:bigint>>>>>>>>"
)


def sarif(outputs: DataFrame, level: str | None = None) -> DataFrame:
    """SARIF results with their rules.

    Rules of all runs are joined by id, later runs first. Results whose suppressions are all
    accepted go (an empty list counts as all), and so do kinds other than fail and review.
    Level: the argument, else the result's, else the rule's, else medium; a rule id that
    no run defines, on a result without a level, is an error.
    """
    runs = outputs.select("file", F.posexplode(F.from_json("output", SARIF, {"mode": "FAILFAST"})["runs"]).alias("k", "run"))
    rules = runs.select("file", "k", F.posexplode("run.tool.driver.rules").alias("j", "rule"))
    rules = rules.groupBy("file", F.col("rule.id").alias("ruleId")).agg(F.max_by("rule", F.struct("k", "j")).alias("rule"))
    rows = runs.select("file", F.explode("run.results").alias("r"))
    rows = rows.where("(r.suppressions IS NULL OR exists(r.suppressions, s -> s.status IS DISTINCT FROM 'accepted')) AND coalesce(r.kind, 'fail') IN ('fail', 'review')")
    rows = rows.withColumn("ruleId", F.col("r.ruleId")).join(rules, ["file", "ruleId"], "left")
    unknown = F.col("ruleId").isNotNull() & F.col("rule").isNull() & F.col("r.level").isNull() & F.lit(level is None)
    named = F.coalesce(F.lit(level), "r.level", "rule.defaultConfiguration.level", F.lit("warning"))
    number = F.when(unknown, F.raise_error(F.concat(F.lit("no such rule: "), F.col("ruleId"))).cast("bigint")).when(named == "error", 50).when(named == "warning", 40).when(named.isin("note", "info"), 30).otherwise(40)
    where = F.col("r.locations")[0]["physicalLocation"]
    region = where["region"]
    return rows.select(
        "file", where["artifactLocation"]["uri"].alias("path"), F.coalesce("ruleId", "r.message.text").alias("rule_key"), F.col("r.message.text").alias("message"), number.cast("bigint").alias("level"),
        region["startLine"].alias("start_line"), region["startColumn"].alias("start_column"), F.coalesce(region["endLine"], region["startLine"]).alias("end_line"), F.coalesce(region["endColumn"], region["startColumn"]).alias("end_column"), F.col("rule.helpUri").alias("documentation_url"),
    )
