"""More formats of linters and coverage reports, made from the driver's tables, parsed again and held against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import FILE_COVERAGE_SQL, file_coverage
from ..catalog import query
from ..sources import coverage_formats as formats
from ..sources import linters
from .coverage_queries import VISIBLE_SQL, as_text

BIG = "CAST({} AS BIGINT)".format
PLACE = f"{BIG('p_size')} AS start_line"


def level(column: str, other: int, **steps: int) -> str:
    return BIG(f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in steps.items()) + f" ELSE {other} END") + " AS level"


def kinds(*names: str) -> tuple[str, str]:
    """One of the names a part, in Spark and in DuckDB."""
    listed = ", ".join(f"'{n}'" for n in names)
    return f"array({listed})[p_partkey % {len(names)}]", f"[{listed}][1 + p_partkey % {len(names)}]"


def linter(name: str, tool: str, output: str, sql: str, columns: str, doc: str) -> None:
    """Register a query that parses ``output``, an SQL expression over ``part``."""

    def run(t):
        rows = t("part").select(F.col("p_partkey").cast("string").alias("file"), F.expr(output).alias("output"))
        return linters.parse(rows, tool).select(*columns.split())

    run.__doc__ = doc
    query(name, sql)(run)


sev, sql_sev = kinds("error", "warning", "info", "other")

linter("l04_actionlint", "actionlint", "to_json(array(named_struct('message', p_name, 'filepath', concat('w', p_partkey), 'line', p_size, 'column', 2, 'kind', 'k', 'end_column', p_size + 3)))",
       f"SELECT 'w' || p_partkey AS path, p_name AS message, {PLACE}, {BIG('p_size')} AS end_line, {BIG('p_size + 3')} AS end_column, {BIG('40')} AS level FROM part",
       "path message start_line end_line end_column level", "Actionlint; an issue ends on its line.")

linter("l05_ast_grep", "ast_grep", f"to_json(array(named_struct('file', concat('g', p_partkey), 'ruleId', 'r', 'severity', {sev}, 'message', if(p_size % 2 = 0, '', p_name), 'range', named_struct('start', named_struct('line', p_size, 'column', 0), 'end', named_struct('line', p_size + 1, 'column', 4)))))",
       f"SELECT 'g' || p_partkey AS path, CASE WHEN p_size % 2 = 0 THEN 'AST pattern match found: r' ELSE p_name END AS message, {BIG('p_size + 1')} AS start_line, {BIG('p_size + 2')} AS end_line, {BIG('5')} AS end_column, {level(sql_sev, 40, error=50, warning=40, info=30)} FROM part",
       "path message start_line end_line end_column level", "ast-grep; places count from 0, an empty message names the rule.")

linter("l09_coffeelint", "coffeelint", "to_json(map(concat('c', p_partkey), array(named_struct('level', array('ignore', 'warn', 'error', 'x')[p_partkey % 4], 'message', 'm', 'lineNumber', p_size, 'lineNumberEnd', if(p_size % 2 = 0, p_size + 2, null), 'rule', if(p_size % 3 = 0, 'style_x', 'y')))))",
       f"SELECT 'c' || p_partkey AS path, {level(kinds('ignore', 'warn', 'error', 'x')[1], 40, ignore=30, warn=40, error=50)}, CASE WHEN p_size % 3 = 0 THEN 'CATEGORY_STYLE' ELSE 'CATEGORY_LINT' END AS category, {BIG('CASE WHEN p_size % 2 = 0 THEN p_size + 2 ELSE p_size END')} AS end_line, {BIG('1')} AS start_column FROM part",
       "path level category end_line start_column", "CoffeeLint; a map from file to issues.")

linter("l10_editorconfig_checker", "editorconfig_checker", "to_json(array(named_struct('description', array('Trailing whitespace', 'Wrong indentation type', 'Wrong line endings', 'x')[p_partkey % 4], 'severity', 'e', 'location', named_struct('path', concat('e', p_partkey), 'lines', named_struct('begin', if(p_size % 5 = 0, -1, p_size), 'end', if(p_size % 2 = 0, 2, -1))))))",
       f"SELECT 'e' || p_partkey AS path, ['trim_trailing_whitespace', 'indent_style', 'end_of_line', 'unknown'][1 + p_partkey % 4] AS rule_key, {BIG('CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END')} AS start_line, {BIG('greatest(0, CASE WHEN p_size % 5 = 0 THEN -1 ELSE p_size END + CASE WHEN p_size % 2 = 0 THEN 2 ELSE 0 END)')} AS end_line FROM part",
       "path rule_key start_line end_line", "EditorConfig checker; the rule is told by the text.")

linter("l12_golangci_lint", "golangci_lint", "to_json(named_struct('Issues', if(p_size % 4 = 0, null, array(named_struct('FromLinter', 'vet', 'Text', p_name, 'Severity', array('ignore', 'warn', 'error', '')[p_partkey % 4], 'Pos', named_struct('Filename', concat('o', p_partkey), 'Line', p_size, 'Column', 3))))))",
       f"SELECT 'o' || p_partkey AS path, 'vet' AS rule_key, p_name AS message, {PLACE}, {BIG('3')} AS start_column, {level(kinds('ignore', 'warn', 'error', '')[1], 40, ignore=30, warn=40, error=50)} FROM part WHERE p_size % 4 <> 0",
       "path rule_key message start_line start_column level", "golangci-lint; no issues may be null.")

linter("l14_haml_lint", "haml_lint", f"to_json(named_struct('files', array(named_struct('path', concat('h', p_partkey), 'offenses', transform(sequence(1, 1 + p_size % 3), i -> named_struct('severity', {sev}, 'message', 'm', 'location', named_struct('line', i), 'linter_name', concat('L', i)))))))",
       f"SELECT 'h' || p_partkey AS path, 'L' || u.i AS rule_key, {BIG('u.i')} AS start_line, {BIG('u.i')} AS end_line, {level(sql_sev, 40, error=50)} FROM part, unnest(range(1, 2 + p_size % 3)) AS u(i)",
       "path rule_key start_line end_line level", "HAML-Lint; offenses in files.")

linter("l16_markdownlint", "markdownlint", "to_json(array(named_struct('fileName', concat('d', p_partkey), 'lineNumber', if(p_size % 2 = 0, p_size, null), 'ruleDescription', p_name, 'ruleInformation', 'http://x', 'ruleNames', array('MD1', 'alias'))))",
       f"SELECT 'd' || p_partkey AS path, 'MD1' AS rule_key, p_name AS message, 'CATEGORY_STYLE' AS category, {BIG('CASE WHEN p_size % 2 = 0 THEN p_size ELSE 1 END')} AS start_line, 'http://x' AS documentation_url FROM part",
       "path rule_key message category start_line documentation_url", "markdownlint; the first of the rule's names.")

linter("l18_php_codesniffer", "php_codesniffer", "to_json(named_struct('files', map(concat('q', p_partkey), named_struct('messages', array(named_struct('message', p_name, 'source', 'PSR', 'type', array('ERROR', 'WARNING', 'x')[p_partkey % 3], 'line', p_size, 'column', 4))))))",
       f"SELECT 'q' || p_partkey AS path, 'PSR' AS rule_key, p_name AS message, {PLACE}, {level(kinds('ERROR', 'WARNING', 'x')[1], 30, ERROR=50, WARNING=40)} FROM part",
       "path rule_key message start_line level", "PHP_CodeSniffer; a map of files.")

linter("l19_phpstan", "phpstan", "if(p_size % 5 = 0, '{\"files\":[]}', to_json(named_struct('files', map(concat('s', p_partkey), named_struct('messages', array(named_struct('message', p_name, 'line', p_size, 'identifier', 'id.x', 'tip', if(p_partkey % 2 = 0, 'see https://phpstan.org/x for more', null))))))))",
       f"SELECT 's' || p_partkey AS path, 'id.x' AS rule_key, {PLACE}, {BIG('p_size')} AS end_line, CASE WHEN p_partkey % 2 = 0 THEN 'https://phpstan.org/x' END AS documentation_url FROM part WHERE p_size % 5 <> 0",
       "path rule_key start_line end_line documentation_url", "PHPStan; files are an empty list when there are none, a link may be in the tip.")

linter("l21_radarlint", "radarlint", "concat(to_json(named_struct('severity', array('CRITICAL', 'MAJOR', 'MINOR', null)[p_partkey % 4], 'ruleKey', 'java:S1', 'primaryMessage', p_name, 'fileUri', concat('j', p_partkey), 'textRange', if(p_size % 3 = 0, null, named_struct('startLine', p_size, 'startLineOffset', 1, 'endLine', p_size + 1, 'endLineOffset', 2)))), '\\n')",
       f"SELECT 'j' || p_partkey AS path, 'java.S1' AS rule_key, {BIG('CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size END')} AS start_line, {BIG('CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size + 1 END')} AS end_line, {BIG('[50, 40, 30, 40][1 + p_partkey % 4]')} AS level FROM part",
       "path rule_key start_line end_line level", "RadarLint; one document a line, places may be missing.")

linter("l24_rubocop", "rubocop", "to_json(named_struct('files', array(named_struct('path', concat('b', p_partkey), 'offenses', array(named_struct('severity', array('fatal', 'warning', 'convention', 'refactor')[p_partkey % 4], 'message', p_name, 'cop_name', array('Layout/X', 'Performance/X', 'Lint/X')[p_size % 3], 'location', named_struct('start_line', p_size, 'start_column', 1, 'last_line', p_size + 1, 'last_column', 9)))))))",
       f"SELECT 'b' || p_partkey AS path, ['Layout/X', 'Performance/X', 'Lint/X'][1 + p_size % 3] AS rule_key, ['CATEGORY_STYLE', 'CATEGORY_PERFORMANCE', 'CATEGORY_LINT'][1 + p_size % 3] AS category, {BIG('p_size + 1')} AS end_line, {BIG('[50, 40, 30, 30][1 + p_partkey % 4]')} AS level FROM part",
       "path rule_key category end_line level", "RuboCop; the department decides the category.")

linter("l26_shellcheck", "shellcheck", f"to_json(array(named_struct('file', concat('k', p_partkey), 'line', p_size, 'endLine', p_size, 'column', 1, 'endColumn', 8, 'level', {sev}, 'code', 2000 + p_size, 'message', p_name)))",
       f"SELECT 'k' || p_partkey AS path, CAST(2000 + p_size AS VARCHAR) AS rule_key, {PLACE}, {BIG('8')} AS end_column, {level(sql_sev, 30, error=50, warning=40)} FROM part",
       "path rule_key start_line end_column level", "ShellCheck; the code is the rule.")

linter("l27_sqlfluff", "sqlfluff", "to_json(array(named_struct('filepath', concat('z', p_partkey), 'violations', array(named_struct('name', 'n.x', 'code', 'C1', 'description', p_name, 'warning', p_partkey % 2 = 0, 'start_line_no', p_size, 'start_line_pos', 2, 'end_line_no', if(p_size % 2 = 0, null, p_size + 1), 'end_line_pos', 5)))))",
       f"SELECT 'z' || p_partkey AS path, 'n.x' AS rule_key, {PLACE}, {BIG('CASE WHEN p_size % 2 = 0 THEN p_size ELSE p_size + 1 END')} AS end_line, {BIG('5')} AS end_column, {BIG('CASE WHEN p_partkey % 2 = 0 THEN 30 ELSE 40 END')} AS level FROM part",
       "path rule_key start_line end_line end_column level", "SQLFluff; warnings are low.")

linter("l30_terraform", "terraform", f"to_json(named_struct('diagnostics', array(named_struct('severity', {sev}, 'summary', p_name, 'range', named_struct('filename', concat('t', p_partkey), 'start', named_struct('line', p_size, 'column', 1), 'end', named_struct('line', p_size, 'column', 7))))))",
       f"SELECT 't' || p_partkey AS path, p_name AS message, {PLACE}, {BIG('7')} AS end_column, {level(sql_sev, 40, error=50)} FROM part",
       "path message start_line end_column level", "terraform validate.")

linter("l31_trufflehog", "trufflehog", "array_join(transform(sequence(1, 1 + p_size % 2), i -> to_json(named_struct('SourceMetadata', named_struct('Data', named_struct('Filesystem', named_struct('file', concat('v', p_partkey), 'line', p_size + i))), 'DetectorName', 'AWS', 'Redacted', 'x'))), '\\n')",
       f"SELECT 'v' || p_partkey AS path, 'Secret detected: AWS' AS message, 'CATEGORY_SECRET' AS category, {BIG('50')} AS level, {BIG('p_size + u.i + 1')} AS start_line FROM part, unnest(range(1, 2 + p_size % 2)) AS u(i)",
       "path message category level start_line", "TruffleHog; one finding a line, lines count from 0.")


# ------------------------------------------------------------------ coverage


def xml_lines(tag: str, before: str, between: str):
    """Elements of the lines that have a count."""
    return F.array_join(F.array_compact(F.transform("hits", lambda h, i: F.when(h >= 0, F.concat(F.lit(f'<{tag} {before}="'), (i + 1).cast("string"), F.lit(f'" {between}="'), h.cast("string"), F.lit('"/>'))))), "")


def reported(t, content):
    return file_coverage(t).select(F.concat_ws("|", "path", "report").alias("file"), content.alias("content"))


def report():
    return F.split_part("file", F.lit("|"), F.lit(2)).alias("report")


@query("c02_clover", f"WITH {FILE_COVERAGE_SQL} SELECT path, report, array_to_string(hits, ',') AS hits FROM file_coverage")
def c02(t):
    """Clover XML, half of the files in a package; padded to the lines of code."""
    one = F.concat(F.lit('<file name="n" path="'), F.col("path"), F.lit('">'), xml_lines("line", "num", "count"), F.lit('<metrics loc="'), F.size("hits").cast("string"), F.lit('"/></file>'))
    packed = F.when(F.col("report") == "F", F.concat(F.lit("<package>"), one, F.lit("</package>"))).otherwise(one)
    return formats.clover(reported(t, F.concat(F.lit("<coverage><project>"), packed, F.lit("</project></coverage>")))).select("path", report(), as_text())


@query("c06_jacoco", f"WITH {FILE_COVERAGE_SQL}, {VISIBLE_SQL} SELECT 'pkg/' || path AS path, report, array_to_string(hits, ',') AS hits FROM cut")
def c06(t):
    """JaCoCo XML, half of the packages one group deep."""
    one = F.concat(F.lit('<package name="pkg"><sourcefile name="'), F.col("path"), F.lit('">'), xml_lines("line", "nr", "ci"), F.lit("</sourcefile></package>"))
    grouped = F.when(F.col("report") == "F", F.concat(F.lit("<group>"), one, F.lit("</group>"))).otherwise(one)
    return formats.jacoco(reported(t, F.concat(F.lit("<report>"), grouped, F.lit("</report>")))).select("path", report(), as_text())


@query("c05_dotcover", f"WITH {FILE_COVERAGE_SQL}, {VISIBLE_SQL} SELECT path, report, array_to_string(list_transform(hits, lambda h: CASE WHEN h > 0 THEN 1 ELSE h END), ',') AS hits FROM cut WHERE len(hits) > 0")
def c05(t):
    """dotCover XML; statements joined to files by number."""
    each = F.array_join(F.array_compact(F.transform("hits", lambda h, i: F.when(h >= 0, F.concat(F.lit('<Statement FileIndex="7" Line="'), (i + 1).cast("string"), F.lit('" Covered="'), F.when(h > 0, "True").otherwise("False"), F.lit('"/>'))))), "")
    content = F.concat(F.lit('<Root DotCoverVersion="1"><FileIndices><File Index="7" Name="'), F.col("path"), F.lit('"/><File Index="8" Name="none"/></FileIndices><Assembly>'), each, F.lit("</Assembly></Root>"))
    return formats.dotcover(reported(t, content)).select("path", report(), as_text())


COVERED = f"WITH {FILE_COVERAGE_SQL} SELECT path, report, array_to_string(hits, ',') AS hits FROM file_coverage"


def _ruby(t, before: str, after: str, lines=None):
    one = F.to_json(F.struct(F.transform("hits", lambda h: F.when(h >= 0, h)).alias("lines")), {"ignoreNullFields": "false"})
    content = F.concat(F.lit(before.split("PATH")[0]), F.col("path"), F.lit(before.split("PATH")[1]), one if lines is None else lines, F.lit(after))
    return formats.simplecov(reported(t, content)).select("path", report(), as_text())


@query("c07_simplecov_both_reports", COVERED)
def c07_whole(t):
    """SimpleCov's newer shape, all reports."""
    return _ruby(t, '{"meta":{"simplecov_version":"0.21.2"},"coverage":{"PATH":', "}}")


@query("c07_simplecov_groups", COVERED)
def c07_groups(t):
    """SimpleCov's older shape: groups with coverage, whose values are arrays."""
    lines = F.to_json(F.transform("hits", lambda h: F.when(h >= 0, h)))
    return _ruby(t, '{"RSpec":{"coverage":{"PATH":', '},"timestamp":1}}', lines)


@query("c07_simplecov_files", COVERED)
def c07_files(t):
    """SimpleCov's shape of a list of files."""
    return _ruby(t, '{"files":[{"filename":"PATH","coverage":', "}]}")


@query("c09_native_jsonl_both_reports", f"WITH {FILE_COVERAGE_SQL} SELECT path, array_to_string(hits, ',') AS hits FROM file_coverage")
def c09_whole(t):
    """Native JSON lines of all reports."""
    rows = file_coverage(t).select(F.to_json(F.struct("path", F.transform("hits", lambda h: h.cast("string")).alias("hits"))).alias("value"))
    return formats.native_jsonl(rows).select("path", as_text())


@query("c08_xccov_both_reports", COVERED)
def c08_whole(t):
    """Xccov JSON of all reports."""
    lines = F.transform("hits", lambda h, i: F.struct((i + 1).alias("line"), (h >= 0).alias("isExecutable"), F.when(h >= 0, h).alias("executionCount")))
    return formats.xccov(reported(t, F.to_json(F.create_map(F.col("path"), lines)))).select("path", report(), as_text())
