"""Linter outputs made from the driver's tables, parsed again and held against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..sources import linters


def outputs(t, json):
    """One output a part: ``json`` is an SQL expression of its text."""
    return t("part").select(F.col("p_partkey").cast("string").alias("file"), F.expr(json).alias("output"))


def parsed(t, name, json, *columns):
    return linters.parse(outputs(t, json), name).select(*columns)



@query("l25_ruff", "SELECT 'f' || p_partkey || '.py' AS path, CASE WHEN p_partkey % 2 = 0 THEN 'F401' ELSE 'error' END AS rule_key, p_name AS message, CAST(p_size AS BIGINT) AS start_line, CAST(p_size + 1 AS BIGINT) AS end_line, CAST(40 AS BIGINT) AS level FROM part")
def l25(t):
    """Ruff."""
    return parsed(t, "ruff", "to_json(array(named_struct('code', if(p_partkey % 2 = 0, 'F401', null), 'message', p_name, 'filename', concat('f', p_partkey, '.py'), 'location', named_struct('row', p_size, 'column', 1), 'end_location', named_struct('row', p_size + 1, 'column', 2))))", "path", "rule_key", "message", "start_line", "end_line", "level")


@query("l11_eslint", "SELECT 'a/' || p_partkey || '.js' AS path, 'r' || p_size AS rule_key, CAST(CASE p_partkey % 3 WHEN 0 THEN 50 WHEN 1 THEN 30 ELSE 40 END AS BIGINT) AS level FROM part")
def l11(t):
    """ESLint."""
    return parsed(t, "eslint", "to_json(array(named_struct('filePath', concat('a/', p_partkey, '.js'), 'messages', array(named_struct('ruleId', concat('r', p_size), 'fatal', p_partkey % 3 = 0, 'severity', p_partkey % 3, 'message', 'm', 'line', p_size)))))", "path", "rule_key", "level")


@query("l20_pylint", "SELECT 'm' || p_partkey AS path, CAST(p_size AS BIGINT) AS start_line, CAST(p_size AS BIGINT) AS start_column, CAST(CASE p_partkey % 4 WHEN 0 THEN 50 WHEN 1 THEN 40 WHEN 2 THEN 30 ELSE 40 END AS BIGINT) AS level FROM part")
def l20(t):
    """Pylint; the column is the line."""
    return parsed(t, "pylint", "to_json(array(named_struct('type', array('error', 'refactor', 'warning', 'convention')[p_partkey % 4], 'message', 'x', 'symbol', 's', 'path', concat('m', p_partkey), 'line', p_size, 'column', 99)))", "path", "start_line", "start_column", "level")


@query("l13_hadolint", "SELECT 'Dockerfile' || p_partkey AS path, CAST(CASE p_partkey % 3 WHEN 0 THEN 50 WHEN 1 THEN 40 ELSE 30 END AS BIGINT) AS level, CAST(CASE WHEN p_size > 25 THEN p_size ELSE 1 END AS BIGINT) AS start_line FROM part")
def l13(t):
    """Hadolint."""
    return parsed(t, "hadolint", "to_json(array(named_struct('code', 'DL1', 'level', array('error', 'warning', 'style')[p_partkey % 3], 'message', 'x', 'file', concat('Dockerfile', p_partkey), 'line', if(p_size > 25, p_size, null))))", "path", "level", "start_line")


@query("l06_bandit", "SELECT 'b' || p_partkey AS path, CAST(CASE p_partkey % 3 WHEN 0 THEN 30 WHEN 1 THEN 40 ELSE 50 END AS BIGINT) AS level, CAST(p_size + 2 AS BIGINT) AS end_line FROM part")
def l06(t):
    """Bandit; severities in capitals are high."""
    return parsed(t, "bandit", "to_json(named_struct('results', array(named_struct('filename', concat('b', p_partkey), 'issue_severity', array('low', 'medium', 'LOW')[p_partkey % 3], 'issue_text', 'x', 'line_number', p_size, 'line_range', array(p_size, p_size + 2), 'test_id', 'B1'))))", "path", "level", "end_line")


@query("l17_mypy", "SELECT 'p' || p_partkey || '.py' AS path, 'mypy_issue' AS rule_key, CAST(greatest(1, p_size % 3) AS BIGINT) AS start_column FROM part")
def l17(t):
    """Mypy; bad lines are skipped."""
    return parsed(t, "mypy", "concat(to_json(named_struct('file', concat('p', p_partkey, '.py'), 'line', 3, 'column', p_size % 3 - 1, 'message', 'x', 'severity', 'error')), '\\nnot json\\n')", "path", "rule_key", "start_column")


@query("l22_reek", "SELECT 'r' || p_partkey AS path, CAST(k AS BIGINT) AS start_line, 'C m' AS message FROM part, unnest(range(1, 1 + p_size % 4)) AS u(k)")
def l22(t):
    """Reek; one issue a line."""
    return parsed(t, "reek", "to_json(array(named_struct('context', 'C', 'lines', if(p_size % 4 > 0, sequence(1, greatest(1, p_size % 4)), cast(array() AS array<int>)), 'message', 'm ', 'smell_type', 's', 'source', concat('r', p_partkey))))", "path", "start_line", "message")


@query("l23_ripgrep", "SELECT 'g' || p_partkey AS path, CAST(p_size AS BIGINT) AS start_line, CAST(5 AS BIGINT) AS start_column, CAST(10 AS BIGINT) AS level FROM part")
def l23(t):
    """Ripgrep."""
    return parsed(t, "ripgrep", "concat('{\"type\":\"begin\"}\\n', to_json(named_struct('type', 'match', 'data', named_struct('path', named_struct('text', concat('g', p_partkey)), 'line_number', p_size, 'submatches', array(named_struct('match', named_struct('text', 'TODO'), 'start', 4, 'end', 8))))))", "path", "start_line", "start_column", "level")


@query("l28_stylelint", "SELECT 's' || p_partkey AS path, CAST(CASE WHEN p_size % 2 = 0 THEN 40 ELSE 30 END AS BIGINT) AS level, CAST(1 AS BIGINT) AS start_line FROM part")
def l28(t):
    """Stylelint; text before the first bracket is skipped."""
    return parsed(t, "stylelint", "concat('warning text ', to_json(array(named_struct('source', concat('s', p_partkey), 'warnings', array(named_struct('rule', 'x', 'severity', if(p_size % 2 = 0, 'error', 'warning'), 'text', 't'))))))", "path", "level", "start_line")


@query("l32_tsc", "SELECT 't' || p_partkey || '.ts' AS path, 'TS' || p_size AS rule_key, CAST(p_size AS BIGINT) AS start_line, CAST(50 AS BIGINT) AS level FROM part")
def l32(t):
    """TypeScript compiler lines."""
    return linters.tsc(outputs(t, "concat('noise\\nt', p_partkey, '.ts(', p_size, ',7): error TS', p_size, ': some text')")).select("path", "rule_key", "start_line", "level")


@query("l03_regex", "SELECT 'y' || p_partkey AS path, 'rule' || p_size AS rule_key, CAST(p_size AS BIGINT) AS start_line, CAST(CASE WHEN p_partkey % 2 = 0 THEN 50 ELSE 40 END AS BIGINT) AS level FROM part")
def l03(t):
    """Output lines by a pattern with named groups."""
    return linters.regex(outputs(t, "concat('y', p_partkey, ':', p_size, ':2: [', if(p_partkey % 2 = 0, 'error', 'warning'), '] text (rule', p_size, ')\\r\\nnoise')"), r"^(?<path>[^:]+):(?<line>\d+):(?<col>\d+): \[(?<severity>\w+)\] (?<message>.*) \((?<code>\w+)\)$").select("path", "rule_key", "start_line", "level")


@query("l01_sarif", """SELECT 'u' || p_partkey AS path, 'R' || (p_partkey % 2) AS rule_key, CAST(CASE WHEN p_size > 30 THEN 30 WHEN p_partkey % 2 = 0 THEN 50 ELSE 40 END AS BIGINT) AS level, CAST(p_size AS BIGINT) AS end_line
  FROM part WHERE p_size % 5 <> 0""")
def l01(t):
    """SARIF results joined to their rules."""
    return linters.sarif(outputs(t, """to_json(named_struct('runs', array(named_struct(
      'tool', named_struct('driver', named_struct('rules', array(named_struct('id', 'R0', 'defaultConfiguration', named_struct('level', 'error')), named_struct('id', 'R1', 'defaultConfiguration', named_struct('level', 'warning'))))),
      'results', array(named_struct('ruleId', concat('R', p_partkey % 2), 'level', if(p_size > 30, 'note', null), 'message', named_struct('text', 'm'), 'suppressions', if(p_size % 5 = 0, array(named_struct('status', 'accepted')), null),
        'locations', array(named_struct('physicalLocation', named_struct('artifactLocation', named_struct('uri', concat('u', p_partkey)), 'region', named_struct('startLine', p_size))))))))))""")).select("path", "rule_key", "level", "end_line")
