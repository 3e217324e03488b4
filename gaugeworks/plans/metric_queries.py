"""Whole metrics, patterns and exclusion over Python programs made from parts.

A part's program has a class with branches of every sort, p_partkey % 3 + 1 functions with
p_size % 4 nested ifs and a function inside, comments, blank lines, an import and a test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import dealt
from ..catalog import query
from ..operators import issues, patterns, stats
from ..sources.trees import nodes
from ..storage import stored

CLASS = '''import os

class Box:
    """Doc
    of two lines"""

    def __init__(self, v):
        self.v = v

    def get(self, n):
        # about n
        if n and self.v or n:
            return self.get(n)
        elif n:
            pass
        else:
            n = any(n)
        try:
            n = 2
        except ValueError:
            n = self.w
        return n

'''
TESTS = ['((function_definition name: (identifier) @name) @test (#match? @name "^test_"))']
IMPORTS = ["(import_statement _)"]


def programs(t):
    deep = "if(p_size % 4 > 0, array_join(transform(sequence(1, greatest(1, p_size % 4)), j -> concat(repeat('    ', j + 1), 'if y:\\n')), ''), '')"
    loop = f"concat('def f', i, '(x):\\n    for y in x:\\n', {deep}, repeat('    ', 2 + p_size % 4), 'break\\n')"
    inner = "concat('    def inner(z):\\n        return z if z else f', i, '(z)\\n    return inner\\n\\n')"
    free = F.expr(f"array_join(transform(sequence(0, int(p_partkey % 3)), i -> concat({loop}, {inner})), '')")
    test = F.concat(F.lit("def test_"), F.col("p_partkey").cast("string"), F.lit("():\n    assert f0([])\n"))
    body = F.concat(F.lit("# part "), F.col("p_partkey").cast("string"), F.lit("\n" + CLASS), free, test)
    return dealt(t("part")).select(F.concat(F.lit("m"), F.col("p_partkey"), F.lit(".py")).alias("path"), body.alias("contents"))


M = "WITH m AS (SELECT 'm' || p_partkey || '.py' AS path, p_partkey, CAST(p_partkey % 3 + 1 AS BIGINT) AS m, CAST(p_size % 4 AS BIGINT) AS a FROM part)"
FILE = """SELECT 'FILE' AS kind, path AS fully_qualified_name, path, CAST(1 AS BIGINT) AS files, CAST(1 AS BIGINT) AS classes, 2 + 2 * m + {t} AS functions, CAST(2 AS BIGINT) AS fields,
  7 + m * (2 + a) AS cyclomatic, 7 + m * (4 + a + a * (a + 1) // 2) AS complexity, CAST(1 AS BIGINT) AS lcom4,
  26 + m * (7 + a) AS lines, 18 + 2 * {t} + m * (6 + a) AS code_lines, CAST(2 AS BIGINT) AS comment_lines, 6 - 2 * {t} + m AS blank_lines FROM m"""
FUNCTION = """SELECT 'FUNCTION' AS kind, name, fully_qualified_name, path, CAST(start_line AS INTEGER) AS start_line, CAST(fields AS BIGINT) AS fields, CAST(cyclomatic AS BIGINT) AS cyclomatic,
  CAST(complexity AS BIGINT) AS complexity, CAST(code + comment AS BIGINT) AS lines, CAST(code AS BIGINT) AS code_lines, CAST(comment AS BIGINT) AS comment_lines, CAST(0 AS BIGINT) AS blank_lines FROM (
  SELECT path, '__init__' AS name, 'Box#__init__' AS fully_qualified_name, 8 AS start_line, 1 AS fields, 1 AS cyclomatic, 0 AS complexity, 2 AS code, 0 AS comment FROM m
  UNION ALL SELECT path, 'get', 'Box#get', 11, 2, 7, 7, 12, 1 FROM m
  UNION ALL SELECT path, 'f' || i, 'f' || i, 25 + i * (7 + a), 0, 3 + a, 4 + a + a * (a + 1) // 2, 6 + a, 0 FROM m, range(3) r(i) WHERE i < m
  UNION ALL SELECT path, 'inner', 'inner', 25 + i * (7 + a) + 3 + a, 0, 2, 1, 2, 0 FROM m, range(3) r(i) WHERE i < m
  UNION ALL SELECT path, 'test_' || p_partkey, 'test_' || p_partkey, 25 + m * (7 + a), 0, 1, 0, 2, 0 FROM m) AS f"""


@query("t10_file_stats", f"{M} {FILE.format(t=1)}")
def t10(t):
    """Counts, complexities and lines of each file."""
    return stats.file_stats(programs(t))


@query("t11_function_stats", f"{M} {FUNCTION}")
def t11(t):
    """The same of each function, under its full name."""
    return stats.function_stats(programs(t))


@query("t12_file_stats_without_tests", f"{M} {FILE.format(t=0)}")
def t12(t):
    """Files without what the patterns of test code capture."""
    return stats.file_stats(programs(t), TESTS)


@query("t12_function_stats_without_tests", f"{M} SELECT * FROM ({FUNCTION}) WHERE name NOT LIKE 'test%'")
def t12_functions(t):
    """Functions without those that the patterns of test code capture."""
    return stats.function_stats(programs(t), TESTS)


@query("t09_lines", f"{M} SELECT path, lines, code_lines, comment_lines, blank_lines FROM ({FILE.format(t=1)})")
def t09(t):
    """Code, comment and blank lines; code wins."""
    return stats.file_lines(programs(t))


@query("o03_stats_positions", f"""{M}, s AS (SELECT kind, fully_qualified_name, path, CAST(NULL AS INTEGER) AS start_line FROM ({FILE.format(t=1)}) UNION ALL SELECT kind, fully_qualified_name, path, start_line FROM ({FUNCTION}))
  SELECT *, row_number() OVER (ORDER BY kind, fully_qualified_name, path, start_line) AS position FROM s""")
def o03(t):
    """Every row's place by kind and full name."""
    return issues.positions(stats.stats_order(stored(stats.names(programs(t)), "stats-names"), "start_line"))


SHAPES = [
    '((function_definition name: (identifier) @name) @f (#match? @name "^f[0-9]"))',
    "(If test: (Name) @test body: (Break) @jump)",
    "(class_definition body: (function_definition name: (identifier) @method))",
    "(FunctionDef (For) @loop . (FunctionDef) @next (Return) @last .)",
    '(Call func: (_) @called args: (Name) @given (#any-of? @called "self.get" "any"))',
    "((Import) @i . (ClassDef) @c)",
]


@query("t02_pattern_captures", f"""{M}, c AS (SELECT path, 0 AS pattern, unnest(['name', 'f']) AS capture, m AS n FROM m
  UNION ALL SELECT path, 1, unnest(['test', 'jump']), m FROM m WHERE a > 0
  UNION ALL SELECT path, 2, 'method', 2 FROM m
  UNION ALL SELECT path, 3, unnest(['loop', 'next', 'last']), m FROM m
  UNION ALL SELECT path, 4, unnest(['called', 'given']), 2 FROM m
  UNION ALL SELECT path, 5, unnest(['i', 'c']), 1 FROM m) SELECT path, pattern, capture, CAST(n AS BIGINT) AS n FROM c""")
def t02(t):
    """Captures of six patterns in each file."""
    return patterns.source_captures(programs(t), SHAPES, texts=False).groupBy("path", "pattern", "capture").agg(F.count("*").alias("n"))


@query("t02_captured_names", f"""{M} SELECT path, '__init__' AS name, CAST(5 AS BIGINT) AS parent_kind FROM m WHERE false
  UNION ALL SELECT path, unnest(['__init__', 'get']), 1 FROM m UNION ALL SELECT path, 'f' || i, 0 FROM m, range(3) r(i) WHERE i < m""")
def t02_names(t):
    """Names that a pattern of methods (1) and one of functions outside classes (0) capture."""
    found = patterns.source_captures(programs(t), ['(module (function_definition name: (identifier) @name (#not-match? @name "^test")))', "(class_definition (function_definition name: (identifier) @name))"])
    return found.select("path", F.col("text").alias("name"), F.col("pattern").cast("bigint").alias("parent_kind"))


@query("f11_kept_nodes", f"{M} SELECT path, CAST(8 AS BIGINT) AS excluded, 2 + 2 * m AS functions FROM m")
def f11(t):
    """Nodes inside imports and tests, which exclusion drops, and functions that stay."""
    files = stored(programs(t), "programs")
    tree = stored(nodes(files, "python", digests=False, columns=patterns.COLUMNS), "nodes")
    ranges = patterns.all_captured(stored(patterns.pattern_nodes(tree, files), "pattern-nodes"), [*TESTS, *IMPORTS])
    kept = patterns.exclude(tree, ranges).groupBy("path").agg(F.count("*").alias("kept"), F.count_if(F.col("class") == "function").alias("functions"))
    return tree.groupBy("path").agg(F.count("*").alias("n")).join(kept, "path").select("path", (F.col("n") - F.col("kept")).alias("excluded"), "functions")
