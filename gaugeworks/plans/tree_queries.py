"""Tree metrics over Python sources made from parts, and duplication over HTML pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import dealt
from ..catalog import query
from ..operators import trees
from ..sources.trees import nodes


def sources(t, *more):
    """A function a part: p_size % 7 parameters, p_partkey % 9 ifs with returns, nested loops of depth p_size % 6."""
    ifs = F.expr("array_join(if(p_partkey % 9 > 0, transform(sequence(1, greatest(1, int(p_partkey % 9))), i -> concat('    if x > ', i, ':\\n        return ', i, '\\n')), cast(array() AS array<string>)), '')")
    loops = F.expr("array_join(if(p_size % 6 > 0, transform(sequence(1, greatest(1, p_size % 6)), i -> concat(repeat('    ', i), 'for y in z:\\n')), cast(array() AS array<string>)), '')")
    params = F.expr("array_join(concat(array('self'), if(p_size % 7 > 0, transform(sequence(1, greatest(1, p_size % 7)), i -> concat('a', i)), cast(array() AS array<string>))), ', ')")
    body = F.concat(F.lit("def f("), params, F.lit("):\n"), ifs, loops, F.expr("repeat('    ', 1 + p_size % 6)"), F.lit("x = 1\n"))
    return dealt(t("part")).select(F.concat(F.lit("p"), F.col("p_partkey"), F.lit(".py")).alias("path"), body.alias("contents"), *more)


def python(t, *columns):
    return nodes(sources(t), "python", digests=False, columns=("path", *columns))


P = "SELECT 'p' || p_partkey || '.py' AS path"


@query("t04_cyclomatic", f"{P}, CAST(1 + p_partkey % 9 + p_size % 6 AS BIGINT) AS cyclomatic FROM part")
def t04(t):
    """Cyclomatic complexity."""
    return trees.cyclomatic(python(t, "depth", "class", "name"))


@query("t05_cognitive", f"{P}, CAST(p_partkey % 9 + (p_size % 6) * (p_size % 6 + 1) // 2 AS BIGINT) AS complexity FROM part")
def t05(t):
    """Cognitive complexity; loops cost their nesting."""
    return trees.cognitive(python(t, "enter", "leave", "depth", "class", "name", "note", "caller"))


@query("w01_control_depth", f"{P}, CAST(greatest(p_size % 6, CASE WHEN p_partkey % 9 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS depth FROM part WHERE p_size % 6 > 0 OR p_partkey % 9 > 0")
def w01(t):
    """Nesting by a running sum."""
    return trees.control_depth(python(t, "enter", "leave", "depth", "class"))


@query("r05_parameters", f"{P}, CAST(p_size % 7 AS BIGINT) AS n FROM part")
def r05(t):
    """Parameters of functions."""
    return trees.parameters(python(t, "enter", "parent", "kind", "class", "name", "start_line", "end_line")).select("path", "n")


@query("r06_returns", f"{P}, CAST(p_partkey % 9 AS BIGINT) AS n FROM part WHERE p_partkey % 9 > 0")
def r06(t):
    """Return statements of functions."""
    return trees.returns(python(t, "enter", "leave", "class")).select("path", "n")


@query("r00_structure_issues", f"""WITH v AS ({P}, p_partkey % 9 AS r, p_size % 6 AS d, p_size % 7 AS a, p_partkey % 9 + (p_size % 6) * (p_size % 6 + 1) // 2 AS c FROM part)
  SELECT path, 'return-statements' AS rule_key, CAST(r AS BIGINT) AS value, CAST(15 + (r - 6) * 5 AS BIGINT) AS effort_minutes FROM v WHERE r >= 6
  UNION ALL SELECT path, 'function-parameters', CAST(a AS BIGINT), CAST(15 + (a - 6) * 2 AS BIGINT) FROM v WHERE a >= 6
  UNION ALL SELECT path, 'nested-control-flow', 5, 15 FROM v WHERE d >= 5
  UNION ALL SELECT path, 'function-complexity', CAST(c AS BIGINT), CAST(10 + (c - 18) * 5 AS BIGINT) FROM v WHERE c >= 18
  UNION ALL SELECT path, 'file-complexity', CAST(c AS BIGINT), CAST(50 + (c - 50) * 20 AS BIGINT) FROM v WHERE c >= 50""")
def r00(t):
    """All structure rules."""
    return trees.structure_issues(python(t, "enter", "leave", "parent", "depth", "kind", "class", "name", "note", "caller", "start_line", "end_line")).select("path", "rule_key", "value", "effort_minutes")


@query("t07_counts", f"{P}, CAST(0 AS BIGINT) AS classes, CAST(1 AS BIGINT) AS functions, CAST(0 AS BIGINT) AS fields FROM part")
def t07(t):
    """Classes, functions and fields."""
    return trees.counts(python(t, "class", "name", "note"))


@query("j04_enclosing_function", f"{P}, CAST(p_partkey % 9 AS BIGINT) AS inside FROM part")
def j04(t):
    """If nodes inside a function, by intervals."""
    rows = python(t, "enter", "leave", "depth", "class").where("class IN ('function', 'if') OR depth = 0")  # a root for each file
    rows = trees.innermost(rows, "function", "function")
    return rows.groupBy("path").agg(F.count_if((F.col("class") == "if") & F.col("function").isNotNull()).alias("inside"))


@query("d07_duplicate_python", """WITH f AS (SELECT 'p' || p_partkey || '.py' AS path, p_partkey % 9 AS r, p_size % 6 AS d, p_size % 7 AS a FROM part),
  g AS (SELECT *, count(*) OVER (PARTITION BY r, d, a) AS n FROM f) SELECT path, n FROM g WHERE n > 1 AND r > 0""")
def d07(t):
    """Occurrences of code found more than once (whole files here)."""
    rows = trees.duplicates(nodes(sources(t), "python", least_mass=8).where("kind = 'Module'").withColumn("end_line", F.lit(20)), min_mass=8, min_lines=1)
    made = sources(t).where("contents LIKE '%return%'").select("path")
    return rows.join(made, "path", "left_semi").select("path", "n")


def modules(t):
    """A file a part: statements that spell its key, so no two files are alike, the part's function, and a function g that many files share, with an inner loop."""
    head = F.expr("array_join(transform(sequence(0, 31), i -> if(shiftright(p_partkey, i) % 2 = 1, 'k()\n', 'k = 1\n')), '')")
    ifs = F.expr("array_join(transform(sequence(1, int(8 + p_partkey % 3)), i -> concat('        if y > ', i, ':\n            return y + ', p_partkey % 2, '\n')), '')")
    g = F.concat(F.lit("\n\ndef g(z):\n    for y in z:\n"), ifs, F.lit("    return z\n"))
    return sources(t, head.alias("head"), g.alias("g")).select("path", F.concat("head", "contents", "g").alias("contents"))


def heavy(t):
    """Nodes of modules that are large enough to be reported."""
    return nodes(modules(t), "python", columns=trees.DUPLICATION, least_mass=trees.MIN_MASS)


@query("d07_duplicate_functions")
def d07_functions(t):
    """Occurrences of code found more than once, inside files too, at the default thresholds."""
    rows = trees.duplicates(heavy(t))
    return rows.select("path", "start_line", "end_line", "rule_key", "n", "mass", "lines", "effort_minutes")


@query("d05_duplicate_html")
def d05(t):
    """Identical and similar HTML of pages, with the other places."""
    pages = t("pages").select(F.concat(F.lit("page"), "page_id").alias("path"), F.col("html").alias("contents"))
    rows = trees.with_other_locations(trees.duplicates(nodes(pages, "html", columns=trees.DUPLICATION, least_mass=5), min_mass=5, min_lines=1))
    return rows.select("path", "start_line", "end_line", "rule_key", "n", "mass", F.size("other_locations").alias("others"))
