"""Metrics, structure rules and duplication over node tables.

Trees never need recursion: nesting is a running sum over the Euler tour, containment is
a comparison of intervals, and intervals of one tree are nested or disjoint.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

# Classes that count, and default thresholds of the structure rules.
BRANCHES = ("if", "elsif", "conditional_assignment", "ternary", "case", "loop", "except", "try", "binary")
CONTROLS = ("if", "ternary", "switch", "loop", "except")
THRESHOLDS = {"boolean-logic": 4, "file-complexity": 50, "function-complexity": 18, "nested-control-flow": 5, "function-parameters": 6, "return-statements": 6}
#: Levels of a tree that metrics look at.
VISITED = 300
ITERATORS = ("filter", "map", "any", "all")
EFFORT = {"boolean-logic": (10, 12), "file-complexity": (50, 20), "function-complexity": (10, 5), "nested-control-flow": (15, 10), "function-parameters": (15, 2), "return-statements": (15, 5)}


def visited(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("depth") <= VISITED)


def nesting(nodes: DataFrame, classes, name: str, keys=("path",)) -> DataFrame:
    """``name``: how many ancestors of a node are of ``classes`` (or fulfil that condition); one sort a file, no self-join."""
    events = nodes.withColumn("_at", F.explode(F.array("enter", "leave")))
    counts = classes if isinstance(classes, Column) else F.col("class").isin(*classes)
    step = F.when(~F.coalesce(counts, F.lit(False)), 0).when(F.col("_at") == F.col("enter"), 1).otherwise(-1)
    before = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    level = F.coalesce(F.sum(step).over(before), F.lit(0))
    return events.withColumn(name, level).where("_at = enter").drop("_at")


def _by_level(nodes: DataFrame, cls: str) -> DataFrame:
    """``_level``: how many nodes of ``cls`` hold the node, itself (``_own``) included."""
    rows = nesting(nodes, [cls], "_n").withColumn("_own", (F.coalesce(F.col("class"), F.lit("")) == cls).cast("int"))
    return rows.withColumn("_level", F.col("_n") + F.col("_own")).drop("_n")


def innermost(nodes: DataFrame, cls: str, name: str, value: str = "enter") -> DataFrame:
    """``name``: ``value`` of the innermost node of ``cls`` that holds the node, itself included.

    A node of depth d of that class is the last one entered at nesting d, so a window by
    nesting finds it without a range join.
    """
    rows = _by_level(nodes, cls)
    last = Window.partitionBy("path", "_level").orderBy("enter").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("_own") == 1, F.col(value)), ignorenulls=True).over(last)
    return rows.withColumn(name, F.when(F.col("_level") > 0, found)).drop("_own", "_level")


def enclosing(nodes: DataFrame, cls: str, name: str) -> DataFrame:
    """One row for each node and each node of ``cls`` that holds it, itself included; ``name`` is ``enter`` of the latter."""
    rows = _by_level(nodes, cls).where("_level > 0").withColumn("_up", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_level").cast("bigint"))))
    last = Window.partitionBy("path", "_up").orderBy("enter").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when((F.col("_own") == 1) & (F.col("_level") == F.col("_up")), F.col("enter")), ignorenulls=True).over(last)
    return rows.withColumn(name, found).drop("_own", "_level", "_up")


def cyclomatic(nodes: DataFrame, *keys: str) -> DataFrame:
    """1 and one for each branch and each call of an iterator method."""
    called = (F.col("class") == "call") & F.col("name").isin(*ITERATORS)
    return visited(nodes).groupBy(*(keys or ("path",))).agg((F.count_if(F.col("class").isin(*BRANCHES) | called) + 1).alias("cyclomatic"))


def counted_nodes() -> Column:
    """Nodes that cognitive complexity depends on, and the root, which stands for a file without any."""
    return (F.col("depth") == 0) | F.col("class").isin(*CONTROLS, "function", "closure", "operator", "else", "elsif", "jump", "conditional_assignment") | ((F.col("class") == "call") & F.col("note").eqNullSafe("self"))


def cognitive(nodes: DataFrame, *keys: str) -> DataFrame:
    """Control nodes count 1 and their nesting; elses, else-ifs, jumps, conditional assignments and calls of the function itself count 1.

    Closures and functions inside functions nest only. A boolean operator counts 1 if it
    differs from the last one of the same file or function, wherever that was. An else-if
    belongs to the chain of the if above it, so it adds no nesting of its own. A function
    that only makes and returns one isn't counted as a function that others are inside of.
    """
    keys = keys or ("path",)
    rows = visited(nodes).where(counted_nodes()).select(*keys, "enter", "leave", "class", "name", "note", "caller").withColumn("_at", F.explode(F.array("enter", "leave")))
    opens = F.col("_at") == F.col("enter")
    step = F.when(opens, 1).otherwise(-1)
    before = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # one sort for all sums

    def running(condition):
        return F.coalesce(F.sum(F.when(condition, step).otherwise(0)).over(before), F.lit(0))

    kind = F.coalesce("class", F.lit(""))
    decorator = F.coalesce(F.col("note") == "decorator", F.lit(False))
    function, control = kind == "function", kind.isin(*CONTROLS)
    counted = function & ~decorator
    rows = rows.withColumn("_outer", running(counted) - F.when(~opens & counted, 1).otherwise(0))
    nests = control | (kind == "closure") | (function & (F.col("_outer") >= F.when(decorator, 2).otherwise(1)))
    last = F.last(F.when(opens & (kind == "operator"), F.col("name")), ignorenulls=True).over(before)
    rows = rows.withColumn("_nest", running(nests)).withColumn("_last", last).where(opens)
    changes = (kind == "operator") & ~F.col("name").eqNullSafe(F.col("_last"))
    recursive = (kind == "call") & F.col("note").eqNullSafe("self") & F.coalesce(F.col("name") == F.col("caller"), F.lit(False))
    flat = kind.isin("else", "elsif", "jump", "conditional_assignment") | changes | recursive
    cost = F.when(control, 1 + F.col("_nest")).when(flat, 1).otherwise(0)
    return rows.groupBy(*keys).agg(F.sum(cost).cast("bigint").alias("complexity"))


def boolean_depth(nodes: DataFrame) -> DataFrame:
    """(path, depth): how deep boolean operators nest."""
    return nesting(visited(nodes).where("class = 'binary'"), ["binary"], "_b").groupBy("path").agg(F.max(F.col("_b") + 1).cast("bigint").alias("depth"))


def control_depth(nodes: DataFrame) -> DataFrame:
    return nesting(visited(nodes).where(F.col("class").isin(*CONTROLS)), CONTROLS, "_c").groupBy("path").agg(F.max(F.col("_c") + 1).cast("bigint").alias("depth"))


def counts(nodes: DataFrame) -> DataFrame:
    """(path, classes, functions, fields): fields are counted by name; what is called is no field."""
    return nodes.groupBy("path").agg(F.count_if(F.col("class") == "class").alias("classes"), F.count_if(F.col("class") == "function").alias("functions"), F.count_distinct(F.when((F.col("class") == "field") & ~F.col("note").eqNullSafe("called"), F.col("name"))).alias("fields"))


def parameters(nodes: DataFrame) -> DataFrame:
    """(path, function, n): parameters of each function; self and cls don't count."""
    is_list, is_arg, is_function = F.col("kind") == "arguments", F.col("kind") == "arg", F.coalesce(F.col("class") == "function", F.lit(False))
    rows = nodes.where(is_list | is_arg | is_function)
    of_list = F.when(is_function, -1 - F.col("enter")).when(is_list, F.col("enter")).otherwise(F.col("parent"))  # a list and its parameters, or a function
    owner = F.when(is_function, F.col("enter")).when(is_list, F.col("parent"))
    own = [F.max(F.when(is_function, F.col(c))).alias(c) for c in ("name", "start_line", "end_line")]
    counted = F.count_if(is_arg & ~F.coalesce("name", F.lit("")).isin("self", "cls")).alias("n")
    lists = rows.groupBy("path", of_list.alias("_list")).agg(F.max(owner).alias("function"), F.max(is_function).alias("_is"), *own, counted)
    return lists.where("function IS NOT NULL").groupBy("path", "function").agg(F.max("name").alias("name"), F.max("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.sum("n").alias("n"), F.max("_is").alias("_is")).where("_is").drop("_is")


def returns(nodes: DataFrame) -> DataFrame:
    """(path, function, n): return statements of the innermost function."""
    inside = innermost(nodes.where("class IN ('function', 'return')"), "function", "function").where("class = 'return'")
    return inside.where("function IS NOT NULL").groupBy("path", "function").agg(F.count("*").alias("n"))


def lcom4(nodes: DataFrame) -> DataFrame:
    """(path, lcom4): the largest number of separate groups of methods of any class.

    Methods are linked through attributes of self that they share or the methods they
    call; constructors and methods that touch nothing don't count.
    """
    rows = nodes.where("class IN ('class', 'function', 'field') OR (kind = 'Name' AND name = 'self')")
    rows = innermost(innermost(rows, "class", "cls"), "function", "fn").where("cls IS NOT NULL AND fn IS NOT NULL")
    names = rows.where("class = 'function' AND enter = fn").select("path", "cls", "fn", F.col("name").alias("method"))
    own = rows.where("kind = 'Name' AND name = 'self'").select("path", F.col("parent").alias("enter"))
    used = rows.where("class = 'field'").join(own.hint("merge"), ["path", "enter"], "left_semi").select("path", "cls", "fn", F.col("name").alias("member"))
    edges = names.where("method NOT IN ('__init__', '__new__', '__del__')").join(used.hint("merge"), ["path", "cls", "fn"])
    classes = edges.groupBy("path", "cls").agg(F.collect_set(F.struct("method", "member")).alias("edges"))

    def groups(edges) -> int:
        leader: dict[str, str] = {}

        def find(x):
            while leader.setdefault(x, x) != x:
                x = leader[x]
            return x

        for e in edges:
            leader[find(e["method"])] = find(e["member"])
        return len({find(e["method"]) for e in edges})

    def counted(frames):
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "n": [groups(e) for e in frame["edges"]]})

    return classes.select("path", "edges").mapInPandas(counted, "path string, n long").groupBy("path").agg(F.max("n").alias("lcom4"))


def structure_issues(nodes: DataFrame, thresholds: dict[str, int] | None = None) -> DataFrame:
    """(path, rule_key, value, value_delta, effort_minutes) of the rules that fire; a threshold of None switches a rule off."""
    limits = {**THRESHOLDS, **(thresholds or {})}
    nodes = stored(nodes, "nodes")  # read by every rule; sources are parsed once
    in_function = enclosing(nodes.where(counted_nodes()), "function", "function")
    values = {
        "boolean-logic": boolean_depth(nodes).select("path", F.col("depth").alias("value")),
        "nested-control-flow": control_depth(nodes).select("path", F.col("depth").alias("value")),
        "file-complexity": cognitive(nodes).select("path", F.col("complexity").alias("value")),
        "function-complexity": cognitive(in_function, "path", "function").select("path", F.col("complexity").alias("value")),
        "function-parameters": parameters(nodes).select("path", F.col("n").alias("value")),
        "return-statements": returns(nodes).select("path", F.col("n").alias("value")),
    }
    out = None
    for rule, rows in values.items():
        limit = limits[rule]
        if limit is None:
            continue
        base, per = EFFORT[rule]
        once = rule in ("boolean-logic", "nested-control-flow")  # reported when the depth is reached, with the threshold as value
        value = F.lit(limit).cast("bigint") if once else F.col("value")
        hit = rows.where(F.col("value") >= limit).select("path", F.lit(rule).alias("rule_key"), value.alias("value"), (value - limit).cast("bigint").alias("value_delta"), (base + (value - limit) * per).cast("bigint").alias("effort_minutes"))
        out = hit if out is None else out.unionByName(hit)
    return out


# ------------------------------------------------------------------ duplication


MIN_MASS = 64
#: Columns of the node table that ``duplicates`` reads.
DUPLICATION = ("path", "enter", "leave", "start_line", "end_line", "mass", "structural_hash", "source_hash")


def duplicates(nodes: DataFrame, min_mass: int = MIN_MASS, min_lines: int = 15) -> DataFrame:
    """One row for each occurrence of code found more than once.

    Groups of nodes with one structural digest and enough mass; digests that occur inside
    another group's node are dropped; a group is identical if its sources are.
    """
    big = stored(nodes.where(F.col("mass") >= min_mass), "big-nodes")
    sizes = big.groupBy("structural_hash").agg(F.count("*").alias("n"), F.coalesce(F.min("source_hash") == F.max("source_hash"), F.lit(False)).alias("identical")).where("n > 1")
    members = big.join(sizes, "structural_hash")
    before = Window.partitionBy("path").orderBy("enter").rowsBetween(Window.unboundedPreceding, -1)
    inner = members.withColumn("_end", F.max("leave").over(before)).where("_end > leave").select("structural_hash").distinct()
    kept = members.join(inner, "structural_hash", "left_anti").withColumn("lines", (F.col("end_line") - F.col("start_line") + 1).cast("bigint"))
    kept = kept.where(F.col("lines") >= min_lines)
    kind = F.when(F.col("identical"), "identical").otherwise("similar")
    message = F.format_string("Found %d lines of %s code in %d locations (mass = %d)", "lines", kind, "n", "mass")
    delta = F.col("lines") - min_lines
    return kept.select("path", "start_line", "end_line", F.concat(kind, F.lit("-code")).alias("rule_key"), message.alias("message"), "lines", "n", "mass", "structural_hash", delta.alias("value_delta"), (10 + 5 * delta).cast("bigint").alias("effort_minutes"))


def with_other_locations(rows: DataFrame, limit: int = 21) -> DataFrame:
    """``other_locations``: the group's first ``limit`` places without the row's own.

    Only the first places of a group are gathered, whatever its size.
    """
    place = F.struct("path", "start_line", "end_line")
    order = Window.partitionBy("structural_hash").orderBy("path", "start_line", "end_line")
    first = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).groupBy("structural_hash").agg(F.array_sort(F.collect_list(place)).alias("_all"))
    return rows.join(first, "structural_hash").withColumn("other_locations", F.filter("_all", lambda x: x != place)).drop("_all")
