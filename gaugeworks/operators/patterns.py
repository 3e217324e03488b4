"""Patterns over syntax trees, matched by joins on node tables, and the exclusion of subtrees.

A pattern is a small tree in the notation of tree-sitter queries:

    (FunctionDef name: (identifier) @name (#match? @name "^test_")) @test
    (Import _)
    (If test: (Name) body: [(Return) (Raise)] @exit)
    ((Import) . (Import) @second)

``(kind ...)`` is a node of that kind, ``(_)`` any node, ``_`` any child, ``[...]`` one of
several; ``field:`` asks for the parent's name of a child, ``.`` for children next to each
other, first or last; ``@x`` captures. Children of a pattern are found in their order, with
others between them. A group, a pattern in parentheses of its own, is matched among the
children of any node. Predicates ``#eq? #not-eq? #match? #not-match? #any-of?`` compare a
capture's source with literals; the name of a function or class counts as a child
``name: (identifier)``, as grammars have it. Kinds are those of the node table, or the
grammar's names for Python in ``GRAMMAR``.

Matching never lists embeddings, whose number can be a product over siblings. Bottom-up, the
nodes that can stand for each part of a pattern are found by equi-joins on (path, parent): a
part is reached if the earliest place of the part before it lies ahead. Top-down and from the
last part to the first the same is asked of what follows, so what stays occurs in some match.
Each join moves nodes of the pattern's kinds only. Sources at hand are matched file by file in
the task that parses them instead (``source_captures``), so that their nodes aren't moved at all.

Defined cases: equal captures of several patterns are rows of each; a null path is a path of
its own; a table without nodes gives no rows; a pattern that can't be read is an error that
names the place.
"""

from __future__ import annotations

import dataclasses
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.trees import nodes, per_text, python_nodes
from ..storage import stored

# Names that the Python grammar gives to kinds of the node table.
GRAMMAR = {
    "module": ("Module",), "import_statement": ("Import",), "import_from_statement": ("ImportFrom",), "function_definition": ("FunctionDef", "AsyncFunctionDef"),
    "class_definition": ("ClassDef",), "call": ("Call",), "attribute": ("Attribute",), "if_statement": ("If",), "for_statement": ("For", "AsyncFor"), "while_statement": ("While",),
    "return_statement": ("Return",), "raise_statement": ("Raise",), "assert_statement": ("Assert",), "with_statement": ("With", "AsyncWith"), "lambda": ("Lambda",), "boolean_operator": ("BoolOp",),
    "assignment": ("Assign", "AnnAssign"), "expression_statement": ("Expr",), "decorator": ("decorator",), "identifier": ("identifier", "Name"),
}
TOKEN = re.compile(r'\s*(?:;[^\n]*\n\s*)*(?P<t>[()\[\].]|"(?:[^"\\]|\\.)*"|@[\w.-]+|#[\w-]+\?|[\w-]+:?|$)', re.S)
PREDICATES = ("#eq?", "#not-eq?", "#match?", "#not-match?", "#any-of?")


@dataclasses.dataclass
class Part:
    """A node of a pattern. ``kinds`` is None for any; ``near`` and ``end`` are anchors before it and after its last child."""

    kinds: tuple[str, ...] | None
    field: str | None = None
    children: list[Part] = dataclasses.field(default_factory=list)
    options: list[Part] = dataclasses.field(default_factory=list)
    captures: list[str] = dataclasses.field(default_factory=list)
    near: bool = False
    end: bool = False
    group: bool = False


class PatternError(ValueError):
    pass


class _Reader:
    def __init__(self, text: str):
        self.text, self.at, self.predicates = text, 0, []

    def peek(self) -> str:
        m = TOKEN.match(self.text, self.at)
        if m is None:
            raise PatternError(f"unreadable at {self.at}: {self.text[self.at:self.at + 20]!r}")
        return m["t"]

    def take(self, wanted: str | None = None) -> str:
        m = TOKEN.match(self.text, self.at)
        token = self.peek()
        if wanted is not None and token != wanted:
            raise PatternError(f"{wanted!r} expected at {self.at}: {self.text[self.at:self.at + 20]!r}")
        self.at = m.end()
        return token

    def part(self) -> Part:
        name = None
        if self.peek().endswith(":"):
            name = self.take()[:-1]
        token = self.take()
        if token == "_":
            made = Part(None)
        elif token == "[":
            made = Part(None)
            while self.peek() != "]":
                made.options.append(self.part())
            self.take("]")
        elif token == "(":
            made = Part(None, group=self.peek() in ("(", "["))
            if not made.group:
                kind = self.take()
                made.kinds = None if kind == "_" else GRAMMAR.get(kind, (kind,))
            self.children(made)
        else:
            raise PatternError(f"a node expected at {self.at}: {token!r}")
        made.field = name
        while self.peek().startswith("@"):
            made.captures.append(self.take()[1:])
        return made

    def children(self, made: Part) -> None:
        near = False
        while self.peek() != ")":
            if self.peek() == ".":
                self.take()
                near = True
            elif self.peek() == "(" and re.match(r"\s*\(\s*#", self.text[self.at :]):
                self.take("(")
                self.predicate()
            elif self.peek() == "":
                raise PatternError("the pattern isn't closed")
            else:
                child = self.part()
                if child.group:
                    raise PatternError(f"a group inside a pattern before {self.at}")
                child.near, near = near, False
                made.children.append(child)
        made.end = near
        self.take(")")

    def predicate(self) -> None:
        name, args = self.take(), []
        while self.peek() != ")":
            args.append(self.take())
        self.take(")")
        if name not in PREDICATES or len(args) < 2 or not args[0].startswith("@") or any(a[:1] != '"' for a in args[1:]) or (len(args) > 2 and name != "#any-of?"):
            raise PatternError(f"a predicate on a capture and literals expected: {name} {' '.join(args)}")
        self.predicates.append((name, args[0][1:], [re.sub(r"\\(.)", r"\1", a[1:-1]) for a in args[1:]]))


def read(pattern: str) -> tuple[Part, list[tuple[str, str, list[str]]]]:
    """A pattern's tree and its predicates."""
    reader = _Reader(pattern)
    part = reader.part()
    reader.take("")
    return part, reader.predicates


# ------------------------------------------------------------------ node tables for patterns


#: Columns of the node table that patterns read.
COLUMNS = ("path", "enter", "parent", "position", "kind", "field", "name", "start_byte", "end_byte", "class")


def pattern_nodes(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(path, enter, parent, position, last, kind, field, start_byte, end_byte, text) of nodes and names.

    ``text`` is the node's source; names of functions and classes are children of their own,
    numbered before the others.
    """
    source = files.select(F.coalesce("path", F.lit("")).alias("_p"), F.col("path").isNull().alias("_n"), F.col("contents").cast("binary").alias("_b"))
    rows = nodes.select("path", "enter", "parent", "position", "kind", "field", "name", "start_byte", "end_byte", F.col("class").isin("function", "class").alias("named"))
    on = (F.coalesce("path", F.lit("")) == F.col("_p")) & (F.col("path").isNull() == F.col("_n"))
    text = F.substring(F.col("_b"), F.col("start_byte") + 1, F.col("end_byte") - F.col("start_byte")).cast("string")
    whole = rows.join(source.hint("merge"), on).select("path", "enter", "parent", F.col("position").cast("long").alias("position"), "kind", "field", "start_byte", "end_byte", text.alias("text"), "name", "named")
    bare = whole.drop("name", "named")
    names = whole.where("named").select("path", F.expr("-1 - enter").alias("enter"), F.col("enter").alias("parent"), F.lit(-1).cast("long").alias("position"), F.lit("identifier").alias("kind"), F.lit("name").alias("field"), "start_byte", "end_byte", F.col("name").alias("text"))
    return bare.unionByName(names)


KEY = ("path", "parent")


def _holds(test: str, literals: list[str]) -> Column:
    text = F.coalesce("text", F.lit(""))
    if test.endswith("match?"):
        held = text.rlike(literals[0])
    else:
        held = text.isin(*literals)
    return ~held if "not-" in test else held


def _on(a: str, b: str, *columns: str) -> Column:
    on = F.lit(True)
    for c in columns:
        x, y = F.col(f"{a}.{c}"), F.col(f"{b}.{c}")
        on = on & (x.eqNullSafe(y) if c == "path" else x == y)
    return on


class _Matcher:
    def __init__(self, table: DataFrame, predicates):
        self.table, self.predicates = table, predicates

    def candidates(self, part: Part) -> DataFrame:
        """Nodes that can stand for ``part`` by themselves and with what is below them."""
        rows = self.table
        if part.options:
            found = None
            for option in part.options:
                rows = self.candidates(option)
                found = rows if found is None else found.unionByName(rows)
            rows = found.distinct()
        elif part.kinds is not None:
            rows = rows.where(F.col("kind").isin(*part.kinds))
        if part.field is not None:
            rows = rows.where(F.col("field") == part.field)
        for test, capture, literals in self.predicates:
            if capture in part.captures:
                rows = rows.where(_holds(test, literals))
        if part.children:
            part.reached = self.reach(part)
            heads = part.reached[-1].select("path", F.col("parent").alias("enter")).distinct()
            rows = rows.alias("x").join(heads.hint("merge").alias("y"), _on("x", "y", "path", "enter"), "left_semi")
        return rows

    def reach(self, part: Part) -> list[DataFrame]:
        """For each child in turn: the nodes reached after the children before it."""
        out = []
        for k, child in enumerate(part.children):
            rows = self.candidates(child)
            if child.near and k == 0:
                rows = self._edge(rows, F.min)
            elif k and child.near:
                rows = rows.alias("x").join(out[-1].select("path", "parent", (F.col("position") + 1).alias("position")).distinct().hint("merge").alias("y"), _on("x", "y", *KEY, "position"), "left_semi")
            elif k:
                ahead = out[-1].groupBy(*KEY).agg(F.min("position").alias("bound"))
                rows = rows.alias("x").join(ahead.hint("merge").alias("y"), _on("x", "y", *KEY) & (F.col("x.position") > F.col("y.bound"))).select("x.*")
            if part.end and k == len(part.children) - 1:
                rows = self._edge(rows, F.max)
            out.append(stored(rows, "pattern-part"))
        return out

    def _edge(self, rows: DataFrame, which) -> DataFrame:
        """Of ``rows`` those that are the first or last child of their parent; names aren't counted."""
        ends = self.table.where("position >= 0").groupBy(*KEY).agg(which("position").alias("position"))
        return rows.alias("x").join(ends.hint("merge").alias("y"), _on("x", "y", *KEY, "position"), "left_semi")

    def captures(self, part: Part, rows: DataFrame) -> list[DataFrame]:
        """Captures at and below ``rows``, which are known to be part of a match; ``root`` is carried along."""
        out = [rows.select("path", "root", F.lit(c).alias("capture"), "enter", "start_byte", "end_byte", "text") for c in part.captures]
        for option in part.options:
            if option.captures or option.children:
                held = self.candidates(option)
                out += self.captures(option, rows.alias("x").join(held.hint("merge").alias("y"), _on("x", "y", "path", "enter"), "left_semi"))
        if not any(_captures(c) for c in part.children):
            return out
        parents = rows.select("path", "enter", "root").distinct()
        after, anchored = None, False
        for k in reversed(range(len(part.children))):
            child = part.children[k]
            own = part.reached[k].alias("x").join(parents.hint("merge").alias("p"), F.col("x.path").eqNullSafe(F.col("p.path")) & (F.col("x.parent") == F.col("p.enter"))).select("x.*", "p.root")
            if after is not None and anchored:
                own = own.alias("x").join(after.select("path", "parent", (F.col("position") - 1).alias("position")).distinct().hint("merge").alias("y"), _on("x", "y", *KEY, "position"), "left_semi")
            elif after is not None:
                bound = after.groupBy(*KEY).agg(F.max("position").alias("bound"))
                own = own.alias("x").join(bound.hint("merge").alias("y"), _on("x", "y", *KEY) & (F.col("x.position") < F.col("y.bound"))).select("x.*")
            own = stored(own, "pattern-child")
            out += self.captures(child, own)
            after, anchored = own, child.near
        return out


def _captures(part: Part) -> bool:
    return bool(part.captures) or any(_captures(c) for c in [*part.children, *part.options])


CAPTURES = "pattern int, path string, match int, capture string, enter int, start_byte int, end_byte int, text string"


def captures(table: DataFrame, patterns: list[str], limit: int | None = None) -> DataFrame:
    """(pattern, path, match, capture, enter, start_byte, end_byte, text): every node captured in some match.

    ``table`` comes from ``pattern_nodes``; ``match`` is ``enter`` of the pattern's outermost
    node, of a group the node among whose children it is matched. A captured name has the
    negative number -1 - ``enter`` of its function or class. ``limit`` keeps the first matches
    of a file and pattern only.
    """
    out = None
    for number, pattern in enumerate(patterns):
        part, predicates = read(pattern)
        matcher = _Matcher(table, predicates)
        if part.group:
            heads = matcher.reach(part)
            part.reached = heads
            rows = heads[-1].select("path", F.col("parent").alias("enter")).distinct().withColumn("root", F.col("enter"))
            rows = rows.select("path", "enter", "root", F.lit(None).cast("int").alias("start_byte"), F.lit(None).cast("int").alias("end_byte"), F.lit(None).cast("string").alias("text"))
        else:
            rows = matcher.candidates(part).withColumn("root", F.col("enter"))
        if limit is not None:
            order = Window.partitionBy("path").orderBy("root")
            rows = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")
        rows = stored(rows, "pattern-roots")
        for found in matcher.captures(part, rows):
            found = found.select(F.lit(number).alias("pattern"), "path", F.col("root").alias("match"), "capture", "enter", "start_byte", "end_byte", "text").distinct()
            out = found if out is None else out.unionByName(found)
    return table.sparkSession.createDataFrame([], CAPTURES) if out is None else out


def all_captured(table: DataFrame, patterns: list[str], limit: int | None = None) -> DataFrame:
    """(path, start_byte, end_byte) of all that the patterns capture; the whole pattern is a capture too."""
    found = captures(table, [f"{p} @the-capture" for p in patterns], limit)
    return found.where("start_byte IS NOT NULL").select("path", "start_byte", "end_byte").distinct()


def split(patterns: list[str]) -> tuple[list[int], list[int]]:
    """Numbers of the patterns that can be matched while a file is parsed, and of the others."""
    from .matching import plain

    known = [plain(read(p)[1]) for p in patterns]
    return [k for k, here in enumerate(known) if here], [k for k, here in enumerate(known) if not here]


def source_captures(files: DataFrame, patterns: list[str], limit: int | None = None, texts: bool = True) -> DataFrame:
    """``captures`` of Python sources (path, contents), each file matched in the task that parses it.

    Rows of one path's several files stay apart. Without ``texts`` that column is null.
    """
    from .matching import Nodes, Pattern

    here, there = split(patterns)
    parts, ready = [(k, read(patterns[k])) for k in here], {}

    def make(text):
        tree, out = Nodes(python_nodes("", text, None), text), []
        for k, found in parts:
            if k not in ready:
                ready[k] = Pattern(*found)
            for root, capture, x in ready[k].matches(tree, limit):
                out.append((k, root, capture, x[0], x[4], x[5], tree.text(x) if texts else None))
        return list(zip(*out, strict=True)) or [()] * 7

    columns = [c.split()[0] for c in CAPTURES.split(", ")]
    form = ", ".join(c for c in CAPTURES.split(", ") if not c.startswith("path "))
    found = per_text(files, make, form).select(columns) if here else None
    if there:
        kept = stored(files.select("path", "contents"), "pattern-files")
        table = stored(pattern_nodes(nodes(kept, "python", digests=False, columns=COLUMNS), kept), "pattern-nodes")
        number = F.array(*[F.lit(k) for k in there])[F.col("pattern")]
        rest = captures(table, [patterns[k] for k in there], limit).withColumn("pattern", number).select(columns)
        found = rest if found is None else found.unionByName(rest)
    return files.sparkSession.createDataFrame([], CAPTURES) if found is None else found


# ------------------------------------------------------------------ exclusion of subtrees


def exclude(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """``nodes`` whose bytes lie in no range of (path, start_byte, end_byte).

    One sweep a file: in the order of starts, outer ranges first, a node lies in a range if
    the highest end so far of ranges isn't below its own. No join compares ranges.
    """
    marks = ranges.select("path", F.col("start_byte").alias("_start"), F.col("end_byte").alias("_end"), F.lit(0).alias("_node"))
    names = nodes.columns
    own = nodes.select(F.struct(*names).alias("_row"), "path", F.col("start_byte").alias("_start"), F.col("end_byte").alias("_end"), F.lit(1).alias("_node"))
    every = own.unionByName(marks, allowMissingColumns=True)
    before = Window.partitionBy("path").orderBy("_start", "_node", F.desc("_end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("_node") == 0, F.col("_end"))).over(before)
    return every.withColumn("_reach", reach).where("_node = 1 AND coalesce(_reach < _end, true)").select("_row.*")
