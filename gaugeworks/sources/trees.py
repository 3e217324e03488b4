"""Syntax trees as node tables: Python by ``ast``, HTML by ``html.parser``.

One row a node with Euler-tour positions (``enter`` < ``leave``); an ancestor's interval
holds its descendants'. ``position`` numbers a node among its siblings, ``field`` is the
parent's name for it, bytes are offsets into the UTF-8 source (Python only), ``caller`` is the
name of the innermost function that holds the node, itself included. Parsing is the only
Python step; all metrics are DataFrame operators on the table. Sources that don't parse, and
null ones, give no rows; what is deeper than ``MAX_DEPTH`` levels is left out.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Sequence
from html.parser import HTMLParser
from itertools import repeat
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = (
    "path string, lang string, enter int, leave int, parent int, depth int, kind string, class string, name string, "
    "start_line int, end_line int, mass int, structural_hash string, source_hash string, note string, "
    "field string, position int, start_byte int, end_byte int, caller string"
)
#: Levels of a tree that are built; metrics look at fewer (``operators.trees.VISITED``).
MAX_DEPTH = 1024
#: Nodes after which a worker hands on its rows, so memory doesn't follow the number of files.
BATCH_ROWS = 1 << 15
#: Texts that a worker remembers with their rows, and the longest such text.
MEMO, MEMO_LENGTH = 512, 1 << 14

# Classes of Python node kinds.
PYTHON_CLASSES = {
    "If": "if", "IfExp": "ternary", "Match": "switch", "match_case": "case", "For": "loop", "AsyncFor": "loop", "While": "loop",
    "Else": "else", "Operator": "operator", "ExceptHandler": "except", "Break": "jump", "Continue": "jump", "Return": "return", "BoolOp": "binary",
    "Attribute": "field", "Call": "call", "FunctionDef": "function", "AsyncFunctionDef": "function", "Lambda": "closure", "ClassDef": "class",
}


class _Tree:
    """Rows of one file, built in pre-order; masses, digests (from the mass ``digests`` on; None: none) and missing byte ranges are filled in on leaving."""

    def __init__(self, path: str, lang: str, lines: list[str], digests: int | None):
        self.path, self.lang, self.digests, self.rows, self.at = path, lang, digests, [], 0
        self.lines = lines if digests is None else [x.strip() for x in lines]
        self.raw: list[bytes] = []  # structural digests, by row
        self.sources: dict[tuple[int, int], str] = {}  # digests of ranges of lines

    def add(self, kind, cls, name, first, last, parent, depth, note=None, field=None, position=0, span=(None, None), caller=None):
        self.rows.append([self.path, self.lang, self.at, -1, parent, depth, kind, cls, name, first, last, 1, None, None, note, field, position, *span, caller])
        self.at += 1
        return len(self.rows) - 1

    def close(self, i, children):
        row = self.rows[i]
        row[LEAVE], self.at = self.at, self.at + 1
        for c in children:
            row[MASS] += self.rows[c][MASS]
        if self.digests is not None:
            raw = self.raw
            if len(raw) < len(self.rows):
                raw += [b""] * (len(self.rows) - len(raw))
            raw[i] = hashlib.md5(row[KIND].encode() + b"".join([raw[c] for c in children])).digest()
            if row[MASS] >= self.digests:
                place = row[FIRST], row[LAST]
                if place not in self.sources:
                    self.sources[place] = hashlib.md5("\n".join(self.lines[place[0] - 1 : place[1]]).encode()).hexdigest()
                row[STRUCTURE], row[SOURCE] = raw[i].hex(), self.sources[place]


NAMES = [c.split()[0] for c in NODES.split(", ")]
LEAVE, KIND, FIRST, LAST, MASS, STRUCTURE, SOURCE, START, END = (NAMES.index(c) for c in ("leave", "kind", "start_line", "end_line", "mass", "structural_hash", "source_hash", "start_byte", "end_byte"))


class Else(ast.stmt):
    """The else clause of an if, loop or try, which ``ast`` has no node for."""

    _fields = ("body",)


class Operator(ast.AST):
    """``and`` or ``or`` between its two operands; as it isn't a named node, it has no mass."""

    _fields = ()


def _made(cls, **values):
    node = cls()
    for k, v in values.items():
        setattr(node, k, v)
    return node


def _is_elif(node: ast.AST, above: ast.AST | None) -> bool:
    """An elif begins in the column of its if; an if inside an else is indented further."""
    return isinstance(node, ast.If) and isinstance(above, ast.If) and above.orelse == [node] and node.col_offset == above.col_offset


def _parts(node: ast.AST) -> list[tuple[str, ast.AST]]:
    """(field, child) in the order of the source, else clauses as nodes, operators of one kind nested to the left."""
    cls = node.__class__
    if cls is ast.BoolOp:
        left, right = node.values[:-1], node.values[-1]
        first = left[0] if len(left) == 1 else _made(ast.BoolOp, op=node.op, values=left, lineno=left[0].lineno, end_lineno=left[-1].end_lineno, col_offset=left[0].col_offset, end_col_offset=left[-1].end_col_offset)
        return [("left", first), ("operator", _made(Operator, name=type(node.op).__name__.lower(), lineno=right.lineno, end_lineno=right.lineno)), ("right", right)]
    out = []
    for field in SHAPES[cls][3]:
        value = getattr(node, field, None)
        if value.__class__ is not list:
            if SHAPES[value.__class__][2]:
                out.append((field, value))
        elif field == "orelse" and value and not _is_elif(value[0], node):
            out.append((field, _made(Else, body=value, lineno=value[0].lineno, end_lineno=value[-1].end_lineno)))
        else:
            out += [(field, x) for x in value if SHAPES[x.__class__][2]]
    return out


#: Parts of expressions that make no node.
UNNAMED = (ast.expr_context, ast.operator, ast.boolop, ast.cmpop, ast.unaryop)


class _Shape(NamedTuple):
    """What holds for all nodes of a class, looked up once a worker."""

    kind: str
    cls: str | None
    is_node: bool
    fields: tuple[str, ...]
    placed: bool
    names: tuple[str, ...]


class _Shapes(dict):
    def __missing__(self, cls: type) -> _Shape:
        if issubclass(cls, ast.AST):
            names = ("name",) if cls is Operator else tuple(c for c in ("name", "attr", "id", "arg") if c in cls._fields)
            fields = () if cls in CHILDLESS else cls._fields
            made = _Shape(cls.__name__, PYTHON_CLASSES.get(cls.__name__), not issubclass(cls, UNNAMED), fields, cls is not Else and "col_offset" in cls._attributes, names)
        else:
            made = _Shape("", None, False, (), False, ())
        self[cls] = made
        return made


#: Kinds whose parts are never nodes.
CHILDLESS = (ast.Name, ast.Constant, ast.Pass, ast.Break, ast.Continue, ast.alias)
SHAPES = _Shapes()


def _note(node: ast.AST, cls: str | None, names: tuple[str, ...]) -> tuple[str | None, str | None]:
    """(name, note): the name a call calls, and 'self' if on self or nothing; 'decorator' for a function that only makes and returns one."""
    if cls == "call":
        f = node.func
        if f.__class__ is ast.Attribute:
            return f.attr, "self" if f.value.__class__ is ast.Name and f.value.id == "self" else None
        return (f.id, "self") if f.__class__ is ast.Name else (None, None)
    if cls == "function":
        body = node.body
        made = len(body) == 2 and isinstance(body[0], (ast.FunctionDef, ast.AsyncFunctionDef)) and not body[0].decorator_list and isinstance(body[1], ast.Return)
        return node.name, "decorator" if made else None
    for c in names:
        if name := getattr(node, c, None):
            return (name if name.__class__ is str else None), None
    return None, None


def _line_starts(text: str) -> list[int]:
    """Byte offset of each line, as the parser counts lines."""
    return [0, *(m.end() for m in re.finditer(rb"\r\n|\r|\n", text.encode("utf-8", "surrogatepass")))]


def python_nodes(path: str, text: str, digests: int | None = 0) -> list[list]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out, starts = _Tree(path, "python", text.split("\n"), digests), _line_starts(text)
    rows = out.rows

    def enter(node, field, above):
        """A frame of the walk: row, node, parts to come (the last one first), rows of children that have mass, depth, caller, children so far."""
        kind, cls, _, fields, placed, names = SHAPES[node.__class__]
        name, note = _note(node, cls, names) if names or cls == "call" else (None, None)
        if above is None:
            parent, depth, caller, place = None, 0, None, 0
        else:
            inside, depth, caller, place = above[1], above[4] + 1, above[5], above[6]
            parent, above[6] = rows[above[0]][2], place + 1
            if inside.__class__ is ast.Call and inside.func is node:
                note = "called"
            if cls == "if" and _is_elif(node, inside):
                cls = "elsif"
        if cls == "function":
            caller = name
        if placed:
            first, last = node.lineno, node.end_lineno
            start, end = starts[first - 1] + node.col_offset, starts[last - 1] + node.end_col_offset
        else:
            first, last, start, end = getattr(node, "lineno", 1), getattr(node, "end_lineno", 1), None, None
        rows.append([path, "python", out.at, -1, parent, depth, kind, cls, name, first, last, 1, None, None, note, field, place, start, end, caller])
        out.at += 1
        return [len(rows) - 1, node, _parts(node)[::-1] if depth < MAX_DEPTH and fields else [], [], depth, caller, 0]

    stack = [enter(tree, None, None)]
    rows[0][START], rows[0][END] = 0, len(text.encode("utf-8", "surrogatepass"))
    while stack:
        top = stack[-1]
        if top[2]:
            field, child = top[2].pop()
            stack.append(enter(child, field, top))
            continue
        stack.pop()
        i, node, _, children, *_ = top
        out.close(i, children)
        row = rows[i]
        if row[START] is None:  # what has no place of its own spans its children
            here = rows[stack[-1][0]][START] or 0  # or, without children, stands where its parent begins
            row[START], row[END] = (min(rows[c][START] for c in children), max(rows[c][END] for c in children)) if children else (here, here)
        if node.__class__ is Operator:
            row[MASS] = 0
        elif stack:
            stack[-1][3].append(i)
    return rows


class _Html(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
    # Elements that the start tag of an element ends, where their own end tags may be left out.
    BLOCKS = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
    ENDS = {
        **dict.fromkeys(BLOCKS, ("p",)), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"),
        "tr": ("tr", "td", "th", "p"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody"), "option": ("option",), "optgroup": ("option", "optgroup"),
    }

    def __init__(self, path: str, text: str, digests: int | None = 0):
        super().__init__(convert_charrefs=True)
        lines = text.split("\n")
        self.out = _Tree(path, "html", lines, digests)
        self.stack = [(self.out.add("document", None, None, 1, len(lines), None, 0), [])]
        self.beyond: list[str] = []  # open tags below the last level that is built
        self.feed(text)
        while self.stack:
            self._pop(len(lines))

    def _pop(self, line):
        i, children = self.stack.pop()
        self.out.rows[i][LAST] = line
        self.out.close(i, children)
        if self.stack:
            self.stack[-1][1].append(i)

    def _kind(self):
        return self.out.rows[self.stack[-1][0]][KIND]

    def handle_starttag(self, tag, attrs):
        line = self.getpos()[0]
        if not self.beyond:
            while len(self.stack) > 1 and self._kind() in self.ENDS.get(tag, ()):
                self._pop(line)
        if self.beyond or len(self.stack) >= MAX_DEPTH:
            if tag not in self.VOID:
                self.beyond.append(tag)
            return
        above, beside = self.stack[-1]
        self.stack.append((self.out.add(tag, None, None, line, line, self.out.rows[above][2], len(self.stack), position=len(beside)), []))
        if tag in self.VOID:
            self._pop(line)

    def handle_endtag(self, tag):
        line = self.getpos()[0]
        if tag in self.beyond:
            while self.beyond.pop() != tag:
                pass
        elif any(self.out.rows[i][KIND] == tag for i, _ in self.stack[1:]):
            self.beyond.clear()
            while self._kind() != tag:
                self._pop(line)
            self._pop(line)


def html_nodes(path: str, text: str, digests: int | None = 0) -> list[list]:
    return _Html(path, text, digests).out.rows


PARSERS = {"python": python_nodes, "html": html_nodes}


def per_text(files: DataFrame, make: Callable[..., list[Sequence]], form: str, carried: Sequence[str] = ("path",), given: Sequence[str] = ()) -> DataFrame:
    """Rows that ``make`` gives of each text: a sequence for each column of ``form``, all of one length, behind the file's ``carried`` columns.

    ``make`` gets the text and the ``given`` columns. Short texts are worked on once each as long as
    a worker remembers them (``MEMO``); null texts give no rows.
    """
    own = [c.split() for c in form.split(", ")] if form else []

    def run(batches):
        import pyarrow as pa

        types = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
        known: dict[tuple, list] = {}
        made_of = pa.schema([(c, pa.string()) for c in carried] + [(c, types[t]) for c, t in own])

        def table(parts):
            return pa.RecordBatch.from_arrays([pa.array(p, f.type) for p, f in zip(parts, made_of, strict=True)], schema=made_of)

        parts, count = [[] for _ in made_of], 0
        for batch in batches:
            *values, texts = (c.to_pylist() for c in batch.columns)
            file_values, more = values[: len(carried)], values[len(carried) :]
            for text, file, extra in zip(texts, zip(*file_values, strict=True), zip(*more, strict=True) if more else repeat(())):
                if text is None:
                    continue
                made = known.get((text, *extra))
                if made is None:
                    made = make(text, *extra)
                    if len(text) <= MEMO_LENGTH:
                        if len(known) >= MEMO:
                            known.clear()
                        known[(text, *extra)] = made
                if not (size := len(made[0])):
                    continue
                for part, value in zip(parts, file):
                    part.extend([value] * size)
                for part, new in zip(parts[len(file) :], made, strict=True):
                    part.extend(new)
                count += size
                if count >= BATCH_ROWS:
                    yield table(parts)
                    parts, count = [[] for _ in made_of], 0
        if count:
            yield table(parts)

    return files.select(*[F.col(c).cast("string") for c in (*carried, *given)], "contents").mapInArrow(run, ", ".join([f"{c} string" for c in carried] + [" ".join(c) for c in own]))


def nodes(files: DataFrame, lang: str, digests: bool = True, columns: Sequence[str] = NAMES, least_mass: int = 0) -> DataFrame:
    """Node table of (path, contents), or the ``columns`` of it that are asked for, of nodes of ``least_mass`` on.

    Without ``digests`` (which duplication needs) parsing is faster, and so it is with a least
    mass, as smaller nodes get no digest of their source and no row.
    """
    parser, chosen = PARSERS[lang], [c for c in NAMES if c in columns and c != "path"] or ["enter"]
    types = dict(c.split() for c in NODES.split(", "))
    places = [NAMES.index(c) for c in chosen]

    def make(text):
        rows = list(zip(*(r for r in parser("", text, least_mass if digests else None) if r[MASS] >= least_mass), strict=True))
        return [rows[i] for i in places] if rows else [()] * len(places)

    return per_text(files, make, ", ".join(f"{c} {types[c]}" for c in chosen)).select(*[c for c in NAMES if c in columns])
