"""Fill-in-middle transformation by a sparse Aho-Corasick event scan.

A text is a sequence of n units. Two numbers derived from the row's id cut it into prefix,
middle and suffix, which are written in one of two orders between sentinels (``psm`` or
``spm``), or the text stays as it is (``plain``).

One automaton holds the sentinels and the ASCII characters at which units of a kind change
class. Its matches, the events, come in one pass from left to right; what lies in the gap
between two events is all of one class, so its units are counted by arithmetic:

* ``chars``: each code point is a unit. No character changes class, so only sentinels make
  events and a gap has as many units as code points.
* ``words``: a unit is a word with the white space after it (white space before the first
  word is a unit of its own). The six ASCII white-space characters change the class; a gap
  holds one word.
* ``lines``: a unit is a line with its line feed, which changes the class.

Events with their running number of units are two short arrays; the offset of the k-th unit
is looked up in them by bisection and completed by arithmetic within the gap. A text that
holds a sentinel is plain. ``restore`` finds the sentinels of an
output by the same automaton, so it needs neither the cuts nor the row's id.

Defined cases: null text is empty text; an empty text is plain; a null id is hashed as
empty text; repeated rows get equal rows; very long texts are handled one at a time, with
memory for their events only; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, id_type, text_buffers

#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Characters at which units of a kind change class.
CHANGES = {"chars": "", "words": " \t\n\x0b\x0c\r", "lines": "\n"}
#: What the automaton says at such a character; sentinels have numbers from 0.
CHANGE = -1


def _apart(sentinels: tuple[str, ...]) -> None:
    """Sentinels must be told apart wherever they stand: none may hold or end as another begins."""
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            if not a or (i != j and b in a) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError(f"sentinels {a!r} and {b!r} can overlap")


class Events(NamedTuple):
    """From ``offsets[i]`` on, units are numbered from ``ranks[i]``; ``n`` units in all."""

    offsets: list[int]
    ranks: list[int]
    n: int
    marked: bool  # whether the text holds a sentinel


class Scanner:
    """The events of texts for one kind of unit."""

    def __init__(self, unit: str = "chars", sentinels: tuple[str, ...] = SENTINELS):
        _apart(sentinels)
        self.unit, self.sentinels = unit, sentinels
        self.automaton = ahocorasick.Automaton()
        for k, mark in enumerate(sentinels):
            self.automaton.add_word(mark, k)
        for c in CHANGES[unit]:
            self.automaton.add_word(c, CHANGE)
        self.automaton.make_automaton()

    def marks(self, text: str) -> list[tuple[int, int]]:
        """(offset, number) of each sentinel."""
        return [(end + 1 - len(self.sentinels[k]), k) for end, k in self.automaton.iter(text) if k != CHANGE]

    def events(self, text: str) -> Events:
        if self.unit == "chars":  # one gap, from the first code point to the last
            return Events([0], [0], len(text), next(self.automaton.iter(text), None) is not None)
        offsets, at, marked = [], 0, False
        for end, k in self.automaton.iter(text):
            if k != CHANGE:
                marked = True
                continue
            if self.unit == "lines" or end > at or end == 0:
                offsets.append(at)
            at = end + 1
        if at < len(text):
            offsets.append(at)
        return Events(offsets, list(range(len(offsets))), len(offsets), marked)

    def offset(self, events: Events, k: int, length: int) -> int:
        """Where unit ``k`` begins; ``length``, that of the text, for k = n."""
        if k >= events.n:
            return length
        i = bisect_right(events.ranks, k) - 1
        return events.offsets[i] + k - events.ranks[i]


def _numbers(id_col):
    """The first four groups of eight digits of sha256 of ``1:`` and the id, as long columns."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def arrange(scanner: Scanner, text: str, h: tuple[int, ...], plain_from: int, spm_below: int) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix units, middle units, output) of one text."""
    events = scanner.events(text)
    n = events.n
    if not text or events.marked or h[2] % 100 >= plain_from:
        return n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = scanner.offset(events, lo, len(text)), scanner.offset(events, hi, len(text))
    p, s, m = scanner.sentinels
    if h[3] % 100 < spm_below:
        return n, "spm", lo, hi - lo, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", lo, hi - lo, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def rebuild(scanner: Scanner, output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    found = scanner.marks(output)
    order = {"psm": (0, 1, 2), "spm": (1, 0, 2)}[form]
    if tuple(k for _, k in found) != order or found[0][0] != 0:
        raise ValueError("an output that this transformation didn't make")
    ends = [at for at, _ in found[1:]] + [len(output)]
    part = {k: output[at + len(scanner.sentinels[k]) : end] for (at, k), end in zip(found, ends, strict=True)}
    return part[0] + part[2] + part[1]


def transform(df: DataFrame, id_col: str, text_col: str, unit: str = "chars", plain_from: int = 90, spm_below: int = 20, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """(id, n, form, prefix_units, middle_units, output), one row for each input row."""
    Scanner(unit, sentinels)  # bad arguments fail here, not in a task
    kinds = {"n": pa.int64(), "form": pa.string(), "prefix_units": pa.int64(), "middle_units": pa.int64(), "output": pa.string()}

    def run(batches):
        scanner = Scanner(unit, sentinels)
        for batch in batches:
            offsets, _ = text_buffers(batch.column(1))
            for lo, hi in blocks(offsets):
                part = batch.slice(lo, hi - lo)
                rows = [arrange(scanner, text, h, plain_from, spm_below) for text, *h in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)]
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", *kinds])

    id_ = F.col(f"`{id_col}`")
    rows = df.select(id_.alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *_numbers(id_))
    return rows.mapInArrow(run, f"id {id_type(df, id_col)}, n long, form string, prefix_units long, middle_units long, output string")


def restore(rows: DataFrame, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """``rows`` of ``transform`` with ``restored``, the text rebuilt from ``output`` and ``form`` alone."""
    names = rows.columns

    def run(batches):
        scanner = Scanner("chars", sentinels)
        for batch in batches:
            output, form = names.index("output"), names.index("form")
            offsets, _ = text_buffers(batch.column(output))
            for lo, hi in blocks(offsets):
                part = batch.slice(lo, hi - lo)
                texts = [rebuild(scanner, o, f) for o, f in zip(part.column(output).to_pylist(), part.column(form).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, "restored"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, restored string")
