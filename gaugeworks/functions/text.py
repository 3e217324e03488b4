"""Scalar functions over texts, digests, names and versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate_snippet(text: Column, lines: int = 50, size: int = 5120) -> Column:
    """Whole lines from the start: at most ``lines`` of them and ``size`` bytes with line ends between."""
    head = F.slice(F.split(text, "\n"), 1, lines)
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).cast("bigint").alias("used"), F.lit(False).alias("full"))

    def step(acc, line):
        used = acc["used"] + F.octet_length(line) + F.when(F.size(acc["kept"]) > 0, 1).otherwise(0)
        fits = ~acc["full"] & (used <= size)
        return F.struct(F.when(fits, F.concat(acc["kept"], F.array(line))).otherwise(acc["kept"]).alias("kept"), F.when(fits, used).otherwise(acc["used"]).cast("bigint").alias("used"), (~fits).alias("full"))

    return F.aggregate(head, start, step, lambda acc: F.array_join(acc["kept"], "\n"))


def content_digest(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def keyed_digest(pairs: Column) -> Column:
    """MD5 of a map's keys and values in key order."""
    entries = F.array_sort(F.map_entries(pairs))
    return F.md5(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], e["value"])), "").cast("binary"))


def node_digest(kind: Column, children: Column) -> Column:
    """Structural digest: MD5 of a kind's bytes followed by the children's digests."""
    return F.md5(F.aggregate(children, kind.cast("binary"), lambda acc, d: F.concat(acc, F.unhex(d))))


def level_from_name(name: Column) -> Column:
    """Only high, medium, low and fmt are levels; all else is unspecified."""
    return F.when(name == "high", 50).when(name == "medium", 40).when(name == "low", 30).when(name == "fmt", 20).otherwise(0).cast("bigint")


def timestamp_of(text: Column) -> Column:
    """Epoch seconds, else a timestamp; anything else is an error."""
    seconds = F.timestamp_seconds(text.try_cast("bigint"))
    return F.coalesce(seconds, F.try_to_timestamp(text), F.raise_error(F.concat(F.lit("not a time: "), text)).cast("timestamp"))


def words(name: Column) -> Column:
    """Lower-case words of a camelCase or separated name."""
    return F.transform(F.regexp_extract_all(name, F.lit("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), F.lit(0)), F.lower)


# Languages by file extension.
EXTENSIONS = {
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cs": "csharp", "go": "go", "java": "java", "js": "javascript", "jsx": "javascript", "kt": "kotlin",
    "php": "php", "py": "python", "rb": "ruby", "rs": "rust", "scala": "scala", "swift": "swift", "ts": "typescript", "tsx": "tsx", "vb": "vbnet",
}


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def version_parts(text: Column) -> Column:
    """Numbers of a version, for comparison as arrays."""
    return F.transform(F.split(F.regexp_extract(text, r"^[^0-9]*([0-9]+(\.[0-9]+)*)", 1), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def effort_minutes(base: int, delta: Column, per: int) -> Column:
    return (F.lit(base) + delta * per).cast("bigint")


def byte_offset(text: Column, line: Column, column: Column) -> Column:
    """Byte offset of a 1-based line and column (in code points)."""
    before = F.slice(F.split(text, "\n"), F.lit(1), F.greatest(line - 1, F.lit(0)).cast("int"))
    whole = F.aggregate(before, F.lit(0).cast("bigint"), lambda acc, x: acc + F.octet_length(x) + 1)
    own = F.get(F.split(text, "\n"), (line - 1).cast("int"))
    return whole + F.octet_length(F.substring(own, F.lit(1), (column - 1).cast("int")))
