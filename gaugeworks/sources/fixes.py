"""Fixes that linters report, as suggestions with replacements that ``operators.patches`` builds patches from.

Input as in ``linters``: (file, output). Result, a row for each suggestion: file, path,
rule_key, nth (of the output's suggestions), id, description, replacements.

Offsets: Ruff and ShellCheck give lines and columns; ESLint gives characters, which are
counted in bytes of the source that its output carries, where it does and the source has such
characters (suggestions are taken as they are); Biome gives a delta, a dictionary and
operations on it, whose places in the source are found by adding up what they pass over.

Defined cases: a fix without replacements is no suggestion; a malformed document is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.offsets import bytes_before, place_in
from ..operators.patches import RANGE, REPLACEMENT
from .linters import ladder

RUFF = "array<struct<code:string,filename:string,fix:struct<edits:array<struct<content:string,location:struct<row:bigint,column:bigint>,end_location:struct<row:bigint,column:bigint>>>>>>"
SHELLCHECK = "array<struct<file:string,code:bigint,fix:struct<replacements:array<struct<line:bigint,column:bigint,endLine:bigint,endColumn:bigint,replacement:string>>>>>"
ESLINT_FIX = "struct<range:array<bigint>,text:string>"
ESLINT = f"array<struct<filePath:string,source:string,messages:array<struct<ruleId:string,line:bigint,column:bigint,endLine:bigint,endColumn:bigint,fix:{ESLINT_FIX},suggestions:array<struct<messageId:string,`desc`:string,fix:{ESLINT_FIX}>>>>>>"
OPERATION = "struct<diffOp:struct<equal:struct<range:array<bigint>>,`insert`:struct<range:array<bigint>>,`delete`:struct<range:array<bigint>>>,equalLines:struct<line_count:bigint>>"
BIOME = f"struct<diagnostics:array<struct<category:string,severity:string,description:string,location:struct<path:struct<file:string>,span:array<bigint>,sourceCode:string>,advices:struct<advices:array<struct<diff:struct<dictionary:string,ops:array<{OPERATION}>>>>>>>>"
STRICT = {"mode": "FAILFAST"}


def _range(**parts) -> Column:
    """A replacement struct; parts that aren't given are null."""
    kinds = {c: "string" if c == "data" else "bigint" for c in RANGE}
    return F.struct(*[parts.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in RANGE])


def _suggestions(rows: DataFrame) -> DataFrame:
    """Rows (file, at, path, rule_key, id, description, replacements) that have replacements, numbered in each output."""
    named = rows.where(F.size("replacements") > 0).select("file", "at", "path", "rule_key", "id", "description", F.col("replacements").cast(f"array<{REPLACEMENT}>").alias("replacements"))
    return named.select("file", F.col("at").alias("nth"), *named.columns[2:])


def ruff(outputs: DataFrame) -> DataFrame:
    rows = outputs.select("file", F.posexplode(F.from_json("output", RUFF, STRICT)).alias("at", "r"))
    edits = F.transform("r.fix.edits", lambda e: _range(start_line=e["location"]["row"], start_column=e["location"]["column"], end_line=e["end_location"]["row"], end_column=e["end_location"]["column"], data=e["content"]))
    none = F.lit(None).cast("string")
    return _suggestions(rows.select("file", "at", F.col("r.filename").alias("path"), F.coalesce("r.code", F.lit("error")).alias("rule_key"), none.alias("id"), none.alias("description"), F.coalesce(edits, F.array().cast(f"array<{REPLACEMENT}>")).alias("replacements")))


def shellcheck(outputs: DataFrame) -> DataFrame:
    rows = outputs.select("file", F.posexplode(F.from_json("output", SHELLCHECK, STRICT)).alias("at", "r"))
    edits = F.transform("r.fix.replacements", lambda e: _range(start_line=e["line"], start_column=e["column"], end_line=e["endLine"], end_column=e["endColumn"], data=e["replacement"]))
    none = F.lit(None).cast("string")
    return _suggestions(rows.select("file", "at", F.col("r.file").alias("path"), F.col("r.code").cast("string").alias("rule_key"), none.alias("id"), none.alias("description"), F.coalesce(edits, F.array().cast(f"array<{REPLACEMENT}>")).alias("replacements")))


def eslint(outputs: DataFrame) -> DataFrame:
    """A message's fix, or else its suggestions, each by itself."""
    files = outputs.select("file", F.posexplode(F.from_json("output", ESLINT, STRICT)).alias("f_at", "f"))
    rows = files.select("file", "f_at", "f.filePath", "f.source", F.posexplode("f.messages").alias("m_at", "m"))
    line, column = F.coalesce("m.line", F.lit(1)), F.coalesce("m.column", F.lit(1))
    place = {"start_line": line, "start_column": column, "end_line": F.coalesce("m.endLine", line), "end_column": F.coalesce("m.endColumn", column)}
    start = bytes_before(F.col("source"), F.col("m.fix.range")[0])
    end = F.when(start.isNotNull(), bytes_before(F.col("source"), F.col("m.fix.range")[1]))
    fix = _range(start_byte=F.coalesce(start, F.col("m.fix.range")[0]), end_byte=F.coalesce(end, F.col("m.fix.range")[1]), data=F.col("m.fix.text"), **place)
    kind = f"array<struct<id:string,description:string,replacement:{REPLACEMENT}>>"
    own = F.array(F.struct(F.lit("fix").alias("id"), F.lit("fix").alias("description"), fix.alias("replacement"))).cast(kind)
    others = F.transform("m.suggestions", lambda s: F.struct(s["messageId"].alias("id"), s["desc"].alias("description"), _range(start_byte=s["fix"]["range"][0], end_byte=s["fix"]["range"][1], data=s["fix"]["text"], **place).alias("replacement"))).cast(kind)
    each = rows.select("file", "f_at", "m_at", F.col("filePath").alias("path"), F.coalesce("m.ruleId", F.lit("")).alias("rule_key"), F.posexplode(F.when(F.col("m.fix").isNotNull(), own).otherwise(others)).alias("s_at", "s"))
    # suggestions of messages of files of an output, by one number
    at = F.col("f_at").cast("bigint") * (1 << 40) + F.col("m_at").cast("bigint") * (1 << 16) + F.col("s_at")
    return _suggestions(each.select("file", at.alias("at"), "path", "rule_key", "s.id", "s.description", F.array("s.replacement").alias("replacements")))


# ------------------------------------------------------------------ Biome


def _diagnostics(outputs: DataFrame) -> DataFrame:
    return outputs.select("file", F.posexplode(F.from_json("output", BIOME, STRICT)["diagnostics"]).alias("at", "r"))


def biome(outputs: DataFrame) -> DataFrame:
    """Issues: as in ``linters``; a span of bytes becomes lines and columns of the source that the output carries."""
    rows = _diagnostics(outputs)
    source, span = F.col("r.location.sourceCode"), F.col("r.location.span")
    first, last = (place_in(source, F.get(span, F.lit(k))) for k in (0, 1))
    level = F.expr(ladder("r.severity", 40, error=50, warning=40)).cast("bigint")
    spanned = F.coalesce(F.size(span) > 1, F.lit(False))
    place = [F.when(source.isNotNull(), F.when(spanned, p[c]).otherwise(0)).cast("bigint").alias(n) for p, c, n in ((first, "line", "start_line"), (first, "column", "start_column"), (last, "line", "end_line"), (last, "column", "end_column"))]
    return rows.select("file", F.col("r.location.path.file").alias("path"), F.col("r.category").alias("rule_key"), F.col("r.description").alias("message"), level.alias("level"), F.lit("CATEGORY_LINT").alias("category"), *place)


def delta_replacements(source: Column, dictionary: Column, ops: Column) -> Column:
    """Replacements of a delta: equal, deleted and skipped lines pass over the source, insertions don't.

    Ranges are bytes of the dictionary; their lengths, not their places, count in the source.
    A run of n equal lines goes on over n + 1 line feeds.
    """
    text = source.cast("binary")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{REPLACEMENT}>").alias("out"))

    def size(part):
        return F.coalesce(part["range"][1] - part["range"][0], F.lit(0))

    def lines_on(at, count):
        rest = F.substring(text, at.cast("int") + 1, F.octet_length(text)).cast("string")
        return F.least(at + F.octet_length(F.call_function("substring_index", rest, F.lit("\n"), count + 1)) + 1, F.octet_length(text).cast("bigint"))

    def step(state, op):
        at, one = state["at"], op["diffOp"]
        gone, new = size(one["delete"]), size(one["insert"])
        word = F.substring(dictionary.cast("binary"), one["insert"]["range"][0].cast("int") + 1, new.cast("int")).cast("string")
        head, tail = place_in(source, at), place_in(source, at + gone)
        made = _range(start_byte=at, end_byte=at + gone, start_line=head["line"], start_column=head["column"], end_line=tail["line"], end_column=tail["column"], data=F.when(new > 0, word).otherwise(""))
        further = F.when(op["equalLines"].isNotNull(), lines_on(at, op["equalLines"]["line_count"].cast("int"))).otherwise(at + size(one["equal"]) + gone)
        changed = op["equalLines"].isNull() & ((gone > 0) | (new > 0))
        out = F.when(changed, F.concat(state["out"], F.array(made).cast(f"array<{REPLACEMENT}>"))).otherwise(state["out"])
        return F.struct(further.cast("bigint").alias("at"), out.alias("out"))

    return F.aggregate(ops, start, step, lambda s: s["out"])


def biome_fixes(outputs: DataFrame) -> DataFrame:
    """A suggestion for each advice with a delta that changes something."""
    rows = _diagnostics(outputs).where("r.location.sourceCode IS NOT NULL")
    each = rows.select("file", "at", "r", F.posexplode("r.advices.advices").alias("a_at", "a")).where("a.diff IS NOT NULL")
    made = delta_replacements(F.col("r.location.sourceCode"), F.col("a.diff.dictionary"), F.col("a.diff.ops"))
    none = F.lit(None).cast("string")
    at = F.col("at").cast("bigint") * (1 << 20) + F.col("a_at")
    return _suggestions(each.select("file", at.alias("at"), F.col("r.location.path.file").alias("path"), F.col("r.category").alias("rule_key"), none.alias("id"), none.alias("description"), made.alias("replacements")))


TOOLS = {"ruff": ruff, "eslint": eslint, "shellcheck": shellcheck, "biome": biome_fixes}
