"""Coverage report formats as DataFrame expressions.

Input: (file, content) with a whole report in a row; result: (file, path, hits), and where
a format can name a path twice, one row for each record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def infer(name: Column, content: Column) -> Column:
    """Format by extension, then by names and contents of XML reports."""
    low = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    xml = F.when(name.contains("jacoco"), "jacoco").when(name.contains("clover"), "clover").when(name.contains("dotcover") | content.contains("DotCoverVersion"), "dotcover").otherwise("cobertura")
    return F.when(low.isin("info", "lcov"), "lcov").when(low == "json", "simplecov").when(low == "jsonl", "native").when(low == "out", "coverprofile").when(low == "xml", xml)


def dense(pairs: Column, size: Column) -> Column:
    """Array of at least ``size`` values from sorted distinct (line, value) pairs; gaps are -1.

    Each pair brings the gap before it, so the work is linear in the size.
    """
    gap = lambda n: F.array_repeat(F.lit(-1).cast("bigint"), F.greatest(n, F.lit(0)).cast("int"))
    before = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(pairs, lambda p: p["line"]))
    filled = F.flatten(F.zip_with(pairs, F.slice(before, F.lit(1), F.size(pairs)), lambda p, b: F.concat(gap(p["line"] - b - 1), F.array(p["value"]))))
    return F.concat(filled, gap(size - F.element_at(before, -1)))


def _gather(lines: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, hits) from one row a (keys, line): ``value`` aggregates a line's rows."""
    one = lines.groupBy(*keys, "line").agg(value.alias("value"))
    rows = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("line") > 0, F.struct("line", "value")))).alias("rows"), F.max("line").alias("size"))
    return rows.withColumn("hits", dense(F.col("rows"), F.coalesce("size", F.lit(0).cast("bigint")))).drop("rows", "size")


def _fold_lines(rows: DataFrame, value) -> DataFrame:
    """``hits`` from ``pairs``, an array of (line, k, n) a row; ``value`` folds those of one line, in the order of k.

    A record stays in its row: nothing is shuffled, and a task holds one record at a time.
    """
    rows = rows.withColumn("pairs", F.array_sort(F.filter("pairs", lambda p: p["line"] > 0)))
    rows = rows.withColumn("starts", F.array_compact(F.transform("pairs", lambda p, i: F.when((i == 0) | (F.get("pairs", i - 1)["line"] != p["line"]), i + 1))))
    own = lambda s, i: F.slice("pairs", s, F.coalesce(F.get("starts", i + 1), F.size("pairs") + 1) - s)
    rows = rows.withColumn("rows", F.transform("starts", lambda s, i: F.struct(F.get("pairs", s - 1)["line"].alias("line"), value(own(s, i)).alias("value"))))
    return rows.withColumn("hits", dense(F.col("rows"), F.lit(0).cast("bigint"))).drop("pairs", "starts", "rows")


def lcov(reports: DataFrame) -> DataFrame:
    """Records SF .. end_of_record; counts of a line are added; a bad number is an error."""
    records = reports.select("file", F.posexplode(F.split("content", "(^|\n)end_of_record")).alias("record", "body")).where(F.col("body").rlike("(^|\n)SF:"))
    records = records.select("file", "record", F.regexp_extract("body", "(?m)^SF:(.*)$", 1).alias("path"), F.regexp_extract_all("body", F.lit("(?m)^DA:(.*)$"), F.lit(1)).alias("rows"))

    def pair(row: Column, k: Column) -> Column:
        parts = F.split(row, ",")
        n = F.trim(F.get(parts, F.lit(1))).cast("bigint")
        return F.struct(F.coalesce(F.trim(parts[0]).cast("bigint"), F.lit(0)).alias("line"), k.alias("k"), F.when(n < 0, F.raise_error(F.lit("negative hits"))).otherwise(n).alias("n"))

    def total(own: Column) -> Column:
        return F.aggregate(own, F.lit(None).cast("bigint"), lambda sum_, p: F.coalesce(sum_ + p["n"], sum_, p["n"]))

    return _fold_lines(records.select("file", "path", F.transform("rows", pair).alias("pairs")), total).select("file", "path", "hits")


def native_jsonl(lines: DataFrame) -> DataFrame:
    """(path, hits) of rows ``value``; a malformed line is an error; missing hits are none."""
    parsed = lines.select(F.from_json("value", "path string, hits array<string>", {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.path", F.transform(F.coalesce("r.hits", F.array().cast("array<string>")), lambda x: x.cast("bigint")).alias("hits"))


def _ruby_hits(v: Column) -> Column:
    """null is -1, "ignored" is -2, anything that is no integer -1."""
    text = F.transform(v, lambda x: x.cast("string"))
    return F.transform(text, lambda x: F.when(x == "ignored", F.lit(-2)).otherwise(F.coalesce(x.try_cast("bigint"), F.lit(-1))).cast("bigint"))


def simplecov(reports: DataFrame) -> DataFrame:
    """Three shapes in turn: versioned .coverage, groups with .coverage, .files[]; else nothing."""
    new = F.from_json("content", "meta struct<simplecov_version:string>, coverage map<string,string>, files array<struct<filename:string,coverage:string>>")
    old = F.from_json("content", "map<string,string>")
    rows = reports.select("file", new.alias("n"), old.alias("o"))
    version = F.transform(F.split(F.regexp_extract("n.meta.simplecov_version", r"^\d+(\.\d+)*", 0), r"\."), lambda x: x.try_cast("int"))
    modern = F.coalesce(F.col("n.coverage").isNotNull() & (version >= F.array(F.lit(0), F.lit(18), F.lit(0))), F.lit(False))
    groups = F.transform(F.filter(F.map_values("o"), lambda v: F.get_json_object(v, "$.coverage").isNotNull()), lambda v: F.map_entries(F.from_json(F.get_json_object(v, "$.coverage"), "map<string,string>")))
    entries = F.when(modern, F.map_entries("n.coverage")).when(F.size(groups) > 0, F.flatten(groups)).otherwise(F.transform(F.coalesce("n.files", F.array().cast("array<struct<filename:string,coverage:string>>")), lambda f: F.struct(f["filename"].alias("key"), f["coverage"].alias("value"))))
    flat = rows.select("file", F.explode(entries).alias("e")).select("file", F.col("e.key").alias("path"), F.trim("e.value").alias("v"))
    array = F.when(F.col("v").startswith("{"), F.get_json_object("v", "$.lines")).otherwise(F.col("v"))
    values = _ruby_hits(F.from_json(array, "array<string>"))
    return flat.select("file", "path", F.coalesce(values, F.array().cast("array<bigint>")).alias("hits"))


def xccov(reports: DataFrame) -> DataFrame:
    """Map of path to lines; executable lines have a count or 0, others -1; the last entry of a line counts."""
    rows = reports.select("file", F.explode(F.from_json("content", "map<string,array<struct<line:bigint,isExecutable:boolean,executionCount:bigint>>>")).alias("path", "rows"))
    lines = rows.select("file", "path", F.posexplode_outer("rows").alias("k", "r"))
    value = F.when(F.col("r.isExecutable"), F.coalesce("r.executionCount", F.lit(0))).otherwise(F.lit(-1))
    lines = lines.select("file", "path", "k", F.coalesce("r.line", F.lit(0)).alias("line"), value.alias("n"))
    return _gather(lines, ["file", "path"], F.max_by("n", "k"))


def coverprofile(reports: DataFrame) -> DataFrame:
    """Go profiles: each consecutive run of a file is a record; the first count that isn't 0 stands."""
    block = r"^(\d+)\.?\d+,(\d+)\.?\d+ ?\d+ (\d+)"
    place = lambda row: F.split_part(row, F.lit(":"), F.lit(2))
    path = lambda row: F.split_part(row, F.lit(":"), F.lit(1))
    text = F.split("content", "\n")
    rows = reports.select("file", F.filter(text, lambda row, k: (k > 0) & (row != "") & place(row).rlike(block)).alias("rows"))
    rows = rows.withColumn("starts", F.array_compact(F.transform("rows", lambda row, i: F.when((i == 0) | (path(F.get("rows", i - 1)) != path(row)), i + 1))))
    runs = F.transform("starts", lambda s, i: F.slice("rows", s, F.coalesce(F.get("starts", i + 1), F.size("rows") + 1) - s))
    runs = rows.select("file", F.explode(runs).alias("rows")).withColumn("path", path(F.get("rows", F.lit(0))))

    def pairs(row: Column, k: Column) -> Column:
        a, b, n = (F.regexp_extract(place(row), block, i).cast("bigint") for i in (1, 2, 3))
        return F.transform(F.sequence(a, b), lambda line: F.struct(line.alias("line"), k.alias("k"), n.alias("n")))

    def first(own: Column) -> Column:
        return F.coalesce(F.get(F.filter(own, lambda p: p["n"] != 0), F.lit(0))["n"], F.lit(0).cast("bigint"))

    return _fold_lines(runs.select("file", "path", F.flatten(F.transform("rows", pairs)).alias("pairs")), first).select("file", "path", "hits")


def _xml(content: str, schema: str, row_tag: str) -> Column:
    return F.from_xml(content, schema, {"attributePrefix": "_", "valueTag": "_VALUE", "rowTag": row_tag})


def cobertura(reports: DataFrame) -> DataFrame:
    """Class lines; classes of one file are merged, counts of a line added, bad counts are -1."""
    line = "lines struct<line:array<struct<_number:string,_hits:string>>>"
    schema = f"packages struct<package:array<struct<classes:struct<class:array<struct<_filename:string,{line.replace('lines struct', 'lines:struct', 1)}>>>>>>"
    classes = reports.select("file", F.explode(_xml("content", schema, "coverage")["packages"]["package"]).alias("p")).select("file", F.explode("p.classes.class").alias("c"))
    lines = classes.select("file", F.col("c._filename").alias("path"), F.explode_outer("c.lines.line").alias("l"))
    lines = lines.select("file", "path", F.coalesce(F.col("l._number").try_cast("bigint"), F.lit(0)).alias("line"), F.col("l._hits").try_cast("bigint").alias("n"))
    return _gather(lines, ["file", "path"], F.coalesce(F.sum(F.when(F.col("n") >= 0, F.col("n"))), F.lit(-1).cast("bigint")))


def clover(reports: DataFrame) -> DataFrame:
    """Files of a project, also in packages; lines by number, gaps -1, padded to the loc metric.

    A number given twice takes a slot more and shifts what follows.
    """
    file = "struct<_name:string,_path:string,line:array<struct<_num:string,_count:string>>,metrics:struct<_loc:string>>"
    schema = f"project struct<file:array<{file}>,package:array<struct<file:array<{file}>>>>"
    project = _xml("content", schema, "coverage")["project"]
    none = F.array().cast(f"array<{file}>")
    own = F.coalesce(project["file"], none)
    packed = F.flatten(F.transform(F.coalesce(project["package"], F.array().cast(f"array<struct<file:array<{file}>>>")), lambda p: F.coalesce(p["file"], none)))
    rows = reports.select("file", F.posexplode(F.concat(own, packed)).alias("record", "f"))
    lines = F.array_sort(F.filter(F.transform(F.coalesce("f.line", F.array().cast("array<struct<_num:string,_count:string>>")), lambda x, i: F.struct(x["_num"].try_cast("bigint").alias("num"), i.alias("i"), x["_count"].cast("bigint").alias("count"))), lambda x: x["num"] > 0))
    loc = F.coalesce(F.col("f.metrics._loc").try_cast("bigint"), F.lit(0))
    rows = rows.select("file", "record", F.coalesce("f._path", "f._name").alias("path"), loc.alias("size"), F.posexplode_outer(lines).alias("k", "l"))
    upto = Window.partitionBy("file", "record").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    place = F.when(F.col("l").isNotNull(), F.col("k") + F.max(F.col("l.num") - F.col("k")).over(upto))  # a place after the last one at least
    rows = rows.withColumn("line", place).groupBy("file", "record", "path", "size").agg(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("line", F.col("l.count").alias("value"))))).alias("rows"))
    return rows.select("file", "path", dense(F.col("rows"), F.col("size")).alias("hits"))


def jacoco(reports: DataFrame) -> DataFrame:
    """Source files of packages, direct or one group deep; a line's covered instructions."""
    package = "struct<_name:string,sourcefile:array<struct<_name:string,line:array<struct<_nr:string,_ci:string>>>>>"
    schema = f"package array<{package}>, group array<struct<package:array<{package}>>>"
    report = _xml("content", schema, "report")
    none = F.array().cast(f"array<{package}>")
    grouped = F.flatten(F.transform(F.coalesce(report["group"], F.array().cast(f"array<struct<package:array<{package}>>>")), lambda g: F.coalesce(g["package"], none)))
    rows = reports.select("file", F.explode(F.concat(F.coalesce(report["package"], none), grouped)).alias("p")).select("file", F.col("p._name").alias("dir"), F.explode("p.sourcefile").alias("s"))
    lines = rows.select("file", F.concat_ws("/", "dir", "s._name").alias("path"), F.posexplode_outer("s.line").alias("k", "l"))
    lines = lines.select("file", "path", "k", F.coalesce(F.col("l._nr").try_cast("bigint"), F.lit(0)).alias("line"), F.col("l._ci").try_cast("bigint").alias("n"))
    return _gather(lines, ["file", "path"], F.max_by("n", "k"))


def dotcover(reports: DataFrame) -> DataFrame:
    """Statements joined to the file index by number; the last statement of a line counts."""
    index = reports.select("file", F.explode(F.regexp_extract_all("content", F.lit(r"<File\s[^>]*>"), F.lit(0))).alias("x"))
    index = index.select("file", F.regexp_extract("x", r'\bIndex="([^"]*)"', 1).alias("i"), F.regexp_extract("x", r'\bName="([^"]*)"', 1).alias("path"))
    rows = reports.select("file", F.posexplode(F.regexp_extract_all("content", F.lit(r"<Statement\s[^>]*>"), F.lit(0))).alias("k", "x"))
    rows = rows.select("file", "k", F.regexp_extract("x", r'\bFileIndex="([^"]*)"', 1).alias("i"), F.regexp_extract("x", r'\bLine="([^"]*)"', 1).try_cast("bigint").alias("line"), (F.lower(F.regexp_extract("x", r'\bCovered="([^"]*)"', 1)) == "true").cast("bigint").alias("n"))
    return _gather(rows.where("line > 0").join(index, ["file", "i"]).select("file", "path", "line", "k", "n"), ["file", "path"], F.max_by("n", "k"))


READERS = {"lcov": lcov, "clover": clover, "cobertura": cobertura, "coverprofile": coverprofile, "dotcover": dotcover, "jacoco": jacoco, "simplecov": simplecov, "xccov": xccov}
