"""Package manifests and lock files as tables.

``package.json``: (path, section, package, requirement); ``package-lock.json``: (path, package,
version), the package being what follows the last ``node_modules/`` of its place, and
``nested`` if it is installed below another one; ``Gemfile.lock``: the versions of its specs.

Defined cases: null contents, other JSON and missing sections give no rows; a requirement or
version that is no text is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTIONS = ("dependencies", "devDependencies")
MARK = "node_modules/"


def named(files: DataFrame, name: str) -> DataFrame:
    """Files of that name in any directory."""
    return files.where(F.element_at(F.split("path", "/"), -1) == name)


def folder(path: Column) -> Column:
    """The directory of a path, '' for a bare name."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def node_dependencies(files: DataFrame) -> DataFrame:
    parts = [F.struct(F.lit(s).alias("section"), F.from_json(F.get_json_object("contents", f"$.{s}"), "map<string,string>").alias("all")) for s in SECTIONS]
    rows = named(files, "package.json").select("path", F.explode(F.array(*parts)).alias("s")).select("path", "s.section", F.explode("s.all").alias("package", "requirement"))
    return rows.where("requirement IS NOT NULL")


def node_locked(files: DataFrame) -> DataFrame:
    all_ = F.from_json(F.get_json_object("contents", "$.packages"), "map<string,struct<version:string>>")
    rows = named(files, "package-lock.json").select("path", F.explode(all_).alias("place", "p")).where(F.col("place").contains(MARK) & F.col("p.version").isNotNull())
    depth = (F.length("place") - F.length(F.replace("place", F.lit(MARK), F.lit("")))) / len(MARK)
    return rows.select("path", F.substring_index("place", MARK, -1).alias("package"), F.col("p.version").alias("version"), (depth > 1).alias("nested"))


def gems_locked(files: DataFrame) -> DataFrame:
    """(path, package, version) of a Gemfile.lock: the specs four blanks in, not what they ask for."""
    rows = named(files, "Gemfile.lock").select("path", F.explode(F.split("contents", "\r?\n")).alias("line"))
    pattern = r"^ {4}([^ (]+) \(([^)]+)\)$"
    return rows.where(F.col("line").rlike(pattern)).select("path", F.regexp_extract("line", pattern, 1).alias("package"), F.regexp_extract("line", pattern, 2).alias("version"))


def plugin_packages(dependencies: DataFrame, filters: DataFrame) -> DataFrame:
    """(path, plugin, filter): filters (plugin, filter) that some package other than the plugin itself contains.

    A distinct package meets each filter once, however many manifests name it.
    """
    packages = dependencies.select("package").distinct().join(filters, F.col("package").contains(F.col("filter")) & (F.col("package") != F.col("plugin")))
    return dependencies.select("path", "package").join(packages, "package").select("path", "plugin", "filter").distinct()
