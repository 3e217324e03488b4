"""Bundles for upload: a folder of numbered JSON-line parts with metadata and a manifest.

Each part is written by one task under the name that its number gives it, so the same rows make
the same files however the table is partitioned. A bundle is made under a name of its own and
renamed once its manifest is in it: a reader never sees half of one, and a failed run leaves only
a folder that ``work-`` begins, which the next run of that bundle deletes.

Layout: ``<table>-NNN.jsonl`` of each numbered table, ``<table>.jsonl`` of each whole one,
``metadata.json``, ``manifest.json`` with a name, rows and bytes of each part. An archive of all
is made by one task that streams the parts, for bundles up to a bound only, as one archive is
one stream; beyond it the folder is what to ship.

Defined cases: an empty numbered table has no part, an empty whole one an empty file; metadata
without a value are left out; an existing bundle is an error.
"""

from __future__ import annotations

import json
import zipfile
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import PART_ROWS

#: Most bytes of the parts of an archive.
ARCHIVE_BYTES = 1 << 30


def _path(spark: SparkSession, text: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)


def _fs(spark: SparkSession, text: str):
    return _path(spark, text).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def pretty(document: dict) -> str:
    """One JSON object over several lines, with a line feed at the end."""
    return json.dumps({k: v for k, v in document.items() if v is not None}, indent=2, ensure_ascii=False) + "\n"


def _put(spark: SparkSession, path: str, text: str) -> int:
    raw = text.encode()
    out = _fs(spark, path).create(_path(spark, path), True)
    out.write(bytearray(raw))
    out.close()
    return len(raw)


def with_upload(df: DataFrame, ids: dict[str, str | None], pull_request: str | None = None) -> DataFrame:
    """Rows with the ids of their upload; the pull request only if there is one."""
    made = {k: F.lit(v).cast("string") for k, v in ids.items()}
    if pull_request:
        made["pull_request_number"] = F.lit(pull_request)
    return df.withColumns(made)


def _parts(df: DataFrame, name: str, size: int | None) -> DataFrame:
    """(file, position, value): JSON lines and the part they go to; ``df`` has ``position`` if it is numbered."""
    columns = [c for c in df.columns if c != "position"]
    body = F.to_json(F.struct(*columns)).alias("value")
    if size is None:
        return df.select(F.lit(f"{name}.jsonl").alias("file"), F.lit(0).cast("bigint").alias("position"), body)
    part = F.floor((F.col("position") - 1) / size).cast("string")
    number = F.lpad(part, F.greatest(F.length(part), F.lit(3)), F.lit("0"))
    return df.select(F.concat(F.lit(f"{name}-"), number, F.lit(".jsonl")).alias("file"), "position", body)


def write_bundle(path: str, numbered: dict[str, DataFrame], whole: dict[str, DataFrame], metadata: dict, sizes: dict[str, int] | None = None) -> list[dict]:
    """Write a bundle; ``numbered`` tables have ``position`` from 1 and parts of ``sizes`` rows. Returns the manifest's parts."""
    spark = next(iter([*numbered.values(), *whole.values()])).sparkSession
    fs, target = _fs(spark, path), path.rstrip("/")
    if fs.exists(_path(spark, target)):
        raise FileExistsError(f"there is a bundle at {target}")
    head, _, tail = target.rpartition("/")
    work = f"{head}/work-{tail}"
    fs.delete(_path(spark, work), True)
    sizes = {**PART_ROWS, "file_coverages": PART_ROWS["coverage"], **(sizes or {})}
    parts = []
    for name, df, size in [*((n, d, sizes[n]) for n, d in numbered.items()), *((n, d, None) for n, d in whole.items())]:
        rows = _parts(df, name, size)
        counts = {r["file"]: r["count"] for r in rows.groupBy("file").count().collect()}  # a row for each part
        # a number given isn't lowered: making files takes longer than their few bytes tell
        tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = rows.repartition(tasks, "file") if size is not None else rows.coalesce(1)
        # tasks move their own files at once: the bundle isn't published before all are there
        dealt.sortWithinPartitions("file", "position").select("file", "value").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("file").text(f"{work}/{name}.parts")
        parts += _named(spark, work, f"{name}.parts", counts)
        fs.delete(_path(spark, f"{work}/{name}.parts"), True)
        if size is None and f"{name}.jsonl" not in counts:
            parts.append({"name": f"{name}.jsonl", "rows": 0, "bytes": _put(spark, f"{work}/{name}.jsonl", "")})
    parts.sort(key=lambda p: p["name"])
    _put(spark, f"{work}/metadata.json", pretty(metadata))
    _put(spark, f"{work}/manifest.json", pretty({"parts": parts}))
    if not fs.rename(_path(spark, work), _path(spark, target)):
        raise OSError(f"{target} can't be published")
    return parts


def _named(spark: SparkSession, work: str, folder: str, counts: dict[str, int]) -> list[dict]:
    """Move ``folder``/file=NAME/part-... to NAME, several at once, and return what the manifest says of each."""
    fs, path = _fs(spark, work), spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def move(file: str) -> dict:
        made = [x for x in fs.listStatus(path(f"{work}/{folder}/file={file}")) if x.getPath().getName().startswith("part-")]
        if len(made) != 1 or not fs.rename(made[0].getPath(), path(f"{work}/{file}")):
            raise OSError(f"part {file} in {work} isn't one file")
        return {"name": file, "rows": counts[file], "bytes": made[0].getLen()}

    with ThreadPoolExecutor(8) as pool:
        return list(pool.map(move, counts))


def manifest(spark: SparkSession, path: str) -> list[dict]:
    text = "\n".join(r["value"] for r in spark.read.text(f"{path.rstrip('/')}/manifest.json", wholetext=True).collect())  # a row for each part
    return json.loads(text)["parts"]


def read_table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table of a bundle with ``file``, by the manifest's parts."""
    files = [p["name"] for p in manifest(spark, path) if p["rows"] and (p["name"] == f"{name}.jsonl" or p["name"].startswith(f"{name}-"))]
    if not files:
        return spark.createDataFrame([], f"{schema}, file string")
    rows = spark.read.schema(schema).json([f"{path.rstrip('/')}/{f}" for f in files])
    return rows.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def archive(spark: SparkSession, path: str, most: int = ARCHIVE_BYTES) -> str:
    """``<bundle>.zip`` of metadata and parts, streamed by one task that reads them by Spark's own reader; an error beyond ``most`` bytes."""
    parts = manifest(spark, path)
    if sum(p["bytes"] for p in parts) > most:
        raise ValueError(f"over {most} bytes: ship the folder")
    names = sorted([p["name"] for p in parts] + ["metadata.json"])
    files = spark.read.format("binaryFile").load([f"{path.rstrip('/')}/{n}" for n in names]).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def pack(batches):
        import io

        import pyarrow as pa

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for batch in batches:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    z.writestr(name, content)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["content"])

    raw = files.repartition(1).sortWithinPartitions("name").mapInArrow(pack, "content binary").first()["content"]  # within the bound
    target = f"{path.rstrip('/')}.zip"
    out = _fs(spark, target).create(_path(spark, target), True)
    out.write(bytearray(raw))
    out.close()
    return target
