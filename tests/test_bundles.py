"""Bundles: names and rows of parts at any partitioning, and nothing of a failed run."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import bundles as B
from gaugeworks.operators.issues import positions

SCHEMA = "path string, hits array<bigint>"


def table(spark, n, parts):
    rows = spark.range(n).select(F.concat(F.lit("f"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("path"), F.array("id", F.lit(-1).cast("bigint")).alias("hits"))
    return positions(rows.repartition(parts).orderBy("path"))


def files(spark):
    return spark.createDataFrame([("lcov.info", 3), ("é.xml", 4)], "path string, size long")


@pytest.mark.parametrize("parts", [1, 5])
def test_parts_equal_the_table(spark, tmp_path, parts):
    path = str(tmp_path / "b")
    made = B.write_bundle(path, {"file_coverages": table(spark, 2500, parts)}, {"report_files": files(spark)}, {"build_id": "b1", "tag": None}, {"file_coverages": 1000})
    assert [(p["name"], p["rows"]) for p in made] == [("file_coverages-000.jsonl", 1000), ("file_coverages-001.jsonl", 1000), ("file_coverages-002.jsonl", 500), ("report_files.jsonl", 2)]
    assert sorted(x for x in os.listdir(path) if not x.endswith(".crc")) == [*(p["name"] for p in made[:3]), "manifest.json", "metadata.json", "report_files.jsonl"]
    assert open(f"{path}/metadata.json").read() == '{\n  "build_id": "b1"\n}\n' and B.manifest(spark, path) == made
    lines = [json.loads(x) for p in made[:3] for x in open(f"{path}/{p['name']}")]
    assert lines == [{"path": f"f{i:05d}", "hits": [i, -1]} for i in range(2500)]
    assert all(os.path.getsize(f"{path}/{p['name']}") == p["bytes"] for p in made)
    back = B.read_table(spark, path, "file_coverages", SCHEMA)
    assert back.where("file = 'file_coverages-002.jsonl'").count() == 500 and back.count() == 2500
    zipped = zipfile.ZipFile(io.BytesIO(open(B.archive(spark, path), "rb").read()))
    assert zipped.namelist() == sorted([*(p["name"] for p in made), "metadata.json"])
    assert zipped.read("file_coverages-001.jsonl") == open(f"{path}/file_coverages-001.jsonl", "rb").read()
    with pytest.raises(ValueError, match="ship the folder"):
        B.archive(spark, path, most=10)
    with pytest.raises(FileExistsError):
        B.write_bundle(path, {}, {"report_files": files(spark)}, {})


def test_failed_run_leaves_no_bundle(spark, tmp_path):
    path = str(tmp_path / "b")
    bad = table(spark, 100, 3).withColumn("hits", F.when(F.col("position") == 70, F.raise_error(F.lit("lost")).cast("array<bigint>")).otherwise(F.col("hits")))
    with pytest.raises(Exception, match="lost"):
        B.write_bundle(path, {"file_coverages": bad}, {"report_files": files(spark)}, {})
    assert not os.path.exists(path)
    made = B.write_bundle(path, {"file_coverages": table(spark, 0, 1)}, {"report_files": files(spark).limit(0)}, {})
    assert made == [{"name": "report_files.jsonl", "rows": 0, "bytes": 0}] and os.listdir(tmp_path) == ["b"]
    assert B.read_table(spark, path, "file_coverages", SCHEMA).count() == 0


def test_ids_of_an_upload(spark):
    df = spark.createDataFrame([("a", "old")], "path string, build_id string")
    assert tuple(B.with_upload(df, {"build_id": "b", "tag": None}).first()) == ("a", "b", None)
    assert B.with_upload(df, {"build_id": "b"}, pull_request="7").columns == ["path", "build_id", "pull_request_number"] and B.with_upload(df, {}, pull_request="").columns == df.columns
