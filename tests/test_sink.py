"""Rows and document are there together or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.sources import sink


def test_written_and_read(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.range(100).repartition(3).select("id", F.concat(F.lit("n"), "id").alias("name"), F.array("id").alias("list"), F.lit("2020-01-02").cast("timestamp").alias("at"))
    sink.write(rows, path, {"kind": "x", "note": "ü"})
    document, found = sink.read(spark, path, "x")
    assert document == {"kind": "x", "note": "ü"} and sorted(found.collect()) == sorted(rows.collect()) and found.dtypes == rows.dtypes
    with pytest.raises(ValueError):
        sink.read(spark, path, "y")
    with pytest.raises(Exception, match="holds a result"):
        sink.write(rows, path, {"kind": "x"})
    sink.write(rows.limit(5), path, {"kind": "x"}, overwrite=True)
    assert sink.read(spark, path, "x")[1].count() == 5 and len(os.listdir(f"{path}/rows")) == 1
    sink.write(rows.limit(0), str(tmp_path / "none"), {"kind": "x"})
    assert sink.read(spark, str(tmp_path / "none"), "x")[1].count() == 0


def test_a_failed_task_leaves_no_result(spark, tmp_path):
    path = str(tmp_path / "r")
    failing = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 39, F.raise_error(F.lit("gone"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="gone"):
        sink.write(failing, path, {"kind": "x"})
    assert sink.document_of(path) is None and os.listdir(f"{path}/rows") == []
    sink.write(spark.range(3), path, {"kind": "x"})
    with pytest.raises(Exception, match="gone"):
        sink.write(failing, path, {"kind": "x"}, overwrite=True)
    assert sorted(r.id for r in sink.read(spark, path, "x")[1].collect()) == [0, 1, 2]  # the earlier one is still there
