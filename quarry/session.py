"""Session settings, table readers and the shared scratch folder."""

from __future__ import annotations

import functools
import gc
import os
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def build_session(name: str = "quarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC time and non-ANSI casts unless overridden."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started.

    On a cluster whose executors don't see the driver's folders, ship the package with --py-files.
    """
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` under `sf_dir`."""
    _reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where the table has fewer files than there are cores; else as it is.

    Work per row is heavy in text operators, and a file of one row group is one task however many cores wait.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


_made: list[str] = []


def clear_scratch(spark: SparkSession) -> None:
    """Delete the scratch folders of this process. Results that still read them must have been written before."""
    while _made:
        _delete(spark, _made.pop())


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir. Where that is unset, a local session uses a folder of its own; on a cluster
    that would be another disk for each executor, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "/tmp/checkpoints/quarry"
    _made.append(f"{root.rstrip('/')}/quarry-{uuid.uuid4().hex}")
    return _made[-1]


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    df.write.option("parquet.block.size", 32 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles that nothing refers to any more, so that they don't add up over the steps of a long job.

    Twice with a pause: the first time, events of the last query that still wait for listeners may refer to them.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def settle(spark: SparkSession, step: Callable[[], DataFrame], name: str = "step") -> DataFrame:
    """What `step` finds, written. What it wrote on the way is deleted then, so nothing else may read that."""
    before = len(_made)
    found = materialize(step(), name)
    for folder in _made[before:-1]:
        _delete(spark, folder)
    del _made[before:-1]
    return found


def in_parts(spark: SparkSession, parts: int, step: Callable[[Callable[[DataFrame, str], DataFrame]], DataFrame], name: str = "step") -> DataFrame:
    """The rows that `step` finds for each part of the values of a column in turn, written.

    `step` gets a function (rows, column) that leaves the rows of the part, and joins or groups by that column. Of each part only
    the result stays: shuffles and what was written on the way are deleted, so the disk holds those of one part at a time.
    """
    written = []
    for part in range(parts):
        if parts > 1:
            free_shuffles(spark)
        written.append(settle(spark, lambda part=part: step(lambda df, c: df.where(F.pmod(F.xxhash64(c), F.lit(parts)) == part)), name))
    if parts > 1:
        free_shuffles(spark)
    return functools.reduce(DataFrame.unionByName, written)
