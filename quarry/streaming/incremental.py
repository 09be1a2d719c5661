"""Incremental work: caches, read budgets, known-bad records, the breaker, job state and streaming file scans."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from quarry.session import materialize

# Error numbers of failing devices; all others are benign.
DEVICE_WINDOWS = (21, 23, 27, 121, 433, 1117, 1127, 1167)
DEVICE_ERRNO = (5, 19, 6)  # EIO, ENODEV, ENXIO


def without_bad(records: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    """Records that are not in the table of bad ones."""
    return records.join(bad.select(key).distinct(), key, "left_anti")


def within_budget(misses: DataFrame, order: str, budget: int) -> DataFrame:
    """The first `budget` records to read; 0 is no limit."""
    return misses.orderBy(order).limit(budget) if budget else misses


def cache_state(records: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Records with cache = hit or miss by equality of all keys (path, size, time and version)."""
    known = cache.select(*keys, F.lit("hit").alias("cache")).distinct()
    return records.join(known, keys, "left").withColumn("cache", F.coalesce("cache", F.lit("miss")))


def upsert(cache: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The cache with fresh rows in place of those of equal keys. See BucketCache for one that isn't rewritten as a whole."""
    return cache.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


class BucketCache:
    """A cache in a folder, dealt into buckets by its first key; an upsert reads and writes the buckets that it touches only.

    Rows of equal keys are one row. A batch of up to BROADCAST_ROWS records is sent to the cache, so the cache is not shuffled; larger
    ones meet it by bucket and keys. Records and buckets without each other are pruned either way.
    """

    BROADCAST_ROWS = 100_000

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 256):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("bucket", T.IntegerType())])

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.keys[0]), F.lit(self.buckets)).cast("int"))

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r["bucket"] for r in self._placed(rows).select("bucket").distinct().collect())  # `buckets` numbers at most

    def table(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows with their bucket, of the given buckets."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        rows = self.spark.read.schema(self.schema).parquet(self.path) if there else self.spark.createDataFrame([], self.schema)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def lookup(self, records: DataFrame) -> DataFrame:
        """`records` (with all keys) with the cached values where all keys are equal, and cache = hit or miss."""
        held = self.table(self._touched(records)).withColumn("_hit", F.lit(True))
        placed = self._placed(records)
        on = ["bucket", *self.keys]
        values = [f.name for f in self.schema if f.name not in on]
        if records.count() <= self.BROADCAST_ROWS:  # what is met comes to the records, not the cache
            met = held.join(F.broadcast(placed.select(*on).distinct()), on, "left_semi")
        else:
            met = held
        out = placed.join(met, on, "left")
        return out.select(*records.columns, *values, F.when(F.col("_hit"), "hit").otherwise("miss").alias("cache"))

    def upsert(self, fresh: DataFrame) -> list[int]:
        """Put fresh rows in place of those of equal keys; the buckets that were written. Of fresh rows with equal keys any stays."""
        fresh = materialize(self._placed(fresh.select(*(f.name for f in self.schema if f.name != "bucket"))).dropDuplicates(self.keys), "fresh")
        touched = self._touched(fresh)
        kept = self.table(touched)
        keys = fresh.select("bucket", *self.keys)
        kept = kept.join(F.broadcast(keys) if fresh.count() <= self.BROADCAST_ROWS else keys, ["bucket", *self.keys], "left_anti")
        merged = materialize(kept.unionByName(fresh), "merged")  # what is overwritten is read before
        merged.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return touched


def classify_error(errno: Column, winerror: Column) -> Column:
    return F.when(winerror.isin(*DEVICE_WINDOWS) | errno.isin(*DEVICE_ERRNO), "device").otherwise("benign")


def breaker(outcomes: DataFrame, group: list[str], order: list[str], outcome: str, consecutive: int, total: int) -> DataFrame:
    """Per group: the longest run of device errors (benign ones don't end it, success does), their number, and whether
    a limit is reached; a limit of 0 is off.

    Outcomes are dealt into ranges of group and time. A range numbers its own runs; the successes of a group in the ranges before say
    which run goes on, so a device with very many outcomes is many tasks'.
    """
    parts = max(1, int(outcomes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = outcomes.select(*group, *order, F.col(outcome).alias("_o")).repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id())
    placed = materialize(placed, "outcomes")
    local = F.count_if(F.col("_o") == "ok").over(W.partitionBy(*group, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    pieces = placed.withColumn("_run", local).groupBy(*group, "_part", "_run").agg(F.count_if(F.col("_o") == "device").alias("_n"))
    before = F.sum("_ok").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))  # a row for each range of a group
    starts = placed.groupBy(*group, "_part").agg(F.count_if(F.col("_o") == "ok").alias("_ok")).select(*group, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    same = F.lit(True)
    for c in (*group, "_part"):
        same = same & pieces[c].eqNullSafe(starts[c])
    joined = pieces.join(starts, same).select(*(pieces[c] for c in group), (F.col("_run") + F.col("_before")).alias("_run"), "_n")
    runs = joined.groupBy(*group, "_run").agg(F.sum("_n").alias("_n"))
    longest, number = F.max("_n"), F.sum("_n")
    return runs.groupBy(*group).agg(longest.alias("longest"), number.alias("total"), _over(longest, number, consecutive, total).alias("tripped"))


def _over(longest: Column, number: Column, consecutive: int, total: int) -> Column:
    out = F.lit(False)
    if consecutive:
        out = out | (longest >= consecutive)
    return out | (number >= total) if total else out


class _Runs(StatefulProcessor):
    """Of each device: the run of errors that goes on, the longest one, and the number of errors."""

    def __init__(self, order: list[str], outcome: str, consecutive: int, total: int):
        self.order, self.outcome, self.consecutive, self.total = order, outcome, consecutive, total

    def init(self, handle) -> None:
        self.runs = handle.getValueState("runs", "run long, longest long, total long")

    def handleInputRows(self, key, rows, timerValues):
        run, longest, total = (int(x) for x in self.runs.get()) if self.runs.exists() else (0, 0, 0)
        for outcome in pd.concat(list(rows)).sort_values(self.order, kind="stable")[self.outcome]:
            if outcome == "device":
                run, total = run + 1, total + 1
                longest = max(longest, run)
            elif outcome == "ok":
                run = 0
        self.runs.update((run, longest, total))
        tripped = bool(self.consecutive and longest >= self.consecutive or self.total and total >= self.total)
        yield pd.DataFrame([(*key, longest, total, tripped)])

    def close(self) -> None:
        pass


class _Named(_Runs):
    """With the columns of the result."""

    def __init__(self, names: list[str], *rest):
        super().__init__(*rest)
        self.names = names

    def handleInputRows(self, key, rows, timerValues):
        for out in super().handleInputRows(key, rows, timerValues):
            yield out.set_axis(self.names, axis=1)


def breaker_stream(outcomes: DataFrame, group: list[str], order: list[str], outcome: str, consecutive: int, total: int) -> DataFrame:
    """`breaker` of a stream: a row of each group for every batch in which it has outcomes, with what all batches so far say.

    Batches count in the order in which they arrive, rows of a batch in the given order. Needs the RocksDB state store.
    """
    fields = [outcomes.schema[c] for c in group] + list(T.StructType().add("longest", "long").add("total", "long").add("tripped", "boolean"))
    runs = _Named([f.name for f in fields], order, outcome, consecutive, total)
    return outcomes.groupBy(*group).transformWithStateInPandas(runs, T.StructType(fields), "Update", "None")


def stopping(sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A sink of batches that stops its stream once a row is `tripped`: that batch is finished, and the next one fails before it is read, so
    that a restart takes it up."""
    tripped = []

    def run(batch: DataFrame, number: int) -> None:
        if tripped:
            raise RuntimeError("the breaker has tripped")
        sink(batch, number)
        if not batch.where("tripped").isEmpty():
            tripped.append(number)

    return run


def windowed_rate(events: DataFrame, group: str, ts: str, seconds: int = 20, slide: int = 1, delay: str = "1 minute") -> DataFrame:
    """(group, start, end, n, rate) of sliding windows over batches or streams: events a second of the `seconds` before each `end`.

    In a stream, windows are told when the watermark has passed them, and rows that come later than `delay` are left out.
    """
    window = F.window(F.col(ts), f"{seconds} seconds", f"{slide} seconds")
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    counted = timed.groupBy(group, window.alias("w")).agg(F.count("*").alias("n"))
    return counted.select(group, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", (F.col("n") / seconds).alias("rate"))


def trailing_count(df: DataFrame, group: str, ts: str, seconds: int) -> DataFrame:
    """`recent`: events of the group within the seconds before and up to each row's time.

    Rows are dealt into slices of time of that length, each also into the next slice, where it is only counted; so a
    group that holds most events is spread over as many tasks as it has slices.
    """
    span = seconds * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    own = F.floor(micros / span)
    dealt = df.withColumn("_t", micros).withColumn("_p", F.explode(F.array(F.struct(own.alias("slice"), F.lit(True).alias("own")), F.struct((own + 1).alias("slice"), F.lit(False).alias("own")))))
    w = W.partitionBy(group, F.col("_p.slice")).orderBy("_t").rangeBetween(-span, 0)
    return dealt.withColumn("recent", F.count("*").over(w)).where("_p.own").drop("_t", "_p")


def job_key(command: Column, folder: Column, *options: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", command, folder, *options), 256), 1, 16)


def scan_new_files(spark: SparkSession, source: str, checkpoint: str, sink: Callable[[DataFrame, int], None], budget: int = 1000) -> StreamingQuery:
    """Process the files that no earlier run has seen, at most `budget` a batch, then stop.

    The stream's checkpoint remembers what was read, so a rerun after a failure goes on where it stopped; `sink` gets
    each batch with its number and should write idempotently by that number.
    """
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", budget).load(source)
    hashed = stream.select("path", "modificationTime", "length", F.sha2("content", 256).alias("sha256"))
    return hashed.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
