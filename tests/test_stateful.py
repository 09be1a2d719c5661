"""Breaker and rate on streams against their batch forms, with restarts and late rows; the cache in buckets."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from quarry.streaming import incremental

SHAPE = "device string, n long, at timestamp, outcome string"


def outcomes(rng, n):
    at = datetime.datetime(2024, 1, 1)
    return [(rng.choice("aaaab") if k % 7 else None, k, at + datetime.timedelta(seconds=k), rng.choice(["device", "device", "benign", "ok"])) for k in range(n)]


def plain(rows):
    state = {}
    for device, _, _, outcome in rows:
        run, longest, total = state.get(device, (0, 0, 0))
        run = run + 1 if outcome == "device" else 0 if outcome == "ok" else run
        state[device] = (run, max(longest, run), total + (outcome == "device"))
    return {d: (longest, total, longest >= 5 or total >= 100) for d, (_, longest, total) in state.items()}


def test_breaker_in_slices(spark):
    rows = outcomes(random.Random(1), 500)
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    got = {r.device: (r.longest, r.total, r.tripped) for r in incremental.breaker(df, ["device"], ["at", "n"], "outcome", 5, 100).collect()}
    assert got == plain(rows)
    assert incremental.breaker(df.limit(0), ["device"], ["at", "n"], "outcome", 5, 100).collect() == []


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_breaker_of_a_stream(spark, tmp_path, rocks):
    rows = [r for r in outcomes(random.Random(2), 300) if r[0]]
    folder = tmp_path / "in"

    def add(k):
        part = rows[k * 60 : k * 60 + 60]
        spark.createDataFrame(part, SHAPE).coalesce(1).write.mode("append").parquet(str(folder))
        return part

    last, stopped = {}, []

    def run(sink):
        stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(str(folder))
        found = incremental.breaker_stream(stream, ["device"], ["at", "n"], "outcome", 5, 100)
        query = found.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception as e:  # noqa: BLE001
            stopped.append(str(e))

    def keep(df, n):
        last.update({r.device: (r.longest, r.total, r.tripped) for r in df.collect()})

    seen = []
    for k in range(3):  # a new query for each file goes on with the state
        seen += add(k)
        run(keep)
        assert last == plain(seen)
    seen += add(3)
    assert any(t for _, _, t in last.values())
    add(4)
    run(incremental.stopping(keep))
    assert len(stopped) == 1 and "tripped" in stopped[0] and last == plain(seen)
    run(keep)
    assert last == plain(rows[:300])


def test_rate_of_a_stream(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rng = random.Random(3)
    rows = [("x", at + datetime.timedelta(seconds=rng.uniform(0, 100) + 100 * k)) for k in range(4) for _ in range(50)]
    late = ("x", at + datetime.timedelta(seconds=10))

    def add(some):
        spark.createDataFrame(some, "g string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    got = {}

    def run():
        stream = spark.readStream.schema("g string, at timestamp").parquet(str(tmp_path / "in"))
        found = incremental.windowed_rate(stream, "g", "at", 20, 5, "30 seconds")
        query = found.writeStream.outputMode("append").foreachBatch(lambda df, n: got.update({(r.g, r.end): (r.n, r.rate) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()

    for k in range(4):
        add(rows[50 * k : 50 * k + 50])
        run()
    add([late])
    run()
    want = {(r.g, r.end): (r.n, r.rate) for r in incremental.windowed_rate(spark.createDataFrame(rows, "g string, at timestamp"), "g", "at", 20, 5).collect()}
    mark = max(t for _, t in rows) - datetime.timedelta(seconds=30)
    assert got == {k: v for k, v in want.items() if k[1] <= mark} and len(got) > 60


def test_cache_in_buckets(spark, tmp_path):
    path = str(tmp_path / "cache")
    cache = incremental.BucketCache(spark, path, "path string, size long, sha string", ["path", "size"], 16)
    records = spark.createDataFrame([(f"f{k}", k % 3, f"h{k}") for k in range(200)], "path string, size long, sha string")
    assert {r.cache for r in cache.lookup(records.drop("sha")).collect()} == {"miss"}
    assert len(cache.upsert(records)) == 16
    before = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("bucket=")}
    fresh = spark.createDataFrame([("f3", 0, "new"), ("f3", 9, "other size"), ("g", 1, "g")], "path string, size long, sha string")
    touched = cache.upsert(fresh)
    after = {d: sorted(os.listdir(f"{path}/{d}")) for d in before}
    assert {int(d.split("=")[1]) for d in before if before[d] != after[d]} == set(touched) and len(touched) <= 2
    for most in (0, 100_000):
        cache.BROADCAST_ROWS = most
        got = {(r.path, r.size): (r.sha, r.cache) for r in cache.lookup(spark.createDataFrame([("f3", 0), ("f3", 9), ("f4", 1), ("f4", 2), ("g", 1)], "path string, size long")).collect()}
        assert got == {("f3", 0): ("new", "hit"), ("f3", 9): ("other size", "hit"), ("f4", 1): ("h4", "hit"), ("f4", 2): (None, "miss"), ("g", 1): ("g", "hit")}
    plan = cache.lookup(fresh.drop("sha"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert cache.table().count() == 202
