"""Jobs as rows: what runs, what is left, what failed; budgets over several stages; reports to resume from; progress and stopping."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from quarry.session import materialize
from quarry.streaming.incremental import cache_state, classify_error, without_bad

JOB = "job_key string, command string, folder string, status string, done long, total long, last_path string, device_errors long, note string, started_at timestamp, updated_at timestamp, seq long"
BAD = "path string, error string, seen_at timestamp"
STATES = ("running", "partial", "done", "interrupted", "disk-trouble")
CLEARED = "cleared"  # a row that ends what was known of a job, so that nothing is deleted and written anew
RESUMABLE = ("running", "interrupted", "disk-trouble", "partial")
NOTE = 500


def last_states(rows: DataFrame, key: str, order: list[str], final: tuple[str, ...] = (CLEARED,)) -> DataFrame:
    """The last row of each job by the order, with `changes`, the number of its rows; jobs whose last status is `final` are left out."""
    fields = [c for c in rows.columns if c not in (key, *order)]
    last = rows.groupBy(key).agg(F.max(F.struct(*order, *fields)).alias("_last"), F.count("*").alias("changes"))
    return last.select(key, *(F.col(f"_last.{c}").alias(c) for c in (*order, *fields)), "changes").where(~F.col("status").isin(*final))


class JobStore:
    """The states of jobs and bad paths as append-only tables in a folder that all executors share.

    Every change is a row of its own, the last of a job counts, so a lost writer loses one change and readers need no lock.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _append(self, rows: DataFrame, name: str) -> None:
        rows.coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def note(self, job_key: str, command: str, folder: str, status: str, done: int = 0, total: int = 0, last_path: str = "", device_errors: int = 0, note: str = "") -> None:
        """One change of a job."""
        if status not in STATES:
            raise ValueError(f"no such state: {status}")
        self._note(job_key, command, folder, status, done, total, last_path, device_errors, note)

    def _note(self, job_key: str, command: str, folder: str, status: str, done: int = 0, total: int = 0, last_path: str = "", device_errors: int = 0, note: str = "") -> None:
        rows = self._read("jobs", JOB).where(F.col("job_key") == job_key)
        cleared = F.coalesce(F.max(F.when(F.col("status") == CLEARED, F.col("seq"))), F.lit(0))
        seen = rows.crossJoin(rows.agg(cleared.alias("_cleared"))).agg(F.max("seq"), F.min(F.when(F.col("seq") > F.col("_cleared"), F.col("started_at")))).first()
        row = self.spark.createDataFrame([(job_key, command, folder, status, done, total, last_path, device_errors, note[:NOTE], (seen[0] or 0) + 1, seen[1])], "job_key string, command string, folder string, status string, done long, total long, last_path string, device_errors long, note string, seq long, began timestamp")
        now = F.current_timestamp()
        self._append(row.select("job_key", "command", "folder", "status", "done", "total", "last_path", "device_errors", "note", F.coalesce("began", now).alias("started_at"), now.alias("updated_at"), "seq"), "jobs")

    def note_bad(self, bad: DataFrame) -> None:
        """Remember (path, error) of failing devices."""
        self._append(bad.select("path", F.substring("error", 1, NOTE).alias("error"), F.current_timestamp().alias("seen_at")), "bad")

    def jobs(self) -> DataFrame:
        """The last state of each job, the latest first."""
        return last_states(self._read("jobs", JOB), "job_key", ["seq"]).select(*(c.split()[0] for c in JOB.split(", ") if not c.startswith("seq"))).orderBy(F.desc("updated_at"), "job_key")

    def unfinished(self) -> DataFrame:
        return self.jobs().where("status <> 'done'")

    def bad_paths(self) -> DataFrame:
        """(path, error, seen_at): the last error of each path."""
        return self._read("bad", BAD).groupBy("path").agg(F.max_by("error", "seen_at").alias("error"), F.max("seen_at").alias("seen_at"))

    def resumed_from(self, job_key: str) -> dict | None:
        """Where an unfinished earlier run stopped."""
        found = self.jobs().where((F.col("job_key") == job_key) & F.col("status").isin(*RESUMABLE)).select("done", "total", "status", "last_path").collect()
        return found[0].asDict() if found else None

    def clear(self, job_key: str = "") -> dict[str, int]:
        """Forget one job, or all jobs and bad paths; what was forgotten."""
        if not job_key:
            gone = {"jobs": self.jobs().count(), "bad_paths": self.bad_paths().count()}
            self._delete("jobs")
            self._delete("bad")
            return gone
        known = self.jobs().where(F.col("job_key") == job_key).select("command", "folder").collect()
        if known:
            self._note(job_key, known[0]["command"], known[0]["folder"], CLEARED)
        return {"jobs": len(known), "bad_paths": 0}


def incremental_read(records: DataFrame, cache: DataFrame, keys: list[str], read: Callable[[DataFrame], DataFrame], order: str, budget: int = 0, bad: DataFrame | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """(results, the cache with what is new, report) of reading records with a cache, a budget and a memory of bad ones.

    `read` turns records into `keys` with values and `error` columns (errno, winerror, error; all null for success). What the cache has isn't read; of the rest, the first
    `budget` in the order are; known bad ones are left out and reported. Results that failed are never cached.
    """
    known = without_bad(records, bad, order) if bad is not None else records
    state = materialize(cache_state(known, cache, keys), "cache_state")
    misses = state.where("cache = 'miss'").drop("cache")
    n_miss, n_hit, n_all = misses.count(), state.where("cache = 'hit'").count(), records.count()
    wanted = misses.orderBy(order).limit(budget) if budget else misses
    got = materialize(read(wanted), "read")
    failed = got.where("error IS NOT NULL")
    fresh = got.where("error IS NULL").select(*cache.columns)
    new_cache = cache.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)
    results = new_cache.join(known.select(*keys), keys, "left_semi")
    n_read = got.count()
    report = {"hits": n_hit, "misses": n_read, "failed": failed.count(), "skipped_known_bad": n_all - known.count()}
    if budget and n_read < n_miss:
        report["partial"] = {"reason": "budget", "read": n_read, "limit": budget, "done": n_hit + n_read, "total": n_all, "remaining": n_miss - n_read}
    return results, new_cache, report


def shared_budget(stages: list[DataFrame], order: str, budget: int) -> list[DataFrame]:
    """The misses of several stages, cut so that all together are at most `budget`: earlier stages first."""
    out = []
    for misses in stages:
        taken = misses.orderBy(order).limit(budget) if budget > 0 else misses.limit(0)
        out.append(materialize(taken, "taken"))
        budget -= out[-1].count()
    return out


def bad_of(outcomes: DataFrame, path: str = "path") -> DataFrame:
    """(path, error) of the outcomes (path, errno, winerror, error) that tell of failing devices: the dead letters of a run."""
    return outcomes.where(F.col("error").isNotNull() & (classify_error(F.col("errno"), F.col("winerror")) == "device")).select(F.col(path).alias("path"), "error")


def display_rate(events: DataFrame, group: str, ts: str, done: str, seconds: int = 20, least_done: int = 5, least_seconds: int = 3) -> DataFrame:
    """`rate` of work per second over the trailing seconds: null before enough is done and enough time has passed.

    Rows carry running totals. The first row within the window is found by joining slices of time, not by one sorted group.
    """
    span = seconds * 1_000_000
    rows = events.withColumns({"_t": F.unix_micros(F.col(ts).cast("timestamp")), "_d": F.col(done).cast("long")})
    slot = F.floor(F.col("_t") / span)
    firsts = rows.select(group, "_t", "_d", slot.alias("_s")).distinct()
    probe = rows.select(group, "_t", F.explode(F.array(slot, slot - 1)).alias("_s")).distinct()
    near = probe.join(firsts.select(group, F.col("_t").alias("_u"), F.col("_d").alias("_v"), "_s"), [group, "_s"]).where(f"_u <= _t AND _u >= _t - {span}")
    start = near.groupBy(group, "_t").agg(F.min(F.struct("_u", "_v")).alias("_first"))
    out = rows.join(start, [group, "_t"])
    passed, made = (F.col("_t") - F.col("_first._u")) / 1e6, F.col("_d") - F.col("_first._v")
    return out.withColumn("rate", F.when((made >= least_done) & (passed >= least_seconds), made / passed)).drop("_t", "_d", "_first")


class Progress(StreamingQueryListener):
    """Progress events of streaming queries as JSON lines to a function."""

    def __init__(self, tell: Callable[[str], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell(json.dumps({"kind": "started", "id": str(event.id)}))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell(json.dumps({"kind": "progress", "id": str(p.id), "batch": p.batchId, "rows": p.numInputRows}))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell(json.dumps({"kind": "ended", "id": str(event.id), "error": event.exception}))


class Cancellable:
    """Runs actions under a tag of their own, so that another thread can stop exactly them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag = spark, f"quarry-{uuid.uuid4().hex}"

    def __enter__(self) -> Cancellable:
        self.spark.sparkContext.addJobTag(self.tag)
        return self

    def __exit__(self, *_) -> None:
        self.spark.sparkContext.removeJobTag(self.tag)

    def cancel(self) -> None:
        self.spark.sparkContext.cancelJobsWithTag(self.tag)


def breaker_note(longest: Column, total: Column, consecutive: int, most: int) -> Column:
    """Why a breaker tripped; null if it did not."""
    return F.when(F.lit(consecutive > 0) & (longest >= consecutive), F.concat(longest, F.lit(" in a row"))).when(F.lit(most > 0) & (total >= most), F.concat(total, F.lit(" in all")))
