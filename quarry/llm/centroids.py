"""Lloyd's clustering of quantised vectors on distinct vectors with multiplicities.

Components become integers, floor(scale * x), so equal vectors are equal to the bit and every sum is exact: results don't
depend on how rows are dealt. Identical quantised vectors are grouped with partial sums and get a multiplicity, so a vector that
a third of all rows hold is one row. Each round sends the centroids (k rows) to all tasks; a task assigns its distinct vectors and
hands on, for each cluster, the weighted sums of the components. The driver sees those k totals only. In the end the
assignments of distinct vectors are joined back to the ids by the digest of the vector; digests with very many ids are sent to all
tasks (`join_totals`).

Defined results: vectors that are null, have another number of components, or hold null or non-finite components are left out;
repeated rows count as vectors of their own; of equal ids the vector of smaller bytes comes first as a starting centroid, and
null ids come last; fewer rows than k give fewer centroids; an empty table gives no rows. A squared distance must fit a long, so
quantised components beyond 2**27 take that bound, with their sign.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import pieces
from quarry.operators.joins import join_totals
from quarry.session import materialize

K, DIM, SCALE, ROUNDS, SALT = 40, 64, 256, 5, "2:"
BOUND = 1 << 27  # of quantised components
FLOAT_EXACT = 1 << 22  # up to here 64 products fit the 53 bits of a double
BATCH = 4096


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, q, key) of the usable rows: `dim` little-endian 32-bit integers, and their digest."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.size("v") == dim)

    def run(batches):
        for b in pieces(batches, BATCH):
            flat = b.column(1).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)  # nulls are NaN
            good = np.flatnonzero(np.isfinite(x).all(axis=1))
            with np.errstate(over="ignore"):
                q = np.clip(np.floor(scale * x[good]), -BOUND, BOUND).astype("<i4")
            held = [r.tobytes() for r in q]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(good)), pa.array(held, pa.binary()), pa.array([hashlib.sha256(h).digest() for h in held], pa.binary())], ["vec_id", "q", "key"])

    return rows.mapInArrow(run, "vec_id long, q binary, key binary")


def distances(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids as exact integers."""
    x, c = q.astype(np.int64), centroids.astype(np.int64)
    small = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0))) <= FLOAT_EXACT and x.shape[1] <= 64
    if small:
        return (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (q.astype(float) @ c.T.astype(float)).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)


def _read(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim)


def _sums(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, sums, inertia): what a task found for each cluster."""
    k, dim = centroids.shape

    def run(batches):
        n, sums, inertia = [0] * k, np.zeros((k, dim), object), [0] * k
        for b in pieces(batches, BATCH):
            q, weight = _read(b.column(0), dim), b.column(1).to_numpy()
            d = distances(q, centroids)
            nearest = d.argmin(axis=1)  # the first of equals
            for c in np.unique(nearest):
                at = np.flatnonzero(nearest == c)
                n[c] += int(weight[at].sum())
                wide = int(np.abs(q[at]).max()) * int(weight[at].sum()) >= 1 << 62
                sums[c] += (q[at].astype(object) * weight[at].astype(object)[:, None]).sum(axis=0) if wide else (q[at].astype(np.int64) * weight[at][:, None]).sum(axis=0).astype(object)
                inertia[c] += sum(int(a) * int(w) for a, w in zip(d[at, c], weight[at], strict=True))
        some = [c for c in range(k) if n[c]]
        as_text = lambda row: [str(int(v)) for v in row]  # noqa: E731  sums may pass 64 bits
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([n[c] for c in some], pa.int64()), pa.array([as_text(sums[c]) for c in some], pa.list_(pa.string())), pa.array([str(inertia[c]) for c in some], pa.string())], ["cluster", "n", "sums", "inertia"])

    found = distinct.select("q", "n").mapInArrow(run, "cluster int, n long, sums array<string>, inertia string")
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
    return found.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("inertia").cast("decimal(38,0)")).alias("inertia"), *total)


def starts(rows: DataFrame, k: int = K, salt: str = SALT) -> np.ndarray:
    """The vectors of the k rows whose salted ids have the smallest digests, in that order."""
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = rows.select(order.alias("h"), "q").orderBy(F.col("h").asc_nulls_last(), "q").limit(k).collect()  # k rows
    return np.array([np.frombuffer(bytes(r["q"]), "<i4") for r in first], dtype=np.int64)


def cluster(
    df: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = SALT, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable row, and the final centroids."""
    spark = df.sparkSession
    shape = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    read = quantised(df, id_col, vector_col, dim, scale)
    rows = materialize(read, "quantised")
    distinct = materialize(rows.groupBy("key").agg(F.first("q").alias("q"), F.count("*").alias("n")), "distinct")  # equal keys have equal vectors
    centroids = starts(rows, k, salt)
    if not len(centroids):
        return spark.createDataFrame([], shape), centroids
    for _ in range(rounds):
        for r in _sums(distinct, centroids).collect():  # k rows at most
            centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dim)]
    totals = {r["cluster"]: int(r["inertia"]) for r in _sums(distinct, centroids).select("cluster", "inertia").collect()}
    digest = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, t, sum(totals.values()), digest[c]) for c, t in totals.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")

    def assign(batches):
        for b in pieces(batches, BATCH):
            d = distances(_read(b.column(1), dim), centroids)
            nearest = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nearest, pa.int32()), pa.array(d[np.arange(len(nearest)), nearest], pa.int64()), b.column(2)], ["key", "cluster", "distance", "n"])

    assigned = distinct.select("key", "q", "n").mapInArrow(assign, "key binary, cluster int, distance long, n long")
    back = join_totals(rows.select("vec_id", "key"), assigned, ["key"], rows.count())
    out = back.join(F.broadcast(facts), "cluster")  # k rows at most
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
