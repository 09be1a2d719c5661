"""Near duplicates of vectors by sorted projection passes.

Each pass orders the vectors of a label lexicographically by the signs of 64 random projections, written one after the
other. Vectors that point the same way share a long beginning, so they are close in the order; each is compared with
the vectors of its chunk of the order and of the next. Passes use fresh projections, and what one misses another finds.
Links are exact: the cosine is computed in double precision.

Equal vectors of a label are one class with their number from the start: a class takes part once, its links count as many times as
it has members, and its members link with each other. So a vector that a third of all rows hold is one row of every pass.

A dense region, of which the links fill the end of the next chunk, is followed from chunk to chunk as long as they do, so
that bounded windows lose nothing there. A pair is counted in the first pass that compares it: every vector
carries its chunks of the earlier passes. Pairs never leave their task; it hands on a number of links for each vector
and the few edges that connect what is linked.

Recall at cosine 0.98: neighbouring signs differ with probability 0.064, so a pair shares its first b signs in a pass
with probability 0.936^b, and b = log2(vectors of a label / 512) suffices with chunks of 512. The number of passes follows
from the largest label, so that all passes miss a sparse pair at most 1 in 700 at every size: 8 up to 131,072 vectors of a
label, 10 at 1,000,000, 15 at 10,000,000.

Defined results: null vectors, those with null or non-finite components, zero vectors and null labels link with nothing
and are their own component; vectors of different length don't link; repeated rows count as vectors of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import pieces
from quarry.operators.components import connected_components
from quarry.operators.joins import join_totals
from quarry.session import materialize

PASSES = 8  # the fewest
MISS = 1 / 700
CHUNK = 512
DENSE = 16
THRESHOLD = 0.98
SEED = 11


def passes_for(n: int, threshold: float = THRESHOLD) -> int:
    """Passes after which a pair at the threshold is missed with probability MISS or less among n vectors of a label."""
    alike = max(1, math.ceil(math.log2(max(1, n) / CHUNK)))
    share = (1 - math.acos(min(1.0, threshold)) / math.pi) ** alike
    return PASSES if share >= 1 else max(PASSES, math.ceil(math.log(MISS) / math.log1p(-share)))


def projections(dim: int, number: int) -> np.ndarray:
    """64 random directions for a pass."""
    return np.random.default_rng((SEED, number, dim)).standard_normal((dim, 64))


def signs(x: np.ndarray, number: int) -> np.ndarray:
    """The signs of the projections of each row as one signed number, of which the order is the lexicographic one."""
    bits = (x @ projections(x.shape[1], number)) > 0
    return np.packbits(bits, axis=1).view(">u8")[:, 0].astype(np.uint64).view(np.int64) ^ np.int64(-(1 << 63))


def _prepared(df: DataFrame, passes: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows (uid, vec_id, label, dim, unit, h0..): usable vectors scaled to length 1; dim is 0 for the others."""
    rows = df.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v")
    )

    def run(batches):
        for b in pieces(batches, 4096):
            n = b.num_rows
            dims, units, keys = np.zeros(n, np.int32), [b""] * n, np.zeros((n, passes), np.int64)
            labels, vectors = b.column(2), b.column(3)
            by_dim: dict[int, list[int]] = {}
            lengths = vectors.value_lengths().to_pylist()
            for i in range(n):
                if labels[i].is_valid and lengths[i]:
                    by_dim.setdefault(lengths[i], []).append(i)
            for dim, at in by_dim.items():
                some = vectors.take(pa.array(at))
                x = some.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
                with np.errstate(all="ignore"):
                    peak = np.abs(x).max(axis=1)
                    good = np.isfinite(x).all(axis=1) & (peak > 0)
                    x = x[good] / peak[good, None]
                    x = x / np.linalg.norm(x, axis=1)[:, None]
                at = np.array(at)[good]
                dims[at] = dim
                for i, row in zip(at.tolist(), x, strict=True):
                    units[i] = row.tobytes()
                for p in range(passes):
                    if len(at):
                        keys[at, p] = signs(x, p)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), labels, pa.array(dims), pa.array(units, pa.binary()), *(pa.array(keys[:, p]) for p in range(passes))], ["uid", "vec_id", "label", "dim", "unit", *(f"h{p}" for p in range(passes))]
            )

    return rows.mapInArrow(run, "uid long, vec_id long, label string, dim int, unit binary, " + ", ".join(f"h{p} long" for p in range(passes)))


def _classes(every: DataFrame) -> DataFrame:
    """A row for each distinct vector of a label: the smallest uid, its fields, and the number of its members."""
    fields = [c for c in every.columns if c not in ("vec_id", "class")]
    first = every.where("dim > 0").groupBy("class").agg(F.min(F.struct(*fields)).alias("first"), F.count("*").alias("members"))
    return materialize(first.select("class", "first.*", "members"), "distinct")


def _ranked(rows: DataFrame, number: int, parts: int) -> DataFrame:
    """`rows` with c<number>, the chunk of each in the order of the pass, numbered over the whole table."""
    order = ["label", "dim", f"h{number}", "uid"]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = materialize(placed, f"pass{number}")
    base, n = [], 0
    for r in placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # one number for each task
        base.append((r["part"], n))
        n += r["n"]
    starts = F.broadcast(rows.sparkSession.createDataFrame(base, "part int, start long"))  # one row for each task
    rank = F.col("start") + F.col("at")
    placed = placed.drop("place").join(starts, "part")
    return placed.withColumns({f"c{number}": F.floor(rank / CHUNK).cast("long"), "place": (rank % CHUNK).cast("int")}).drop("part", "at", "start", f"h{number}")


def _compared(rows: DataFrame, number: int, gap: int, active: set[int] | None, far: list[set[tuple[int, int]]], threshold: float, parts: int) -> DataFrame:
    """(uid, links, a, b, reach): the links between each chunk and the one `gap` behind it (with gap 1, also within it).

    Rows with uid count links that no earlier pass has compared; rows with a and b connect; `reach` names chunks of
    which the links go on: at least DENSE of them with the last quarter of the other chunk. `far`: the pairs of chunks beyond neighbours that each pass has compared.
    """
    c = F.col(f"c{number}")
    earlier = [f"c{p}" for p in range(number)]
    own = F.struct(c.alias("g"), F.lit(0).alias("side"))
    other = F.struct((c - gap).alias("g"), F.lit(1).alias("side"))
    dealt = rows.select("uid", "label", "dim", "unit", "place", "members", *earlier, F.explode(F.array(own, other)).alias("p")).select("p.g", "p.side", "uid", "label", "dim", "unit", "place", "members", *earlier).where("g >= 0")
    if active is not None:
        dealt = dealt.where(F.col("g").isin(sorted(active)))
    dealt = dealt.repartition(parts, "g").sortWithinPartitions("g", "side", "label", "uid")

    def compare(g, side, uid, label, dim, unit, place, members, chunks):
        side, uid, place, members = np.array(side), np.array(uid), np.array(place), np.array(members)
        count, edges, far_end = np.zeros(len(uid), np.int64), [], 0
        groups: dict[tuple, list[int]] = {}
        for i, k in enumerate(zip(label, dim, strict=True)):
            groups.setdefault(k, []).append(i)
        for (_, d), at in groups.items():
            at = np.array(at)
            left, right = at[side[at] == 0], at
            if gap > 1:
                right = at[side[at] == 1]
            if not len(left) or not len(right):
                continue
            x = np.frombuffer(b"".join(unit[i] for i in left), float).reshape(-1, d)
            y = np.frombuffer(b"".join(unit[i] for i in right), float).reshape(-1, d)
            hit = x @ y.T >= threshold
            hit &= ~((side[right] == 0)[None, :] & (left[:, None] >= right[None, :]))
            i, j = np.nonzero(hit)
            if not len(i):
                continue
            i, j = left[i], right[j]
            far_end += int(((side[j] == 1) & (place[j] >= CHUNK * 3 // 4)).sum())
            parent: dict[int, int] = {}

            def root(k, parent=parent):
                while parent.get(k, k) != k:
                    parent[k] = parent.get(parent[k], parent[k])
                    k = parent[k]
                return k

            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    edges.append((int(uid[a]), int(uid[b])))
            fresh = np.ones(len(i), bool)
            for p, chunk in enumerate(chunks):
                chunk = np.array(chunk)
                step = np.abs(chunk[i] - chunk[j])
                fresh &= step > 1
                if far[p]:
                    for k in np.flatnonzero(fresh):
                        if (int(min(chunk[i[k]], chunk[j[k]])), int(step[k])) in far[p]:
                            fresh[k] = False
            np.add.at(count, i[fresh], members[j[fresh]])
            np.add.at(count, j[fresh], members[i[fresh]])
        reach = far_end >= min(DENSE, CHUNK // 8)
        some = np.flatnonzero(count)
        n, m = len(some), len(edges)
        none = [None]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(uid[some].tolist() + none * (m + reach), pa.int64()), pa.array(count[some].tolist() + none * (m + reach), pa.int64()),
                pa.array(none * n + [a for a, _ in edges] + none * reach, pa.int64()), pa.array(none * n + [b for _, b in edges] + none * reach, pa.int64()), pa.array(none * (n + m) + [g] * reach, pa.int64()),
            ],
            ["uid", "links", "a", "b", "reach"],
        )

    def run(batches):
        at, held = None, [[] for _ in range(7 + len(earlier))]
        for b in pieces(batches, 1024):
            for g, *values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g != at and held[0]:
                    yield compare(at, *held[:7], held[7:])
                    held = [[] for _ in held]
                at = g
                for column, value in zip(held, values, strict=True):
                    column.append(value)
        if held[0]:
            yield compare(at, *held[:7], held[7:])

    return dealt.mapInArrow(run, "uid long, links long, a long, b long, reach long")


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, passes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row. The passes follow from the largest label unless they are given."""
    spark = df.sparkSession
    if passes is None:
        largest = df.where(F.col(label_col).isNotNull()).groupBy(F.col(label_col).cast("string").alias("label")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        passes = passes_for(largest or 0, threshold)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    prepared = _prepared(df, passes, id_col, vector_col, label_col).withColumn("class", F.when(F.col("dim") > 0, F.sha2(F.concat(F.encode("label", "utf-8"), F.lit(b"\0"), F.col("unit")), 256)))
    every = materialize(prepared, "vectors")
    classes = _classes(every)
    rows, found, far = classes.drop("class").withColumn("place", F.lit(0)), None, []
    for number in range(passes):
        rows = _ranked(rows, number, parts)
        gap, active, followed = 1, None, set()
        while True:
            got = materialize(_compared(rows, number, gap, active, far, threshold, parts), f"links{number}_{gap}")
            found = got if found is None else found.unionByName(got)
            reach = {r["reach"] for r in got.where("reach IS NOT NULL").select("reach").distinct().collect()}  # chunks of dense regions
            if not reach:
                break
            gap, active = gap + 1, reach
            followed |= {(g, gap) for g in active}
        far.append(followed)
    links = found.where("uid IS NOT NULL").groupBy("uid").agg(F.sum("links").alias("n_links"))
    joined = connected_components(found.where("a IS NOT NULL").select("a", "b"))
    of_class = classes.select("class", "uid", "members").join(links, "uid", "left").join(joined, F.col("uid") == F.col("node"), "left")
    of_class = materialize(of_class.select("class", (F.coalesce("n_links", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component", "uid").alias("root"), "members"), "classes")
    usable = join_totals(every.where("class IS NOT NULL").select("vec_id", "class"), of_class, ["class"], every.count(), "members").select("vec_id", "n_links", "root")
    alone = every.where("class IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("uid").alias("root"))
    own = materialize(usable.unionByName(alone), "linked")
    lowest = own.groupBy("root").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("n"))
    return join_totals(own, lowest, ["root"], own.count()).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
