"""Clusters against plain Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from quarry.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, q string, key long, n int, cluster int, label string"


def plain(rows, k, rounds, dim, scale, salt):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-centroids.BOUND, min(centroids.BOUND, math.floor(scale * float(np.float32(x))))) for x in v]))
    name = lambda i: "~" if i is None else hashlib.sha256(f"{salt}{i}".encode()).hexdigest()
    c = [q for _, q in sorted(kept, key=lambda r: (name(r[0]), np.array(r[1], "<i4").tobytes()))[:k]]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda x: min((far(x, y), j) for j, y in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        for j, qs in groups.items():
            c[j] = [sum(col) // len(qs) for col in zip(*qs, strict=True)]
    got = [(i, *near(q)) for i, q in kept]
    total = {j: sum(d for _, d, at in got if at == j) for j in range(len(c))}
    return sorted(((i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in got), key=repr)


def table(kind):
    rng = random.Random(8)
    if kind == "empty":
        return []
    centres = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(5)]
    rows = [(k, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)]) for k in range(300)]
    rows += [(300 + k, rows[0][1]) for k in range(150)]  # a hot vector
    rows += [(7, rows[7][1]), (7, rows[9][1]), (None, rows[11][1]), (None, rows[12][1])]  # repeated and null ids
    rows += [(900, None), (901, []), (902, [1.0] * 7), (903, [1.0] * 9), (904, [None] + [1.0] * 7), (905, [math.nan] * 8), (906, [math.inf] + [0.0] * 7), (907, [0.0] * 8), (908, [-0.0] * 8)]
    rows += [(909, [1e30] * 8), (910, [-1e30] + [5.0] * 7), (911, [70_000.5] * 8)] if kind == "wide" else []
    return rows[:3] if kind == "few" else rows


@pytest.mark.parametrize("kind", ["usual", "wide", "few", "empty"])
def test_clusters_equal_a_plain_version(spark, kind):
    rows = table(kind)
    df = spark.createDataFrame([(i, v, "x", 1, 2, 3, None) for i, v in rows], SCHEMA).repartition(4)
    found, last = centroids.cluster(df, k=6, rounds=3, dim=8)
    want = plain(rows, 6, 3, 8, 256, "2:") if rows else []
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert len(last) == min(6, len(rows))


def test_an_empty_cluster_keeps_its_centroid(spark):
    rows = [(k, [0.0, 0.0]) for k in range(5)] + [(9, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, last = centroids.cluster(df, k=4, rounds=2, dim=2)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain(rows, 4, 2, 2, 256, "2:") and len(last) == 4


def test_distances_are_exact_beyond_doubles():
    q = np.array([[1 << 27, 3], [-(1 << 27), 1]], np.int64)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, c, strict=True)) for c in q] for x in q]
    assert centroids.distances(q, q).tolist() == want
