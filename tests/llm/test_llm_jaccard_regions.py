"""Large families by Voronoi regions, and what stays of each component, against brute force; rows are counted."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import jaccard


def labels(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def family(seed, n, kinds):
    """Sets around a few centres: dense balls, chains that drift away, and loose sets."""
    rng = np.random.default_rng(seed)
    fresh = lambda k: rng.integers(0, 1 << 62, k, dtype=np.uint64)
    base, sets = fresh(100), []
    centres = [base]
    for _ in range(4):
        c = base.copy()
        c[:45] = fresh(45)
        centres.append(c)
    drift = base.copy()
    for k in range(n):
        kind = kinds[k % len(kinds)]
        s = centres[int(rng.integers(0, 5))].copy()
        if kind == "chain":
            drift = drift.copy()
            drift[rng.integers(0, 100, 5)] = fresh(5)
            s = drift
        else:
            m = int(rng.integers(0, 12 if kind == "dense" else 40))
            s[rng.integers(0, 100, m)] = fresh(m)
        sets.append(np.unique(s))
    return sets


@pytest.mark.parametrize(("seed", "kinds", "block"), [(2, ["dense", "loose"], 25), (4, ["dense", "loose", "chain"], 12)])
def test_families_by_regions_connect_what_links_connect(spark, monkeypatch, seed, kinds, block):
    for name, value in (("BLOCK", block), ("FAR_PIVOTS", 5), ("CANDIDATES", 12), ("SHARE", 30)):
        monkeypatch.setattr(jaccard, name, value)
    sets = [*family(seed, 130, kinds), *family(seed + 50, 60, kinds)]
    component = [1] * 130 + [2] * 60
    rows = [(k, c, bytearray(s.tobytes()), k) for k, (s, c) in enumerate(zip(sets, component, strict=True))]
    members = spark.createDataFrame(rows, jaccard.MEMBER)
    got = {tuple(r) for r in jaccard._family_links(members, members.groupBy("component").agg(F.count("*").alias("n")), 4, 80).collect()}
    inter = np.array([[np.intersect1d(a, b).size for b in sets] for a in sets])
    size = np.array([len(s) for s in sets])
    linked = (100 * inter >= 80 * (size[:, None] + size[None, :] - inter)) & np.equal.outer(component, component)
    assert all(linked[a, b] for a, b in got)
    assert labels(range(190), got) == labels(range(190), zip(*np.nonzero(linked), strict=True))


def test_one_ball_is_done_after_one_pass(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    seen = []
    monkeypatch.setattr(jaccard, "_in_blocks", lambda members, regions, parts, percent: seen.append(members.join(regions, "component").count()) or spark.createDataFrame([], "a long, b long"))
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 200, dtype=np.uint64)
    sets = []
    for _ in range(300):
        s = base.copy()
        s[rng.integers(0, 200, 3)] = rng.integers(0, 1 << 62, 3, dtype=np.uint64)
        sets.append(np.unique(s))
    members = spark.createDataFrame([(k, 1, bytearray(s.tobytes()), k) for k, s in enumerate(sets)], jaccard.MEMBER)
    got = [tuple(r) for r in jaccard._family_links(members, members.groupBy("component").agg(F.count("*").alias("n")), 4, 80).collect()]
    assert set(labels(range(300), got).values()) == {0} and len(got) <= 300 * jaccard.FAR_PIVOTS and sum(seen) == 0


def text(*swapped, n=120):
    return " ".join(f"y{i}" if i in swapped else f"w{i}" for i in range(n))


def test_one_row_of_each_stays(spark):
    other = "quite another text of its own words"
    rows = [
        (1, text(), "a"), (1, text(), "a"), (2, text(), "b"), (3, text(5), "c"),  # repeats, a copy and a near copy
        (4, other, "d"), (4, "and one of another kind altogether, here", "e"),  # one id, two texts
        (7, None, "f"), (7, None, "f"), (8, "", "g"), (8, None, "h"), (None, None, "i"),
        (None, text(7), "j"), (None, "only here without any id at all", "k"), (None, "only here without any id at all", "k"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("node", F.lit(1)).withColumn("none", F.lit(True))
    kept = jaccard.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.lang) for r in kept.collect()) == Counter([(1, "a"), (4, "d"), (4, "e"), (7, "f"), (8, "g"), (8, "h"), (None, "i"), (None, "k")])
    assert jaccard.keep_one_of_each(df.limit(0)).count() == 0


def test_short_pairs_at_the_threshold(spark):
    rng = random.Random(4)
    rows = []
    for k in range(2000):
        w = [f"v{rng.randrange(10**7)}" for _ in range(9)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:8]))]  # 5 and 4 shingles, 4 shared
    got = {r.doc_id: r.component_id for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(got[i] == i - i % 2 for i in got) and len(got) == 4000
