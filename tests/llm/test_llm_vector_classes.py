"""Equal vectors as classes: links and components as if every copy stood for itself."""

import random

import numpy as np

from quarry.llm import vectors


def test_many_copies(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 16)
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(30)]
    near = [[x + rng.gauss(0, 0.02) for x in base[0]] for _ in range(20)]
    rows = [(k, v, "a") for k, v in enumerate(base + near + [base[3]] * 120 + [base[0]] * 40 + [[2 * x for x in base[3]]] * 3)]
    rows += [(1000 + k, base[3], label) for k, label in enumerate(["b", "b", None, None])] + [(None, base[3], "b"), (5, base[3], "a"), (2000, [0.0] * 8, "a"), (2001, [0.0] * 8, "a")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(4)
    x = np.array([v for _, v, _ in rows])
    norm = np.linalg.norm(x, axis=1)
    unit = np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0)
    same = np.array([[a is not None and a == b for *_, b in rows] for *_, a in rows])
    link = (unit @ unit.T >= 0.98) & same & ~np.eye(len(rows), dtype=bool)
    root = list(range(len(rows)))
    for i, j in zip(*np.nonzero(link), strict=True):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root] if a != b else root
    ids = [i for i, *_ in rows]
    least = {r: min((ids[k] for k in range(len(rows)) if root[k] == r and ids[k] is not None), default=None) for r in set(root)}
    want = sorted(((ids[k], int(link[k].sum()), least[root[k]]) for k in range(len(rows))), key=repr)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()), key=repr) == want
