"""Components and what is kept of vectors against brute force."""

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import vectors


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, at = [], 0
    for label in (1, 2, None):
        start = rng.standard_normal(24)
        for _ in range(60):  # a chain that drifts, so that components are longer than links
            start = start + 0.05 * rng.standard_normal(24)
            rows.append((1000 - at, start.tolist(), label))
            at += 1
        for _ in range(40):
            rows.append((1000 - at, rng.standard_normal(24).tolist(), label))
            at += 1
    rows += [(2000, rows[0][1], 1), (2001, rows[0][1], 1), (2002, None, 1), (2003, rows[0][1], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"links": F.lit(1), "uid": F.lit(2)})
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    x = [np.array(e) / np.linalg.norm(e) if e else None for _, e, _ in rows]
    label = {r[0]: r[0] for r in rows}
    links = {r[0]: 0 for r in rows}
    pairs = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if x[i] is not None and x[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and x[i] @ x[j] >= 0.98]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in rows:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert {k: (r.n_links, r.component_id, r.kept) for k, r in got.items()} == {k: (links[k], label[k], label[k] == k) for k in label}
    assert len(pairs) > 100 and len(set(label.values())) < len(rows) - 50
