"""Connected components of an edge table, by alternating star contractions.

Each round hangs the larger neighbours of every node on the smallest one (large star), then the smaller ones (small
star). Rounds are logarithmic in the number of nodes; each is written to the shared folder, so a lost executor costs
one round and the lineage stays short. The centre of a large star is a hot key; `join_totals` spreads its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.joins import join_totals
from quarry.session import materialize

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches. Nodes are longs; nulls and loops are ignored.

    Nodes without edges are not in the result. An empty edge table gives an empty result.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    stars = materialize(edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where(x.isNotNull() & y.isNotNull() & (x != y)).distinct(), "edges")
    before, edge_count = None, stars.count()
    for _ in range(MAX_ROUNDS):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = join_totals(both.where("v > u"), least, ["u"], 2 * edge_count).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_totals(large, lowest, ["u"], 2 * edge_count).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = materialize(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, edge_count = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
