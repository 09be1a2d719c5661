"""Joins with totals of keys, of which some may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS, LEAST_HOT = 10_000, 1_000


def join_totals(rows: DataFrame, totals: DataFrame, keys: list[str], most: int, count: str = "n") -> DataFrame:
    """`rows` with the columns of `totals`, which has a row for each key with its number of rows; null keys get none and go.

    `most` is the number of rows or more. Keys of more than 1/HOT_KEYS of those are HOT_KEYS at most, so their totals are
    sent to all tasks, and their rows are dealt out by their content; other keys are joined by a shuffle.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = [c for c in totals.columns if c not in keys and c != count]
    held = totals.select(*keys, F.struct(*names).alias("_total"), count)
    hot = F.broadcast(held.where(F.col(count) > max(LEAST_HOT, most // HOT_KEYS)).select(*keys, F.col("_total").alias("_hot")))  # at most HOT_KEYS rows
    salted = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(parts))).cast("int"))
    # A literal 0 would be folded into a condition, and rows of a hot key would meet in one task after all.
    found = salted.join(held.select(*keys, "_total", (F.col(count) % 1).cast("int").alias("_salt")), [*keys, "_salt"], "left").withColumn("_total", F.coalesce("_hot", "_total"))
    return found.where("_total IS NOT NULL").select(*rows.columns, *(F.col(f"_total.{c}").alias(c) for c in names))
