"""Joins with totals: the same rows as a plain join, whether a key is hot or not, and hot keys in many tasks."""

from pyspark.sql import functions as F

from quarry.operators import joins


def test_join_totals(spark, monkeypatch):
    monkeypatch.setattr(joins, "LEAST_HOT", 20)
    rows = spark.range(400).select(F.when(F.col("id") < 300, 7).otherwise(F.col("id") % 20).alias("k"), "id").unionByName(spark.createDataFrame([(None, 1000)], "k long, id long"))
    totals = rows.groupBy("k").agg(F.sum("id").alias("s"), F.count("*").alias("n"))
    got = joins.join_totals(rows, totals, ["k"], 400)
    want = rows.join(totals.drop("n"), "k").select("k", "id", "s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == ["k", "id", "s"]
    spread = joins.join_totals(rows, totals, ["k"], 400).where("k = 7").select(F.spark_partition_id().alias("p"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert spread.distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joins.join_totals(rows.limit(0), totals.limit(0), ["k"], 0).count() == 0
