"""Groups of equal keys, survivors, group numbers, and the splitting of groups by volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.joins import join_totals
from quarry.session import materialize


def groups_of(df: DataFrame, *keys: str, least: int = 2, name: str = "copies") -> DataFrame:
    """Rows whose keys occur `least` times or more, with that number. The keys are counted first, with partial sums, so
    that the wide rows of keys that occur once are not moved for a window; null keys form no group."""
    counts = df.groupBy(*keys).agg(F.count("*").alias(name)).where(F.col(name) >= least)
    return df.join(counts, list(keys))


def same_content(df: DataFrame, size: str, content: str, *also: str) -> DataFrame:
    """Rows that share size, SHA-256 of the content (`sha`) and `also`, without the content.

    The content is hashed where it is read and never moved. For files, take the candidates of `groups_of(listing, size)`
    first, so that only files of a size that occurs twice are opened.
    """
    hashed = df.withColumn("sha", F.sha2(F.col(content).cast("binary"), 256)).drop(content)
    return groups_of(hashed.where("sha IS NOT NULL"), size, "sha", *also)


Order = Column | str | tuple[Column | str, str]  # a column, or a column with "asc" or "desc"
_HEX = "0123456789ABCDEF"


def _descending(df: DataFrame, c: Column) -> Column:
    """A value of which the ascending order is the descending one of the column."""
    kind = df.select(c.alias("c")).schema[0].dataType
    if isinstance(kind, T.StringType | T.BinaryType):  # digits turned round; what ends first comes last
        return F.concat(F.translate(F.hex(c.cast("binary")), _HEX, _HEX[::-1]), F.lit("~"))
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return -F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return -F.unix_date(c)
    if isinstance(kind, T.BooleanType):
        return ~c
    return F.bitwise_not(c) if isinstance(kind, T.IntegralType) else -c


def place_of(df: DataFrame, order: list[Order]) -> Column:
    """A struct that sorts ascending as the columns of the order do, each in its direction, nulls last."""
    parts = []
    for o in order:
        c, direction = o if isinstance(o, tuple) else (o, "asc")
        c = F.col(c) if isinstance(c, str) else c
        if direction not in ("asc", "desc"):
            raise ValueError(f"no such direction: {direction}")
        parts += [c.isNull(), c if direction == "asc" else _descending(df, c)]
    return F.struct(*parts)


def survivor(df: DataFrame, group: list[str], order: list[Order], name: str = "keep") -> DataFrame:
    """Marks the first row of each group in the order, which should be total: of equal rows all may be marked.

    Groups are not sorted: the least of each is found with partial sums and joined back, so a group of very many rows is no single
    task's. `df` is read twice then; write it first where it is dear. Rows of null keys are left out.
    """
    place = place_of(df, order)
    best = df.groupBy(*group).agg(F.min(place).alias("_first"), F.count("*").alias("n"))
    return join_totals(df, best, group, df.count()).withColumn(name, place == F.col("_first")).drop("_first")


def ranked(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """`df` with its place, from 1, in the order of the columns, without one task that sees all rows.

    Rows are dealt into ranges and sorted there; each range starts where those before it end.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": local})
    placed = materialize(placed, "ranges")
    before = F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = placed.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(before, F.lit(0)).alias("_start"))  # a row for each range
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at") + 1).drop("_part", "_at", "_start")


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "grp") -> DataFrame:
    """Dense numbers for the groups in the order of the aggregates `order`, ties by the keys."""
    heads = df.groupBy(*keys).agg(*(c.alias(f"_o{i}") for i, c in enumerate(order)))
    numbers = ranked(heads, [*(f"_o{i}" for i in range(len(order))), *keys], name)
    return df.join(numbers.select(*keys, name), keys)


def split_by_volume(df: DataFrame, group: str, signature: str, name: str = "part") -> DataFrame:
    """Groups with two or more marks fall apart by mark, rows without one together; other groups stay whole."""
    mark = F.nullif(F.col(signature), F.lit(""))
    mixed = df.groupBy(group).agg((F.min(mark) != F.max(mark)).alias("_mixed"))
    return df.join(mixed, group).withColumn(name, F.when(F.col("_mixed"), F.coalesce(signature, F.lit(""))).otherwise("")).drop("_mixed")


def whole_groups_matching(df: DataFrame, group: list[str], test: Column) -> DataFrame:
    """All rows of the groups in which any row passes the test."""
    hits = df.where(test).select(*group).distinct()
    return df.join(hits, group, "left_semi")


def modes(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): the most frequent value of each key; ties go to the first in lower case, then to the first."""
    counts = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), F.lower(value), value))
    return counts.withColumn("_r", rank).where("_r = 1").drop("_r")


def rechosen(df: DataFrame, group: str, key: str, chosen: DataFrame) -> DataFrame:
    """`df` (group, key, keep) with the survivors that `chosen` (group, key) names; other groups keep theirs.

    A choice that is not in its group changes nothing.
    """
    valid = chosen.select(group, key).join(df.select(group, key), [group, key], "left_semi").groupBy(group).agg(F.min(key).alias("_chosen"))
    return df.join(valid, group, "left").withColumn("keep", F.when(F.col("_chosen").isNull(), F.col("keep")).otherwise(F.col(key) == F.col("_chosen"))).drop("_chosen")


def without_moved(df: DataFrame, moved: DataFrame, key: str, group: str) -> DataFrame:
    """`df` without the rows that were moved and without groups that are left with one row."""
    left = df.join(moved.select(key).distinct(), key, "left_anti")
    return groups_of(left, group, name="_n").drop("_n").select(*df.columns)
