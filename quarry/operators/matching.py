"""Matches between rows: shared sentences, bags of members, containment, n-gram candidates and fuzzy pairs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import char_grams, sentence_array
from quarry.session import materialize


def sentence_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sentence, n): a row for each distinct sentence, and the row's number of them. The text is left behind."""
    arrays = df.select(key, sentence_array(F.col(text)).alias("s")).where(F.size("s") > 0)
    return arrays.select(key, F.size("s").alias("n"), F.explode("s").alias("sentence"))


def reference_matches(targets: DataFrame, key: str, text: str, reference: DataFrame, ref_key: str, ref_text: str) -> DataFrame:
    """(key, match_count, sentence_count, match_ratio): sentences of each target that the reference holds, too."""
    known = sentence_rows(reference, ref_key, ref_text).select("sentence").distinct()
    met = sentence_rows(targets, key, text).join(known, "sentence", "left_semi")
    counts = met.groupBy(key).agg(F.count("*").alias("match_count"), F.max("n").cast("long").alias("sentence_count"))
    return counts.withColumn("match_ratio", F.round(F.col("match_count") * 100.0 / F.col("sentence_count"), 1))


def reference_report(targets: DataFrame, key: str, text: str, reference: DataFrame, ref_key: str, ref_text: str, names: int = 4, sentences: int = 3, width: int = 220) -> DataFrame:
    """`reference_matches` with the first `names` sources of what was met, their number, and a preview of the first sentences.

    Of each sentence only the first sources are carried, which is enough for the first of all; a target holds few sentences.
    """
    known = sentence_rows(reference, ref_key, ref_text).select("sentence", F.col(ref_key).cast("string").alias("source")).distinct()
    place = F.row_number().over(W.partitionBy("sentence").orderBy("source"))
    first = known.withColumn("_r", place).where(F.col("_r") <= names).drop("_r")
    met = sentence_rows(targets, key, text).join(first, "sentence")
    out = met.groupBy(key).agg(F.count_distinct("sentence").alias("match_count"), F.max("n").cast("long").alias("sentence_count"), F.array_sort(F.collect_set("source")).alias("_s"), F.array_sort(F.collect_set("sentence")).alias("_t"))
    preview = F.substring(F.array_join(F.slice("_t", 1, sentences), " / "), 1, width)
    ratio = F.round(F.col("match_count") * 100.0 / F.greatest("sentence_count", F.lit(1)), 1)
    return out.select(key, "match_count", "sentence_count", ratio.alias("match_ratio"), F.array_join(F.slice("_s", 1, names), ", ").alias("sources"), preview.alias("preview"))


def reference_order(key: str) -> list:
    """Most matches first, then the largest share, then by lower-cased key."""
    return [F.desc("match_count"), F.desc("match_ratio"), F.lower(F.col(key).cast("string"))]


def sentence_overlaps(left: DataFrame, lid: str, ltext: str, right: DataFrame, rid: str, rtext: str) -> DataFrame:
    """(lid, rid, common, overlap, left_coverage, right_coverage) for pairs that share sentences, in percent; overlap is that of the smaller side."""
    x, y = sentence_rows(left, lid, ltext), sentence_rows(right, rid, rtext).withColumnRenamed("n", "m")
    met = x.join(y, "sentence").groupBy(lid, rid).agg(F.count("*").alias("common"), F.first("n").alias("n"), F.first("m").alias("m"))
    percent = lambda whole: F.round(F.col("common") * 100.0 / whole, 1)
    return met.select(lid, rid, "common", percent(F.least("n", "m")).alias("overlap"), percent(F.col("n")).alias("left_coverage"), percent(F.col("m")).alias("right_coverage"))


def gram_candidates(left: DataFrame, lid: str, ltext: str, right: DataFrame, rid: str, rtext: str, n: int = 4, top: int = 8, least: float = 0.12, within: bool = False) -> DataFrame:
    """(lid, rid, shared, overlap): for each left text the `top` right texts by shared character n-grams.

    `overlap` is the share of the smaller set; ties go to the smaller right id. With `within`, both sides are one table,
    and no text is its own candidate.

    Grams that most texts hold are not joined: at first every gram of a left text meets the first `top` right texts that have it, which gives
    as many candidates, and so a number K of shared grams that the last of them has at least. A right text that is not found by
    the others shares the K - 1 most frequent grams at most, which is too few; so the left text's other grams, rarest first, are all that
    is joined in full. Pairs found are counted exactly.
    """
    grams = lambda df, key, text, name: materialize(df.select(F.col(key), F.array_distinct(char_grams(F.col(text), n)).alias(name)).where(F.size(name) > 0), name)
    a, b = grams(left, lid, ltext, "ga"), grams(right, rid, rtext, "gb")
    held = b.select(rid, F.explode("gb").alias("gram"))
    freq = held.groupBy("gram").agg(F.count("*").alias("f"))
    own = a.select(lid, F.size("ga").alias("na"), F.explode("ga").alias("gram")).join(freq, "gram")  # grams that no right text has are left out
    own = materialize(own.withColumn("place", F.row_number().over(W.partitionBy(lid).orderBy("f", "gram"))), "own")
    total = own.groupBy(lid).agg(F.count("*").alias("nf"))
    more = top + 1 if within else top  # one of the first may be the text itself
    first = held.withColumn("_r", F.row_number().over(W.partitionBy("gram").orderBy(rid))).where(F.col("_r") <= more).drop("_r")
    other = (F.col(lid) != F.col(rid)) if within else F.lit(True)

    def counted(pairs: DataFrame) -> DataFrame:
        met = pairs.join(a, lid).join(b, rid)
        return met.select(lid, rid, F.size(F.array_intersect("ga", "gb")).cast("long").alias("shared"), F.size("ga").alias("na"), F.size("gb").alias("nb"))

    some = materialize(counted(own.join(first, "gram").where(other).select(lid, rid).distinct()), "some")
    place = F.row_number().over(W.partitionBy(lid).orderBy(F.desc("shared"), rid))
    kth = some.withColumn("_r", place).where(F.col("_r") == top).select(lid, F.col("shared").alias("k"))
    # Without as many candidates, all texts that share a gram are among them already.
    reach = total.join(kth, lid).select(lid, F.when(F.col("k") <= 1, F.col("nf") - 1).otherwise(F.col("nf") - F.col("k") + 1).alias("reach"))
    probes = own.join(reach, lid).where(F.col("place") <= F.col("reach")).select(lid, "gram")
    fresh = probes.join(held, "gram").where(other).select(lid, rid).distinct().join(some.select(lid, rid), [lid, rid], "left_anti")
    met = some.unionByName(counted(fresh)).withColumn("overlap", F.col("shared") / F.least("na", "nb"))
    return met.withColumn("_r", place).where((F.col("_r") <= top) & (F.col("overlap") >= least)).select(lid, rid, "shared", F.round("overlap", 6).alias("overlap"))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 M / T of the matching blocks of two texts."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def greedy_pairs(scored: DataFrame, group: str, left: str, right: str, score: str, least: float = 0.28, most: int = 24) -> DataFrame:
    """One-to-one pairs of each group, best score first; ties go to the larger left, then right number."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        used_left, used_right, out = set(), set(), []
        for row in pdf[pdf[score] >= least].sort_values([score, left, right], ascending=False).itertuples(index=False):
            a, b = getattr(row, left), getattr(row, right)
            if a not in used_left and b not in used_right and len(out) < most:
                used_left.add(a)
                used_right.add(b)
                out.append(row)
        return pd.DataFrame(out, columns=pdf.columns)

    return scored.groupBy(group).applyInPandas(choose, scored.schema)


def pairs_in_turn(scored: DataFrame, group: list[str], left: str, right: str, score: str) -> DataFrame:
    """One-to-one pairs of each group: every left row in its order takes the best right one that is free, of equals the first.

    Each left row asks for its best; of those that ask for one right row the first keeps it, and later ones give it up for good. That is
    repeated until no two ask for the same, a join a round, so no group is worked through in one task.
    """
    rows = materialize(scored.select(*group, left, right, score), "asking")
    while True:
        best = rows.groupBy(*group, left).agg(F.min(F.struct((-F.col(score)).alias("less"), F.col(right).alias(right))).alias("_b"))
        asked = materialize(best.select(*group, left, F.col(f"_b.{right}").alias(right), (-F.col("_b.less")).alias(score)), "asked")
        holder = asked.groupBy(*group, right).agg(F.min(left).alias("_holder"), F.count("*").alias("_n"))
        if holder.where("_n > 1").isEmpty():
            return asked
        rows = materialize(rows.join(holder.drop("_n"), [*group, right], "left").where(F.col("_holder").isNull() | (F.col(left) <= F.col("_holder"))).drop("_holder"), "asking")


def full_compare(a: DataFrame, b: DataFrame, key: str, *values: str) -> DataFrame:
    """(key, status): same, changed, left only or right only, by a full outer join on the key."""
    x, y = a.select(key, F.struct(*values).alias("_x")), b.select(key, F.struct(*values).alias("_y"))
    status = F.when(F.col("_y").isNull(), "left_only").when(F.col("_x").isNull(), "right_only").when(F.col("_x") == F.col("_y"), "same").otherwise("changed")
    return x.join(y, key, "full_outer").select(key, status.alias("status"))
