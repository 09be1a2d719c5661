"""How filters of documents interact: every order of the filters is replayed, and each part of the corpus gets its counts.

Direct relational replay. The flags of a document (which filters it fails) come from one pass over its text by built-in
functions; texts go no further. Documents' flags are crossed with the orders of the filters (a fixed table, 120 rows for five
filters, sent to every task), exploded into the steps of the order, and the first failing step of each decides what happened
there. Counts are conditional sums that every task combines before anything is shuffled, so what is moved is one row for
each part, order and step that a task has met, however many documents it holds.

The filter for repeated texts looks at the whole table: digests of texts are grouped with partial sums, and a document is
the first of its text if its id and digest are those of the group's least id. That join is by id, so a text that
a third of all documents share is no single task's.

Defined results: a null text is empty; a null part is the empty string; a null id never fails the filter for repeated texts
and makes no other row fail it; rows with one id and one text count each, and the least id's rows all pass; several
label rows of a document count as one in which any is 1; labels of unknown documents are ignored. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The thresholds of the filters.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS, WORD = 200, 50, 2, "[#$%&*|]", r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"


def text_flags(text: Column, words: Column) -> list[Column]:
    """Whether a text fails the filters that need nothing but itself, A to D: few words, few distinct ones, capitals, symbols."""
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [F.size(words) < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words), 100 * capitals > CAPITAL_PERCENT * F.length(text), text.rlike(SYMBOLS)]


def document_flags(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask, good, toxic) for every document: bit k of `mask` is set if it fails the k-th filter."""
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(text_col, F.lit("")).alias("text"))
    read = read.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    mask = sum((c.cast("int") * (1 << k) for k, c in enumerate(text_flags(F.col("text"), F.col("words")))), F.lit(0))
    flagged = read.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
    firsts = flagged.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    repeated = F.col("first").isNull() & F.col("id").isNotNull()
    joined = flagged.join(firsts, ["id", "digest"], "left").join(said, "id", "left")
    return joined.select(
        "part", (F.col("mask") + repeated.cast("int") * (1 << FILTERS.index("E"))).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    )


def replay(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, with the counts of the part.

    `flags` is (part, mask, good, toxic). Columns: kept after the step, removed by it, redundant (failing its filter, but
    removed earlier), unique_fails (failing its filter alone), good_lost and toxic_lost of the removed, and shapley, what
    its filter removes in all orders together. Every part has all orders and steps, so counts of zero are there.
    """
    spark, n = flags.sparkSession, len(filters)
    rows = [("".join(p), [1 << filters.index(f) for f in p]) for p in permutations(filters)]
    orders = F.broadcast(spark.createDataFrame(rows, "filter_order string, bits array<int>"))  # n! rows, whatever the documents are
    crossed = flags.crossJoin(orders)
    fails = [F.col("mask").bitwiseAND(F.element_at("bits", k + 1)) != 0 for k in range(n)]
    first = F.coalesce(*(F.when(f, k + 1) for k, f in enumerate(fails)), F.lit(n + 1))
    met = crossed.select("part", "filter_order", "bits", "mask", "good", "toxic", first.alias("first"))
    steps = met.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    own = F.element_at("bits", F.col("step"))
    here, failing = F.col("first") == F.col("step"), F.col("mask").bitwiseAND(own) != 0
    counted = steps.groupBy("part", "filter_order", "step").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"), F.count_if(here).alias("removed"), F.count_if(failing & (F.col("first") < F.col("step"))).alias("redundant"),
        F.count_if(F.col("mask") == own).alias("unique_fails"), F.count_if(here & F.col("good")).alias("good_lost"), F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )
    letter = F.substr(F.col("filter_order"), F.col("step"), F.lit(1))
    return counted.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", letter)))  # n! rows in each window
