"""SimHash fingerprints, in DataFrame functions alone.

The terms of a text are its five-word shingles (the whole sequence where there are fewer words), weighted by how often
they occur. Each term's 64-bit hash votes for or against every bit. Votes are added in packed form: the sum of
(hash >> i) & 0x100000001 counts bit i in its lower half and bit i + 32 in its upper half, so 32 sums do for 64 bits.

`near_pairs` finds all fingerprints within a Hamming radius: the bits are cut into radius + 2 blocks, and for every
choice of two blocks there is a table in which fingerprints that agree on both meet. Two fingerprints within the radius
differ in at most `radius` blocks, so they agree on two at least and meet in some table.

Defined results: null and empty texts have no terms, fingerprint 0, likeness 1 to each other and 0 to other texts; rows
with equal ids follow each other by a hash of their text; the next document of the only one is itself; a null id comes
last. Equal texts have equal fingerprints.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORDS = 5
_LANES = 0x100000001


def words_of(text: Column) -> Column:
    """Lower-cased words, split at ASCII white space."""
    trimmed = F.regexp_replace(F.lower(text), r"^[ \t-\r]+|[ \t-\r]+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))


def shingle_hashes(words: Column, n: int = WORDS) -> Column:
    """A hash for each run of n words; for fewer words, one for the whole sequence."""
    many = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n))))
    return F.when(F.size(words) >= n, many).when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))


def _votes(h: Column, name: str) -> list[Column]:
    return [F.sum(F.shiftright(h, i).bitwiseAND(F.lit(_LANES))).alias(f"{name}{i}") for i in range(32)]


def _fingerprint(name: str) -> Column:
    """Bits that won more than half of the votes."""
    bits = F.lit(0).cast("long")
    n = F.col(f"{name}_n")
    for i in range(32):
        low = F.col(f"{name}{i}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(f"{name}{i}", 32)
        for count, bit in ((low, i), (high, i + 32)):
            value = (1 << bit) - (1 << 64 if bit == 63 else 0)
            bits = bits.bitwiseOR(F.when(count * 2 > n, F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def fingerprints(df: DataFrame, keys: list[str], texts: dict[str, str]) -> DataFrame:
    """`keys` (which must tell rows apart) with, for each text column, its fingerprint (long) and number of terms.

    Rows with the same keys must be equal. Where `df` is already partitioned by some of the keys, nothing is shuffled.
    """
    split = df.select(*keys, *(words_of(F.col(c)).alias(f"{name}_w") for name, c in texts.items()))
    hashed = split.select(*keys, *(shingle_hashes(F.col(f"{name}_w")).alias(name) for name in texts))
    # One row for each position, with a term of every text or null: as many rows as the longest text has terms.
    terms = hashed.select(*keys, F.explode_outer(F.arrays_zip(*texts)).alias("_t"))
    sums = [v for name in texts for v in (*_votes(F.col(f"_t.{name}"), name), F.count(F.col(f"_t.{name}")).alias(f"{name}_n"))]
    return terms.groupBy(*keys).agg(*sums).select(*keys, *(c for name in texts for c in (_fingerprint(name).alias(name), F.col(f"{name}_n"))))


def likeness(a: Column, n_a: Column, b: Column, n_b: Column) -> Column:
    """Estimated cosine of the weighted terms, from 0 to 1: cos of the angle that the differing bits stand for."""
    angle = F.bit_count(a.bitwiseXOR(b)) / 64.0 * F.lit(3.141592653589793)
    return F.when((n_a == 0) & (n_b == 0), 1.0).when((n_a == 0) | (n_b == 0), 0.0).when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.cos(angle)))


def with_next_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, rank, helper, doc_id, text, next_text): each row with the text of the next by descending id.

    Rows are dealt into ranges of ids by quantiles, so no task orders the whole table. The first row of each range is
    also put, as a helper, behind the last row of the range above it; the largest id closes the circle.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = [k / n for k in range(1, n)] or [0.5]
    cuts, top = rows.agg(F.percentile_approx("doc_id", at, 100 * n), F.max("doc_id")).first()
    edges = sorted({e for e in cuts or [] if e < top})
    array = F.array(*(F.lit(e).cast("long") for e in edges)) if edges else F.array().cast("array<bigint>")
    bucket = F.coalesce(F.size(F.filter(array, lambda e: e < F.col("doc_id"))), F.lit(0))
    places = F.array(F.struct(bucket.alias("bucket"), F.lit(0).alias("helper")))
    if edges:
        first = F.array_contains(array, F.col("doc_id"))
        places = F.concat(places, F.when(first, F.array(F.struct((bucket + 1).alias("bucket"), F.lit(1).alias("helper")))).otherwise(F.array().cast("array<struct<bucket:int,helper:int>>")))
    is_top = F.col("doc_id").eqNullSafe(F.lit(top).cast("long"))
    places = F.concat(places, F.when(is_top, F.array(F.struct(F.lit(0).alias("bucket"), F.lit(2).alias("helper")))).otherwise(F.array().cast("array<struct<bucket:int,helper:int>>")))
    dealt = rows.select("doc_id", "text", F.explode(places).alias("p")).select(F.col("p.bucket").alias("bucket"), F.col("p.helper").alias("helper"), "doc_id", "text")
    w = W.partitionBy("bucket").orderBy("helper", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    return dealt.select("bucket", "helper", "doc_id", "text", F.row_number().over(w).alias("rank"), F.lead("text").over(w).alias("next_text"))


def compare_with_edit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, with their likeness and that to the next document's."""
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    rows = with_next_text(df, id_col, text_col).select("bucket", "rank", "helper", "doc_id", "text", n.cast("long").alias("n_chars"), F.concat(F.col("text").substr(F.lit(1), n - cut), F.coalesce("next_text", F.lit("")).substr(F.lit(1), cut)).alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["bucket", "rank", "helper", "doc_id", "n_chars", "edited_sha256"]
    prints = fingerprints(rows, keys, {"own": "text", "changed": "edited"})
    w = W.partitionBy("bucket").orderBy("rank")
    prints = prints.select("*", F.lead("own").over(w).alias("next"), F.lead("own_n").over(w).alias("next_n")).where("helper = 0")
    text = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return prints.select(
        "doc_id", "n_chars", "edited_sha256", text("own").alias("fingerprint"), text("changed").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("own_n"), F.col("changed"), F.col("changed_n")).alias("near_edited"),
        likeness(F.col("own"), F.col("own_n"), F.col("next"), F.col("next_n")).alias("near_next"),
    )


def near_pairs(prints: DataFrame, radius: int = 3, column: str = "fingerprint") -> DataFrame:
    """(a, b, distance): all pairs a < b of different fingerprints (long) at most `radius` bits apart.

    Equal fingerprints are one: copies join through the fingerprint, not through pairs.
    """
    if not 0 < radius <= 30:
        raise ValueError("radius must be from 1 to 30")
    distinct = prints.select(F.col(column).cast("long").alias("f")).where("f IS NOT NULL").distinct()
    n = radius + 2
    cuts = [64 * k // n for k in range(n + 1)]
    mask = lambda k: ((1 << cuts[k + 1]) - (1 << cuts[k])) - (1 << 64 if cuts[k + 1] == 64 else 0)
    tables = [F.struct(F.lit(t).alias("table"), F.col("f").bitwiseAND(F.lit(mask(i)).cast("long").bitwiseOR(F.lit(mask(j)).cast("long"))).alias("key")) for t, (i, j) in enumerate(combinations(range(n), 2))]
    dealt = distinct.select("f", F.explode(F.array(*tables)).alias("p")).select("f", "p.table", "p.key")
    met = dealt.alias("x").join(dealt.alias("y"), ["table", "key"]).where("x.f < y.f AND bit_count(x.f ^ y.f) <= " + str(radius))
    return met.select(F.col("x.f").alias("a"), F.col("y.f").alias("b")).distinct().withColumn("distance", F.bit_count(F.expr("a ^ b")).cast("int"))
