"""From raw documents to packed sequences: toxic documents go, one of each near-duplicate group stays, repeated passages
go, personal data is masked, and what is left is packed.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the next stage's documents. Every
stage but the last returns the columns doc_id, text, lang, source and n_chars. Texts that become empty stay as documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import jaccard, packing, pii, substrings, toxicity
from quarry.llm.queries import WORD_TOKENIZER
from quarry.session import materialize, spread, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, fitted on the labelled ones among them, scores under 0.5."""
    model = toxicity.fit_tables(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model, COLUMNS).where(F.col("score") < TOXIC).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group that similarities of 0.8 connect."""
    return jaccard.keep_one_of_each(docs.select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes or more that a document of smaller id holds."""
    cut = substrings.remove_repeats(docs, carry=("lang", "source"), as_text=True)
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path(WORD_TOKENIZER)).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("personal_data", mask_personal_data),
    ("packing", pack_documents),
]
ORACLE_SQL = None  # stages of learned scores, suffix order and tokenizers; tested against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the written result of the one before."""
    docs = spread(table(spark, sf_dir, "documents"))
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
