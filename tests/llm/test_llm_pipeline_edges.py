"""Every stage with repeated rows, nulls in all columns, and no rows at all; rows are counted."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p

LONG = " ".join(f"word{k}" for k in range(80))
ROWS = [
    (1, LONG, "en", "a", 5), (1, LONG, "en", "a", 5), (2, LONG, None, None, None), (3, LONG + " more", "en", "b", 1), (4, None, None, None, None), (4, None, None, None, None),
    (5, "", "en", "a", 0), (None, "mail a@b.com now", None, None, None), (None, None, None, None, None), (6, "You idiot, you moron. " * 3, "en", "a", 1), (7, "call +1 456 555 2186 or 10.0.0.1", "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(6, 1, 1), (1, 1, 0), (None, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_rows_by_stage(spark, folder, tmp_path):
    docs, counts = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(p.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        counts.append((name, docs.count()))
        if name == "near_duplicates":
            kept = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in docs.fillna("-", ["text"]).collect())
            assert kept == [(-1, "-"), (-1, "mail a@b.com now"), (1, LONG), (4, "-"), (5, ""), (7, "call +1 456 555 2186 or 10.0.0.1")]
        if name == "personal_data":
            assert {r.text for r in docs.where("doc_id = 7 OR text LIKE '%mail%'").collect()} == {"call [PHONE] or [IP]", "mail [EMAIL] now"}
    assert counts[:4] == [("toxicity", 10), ("near_duplicates", 6), ("repeated_passages", 6), ("personal_data", 6)]
    assert docs.agg(F.count_distinct("sequence_id")).first()[0] == 1


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
