"""The pipeline's stages on a small corpus, each against its rule."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from quarry.llm import jaccard, pii, substrings
from quarry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / f"{k}"))
        found = spark.read.parquet(str(tmp_path / f"{k}"))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        kept = {r.doc_id for r in found.select("doc_id").distinct().collect()}
        assert kept <= ids
        if k + 1 < len(p.STAGES):
            assert found.columns == list(p.COLUMNS) and found.where("text IS NOT NULL AND n_chars <> length(text)").count() == 0
        if name == "toxicity":
            clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
            assert len(clean - kept) <= 0.02 * len(clean)
        if name == "near_duplicates":
            comps = {r.doc_id: r.component_id for r in jaccard.components(docs).collect()}
            assert kept == {i for i, c in comps.items() if i == c}
            assert jaccard.components(found).where("doc_id <> component_id").count() == 0
        if name == "repeated_passages":
            assert kept == ids
            assert substrings.remove_repeats(docs).agg(F.sum("n_removed")).first()[0] > 0
        if name == "personal_data":
            left = pii.report(found).agg(*(F.sum(f"n_{k}") for k in pii.KINDS)).first()
            assert kept == ids and sum(left) == 0
        if name == "packing":
            assert kept == ids
            top = found.agg(F.max("sequence_id")).first()[0]
            assert found.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(f"n <> 4096 AND sequence_id < {top}").count() == 0
        docs = found


def test_every_operator_is_registered():
    assert sorted(int(q.split("_")[0][2:]) for q in QUERIES) == list(range(1, 14))


def test_run_ends_in_sequences(spark):
    rows = p.run(spark, SF)
    assert rows.agg(F.sum("length")).first()[0] == rows.dropDuplicates(["doc_id"]).agg(F.sum("doc_tokens")).first()[0]
