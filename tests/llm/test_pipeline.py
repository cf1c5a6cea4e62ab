"""The corpus pipeline on the smallest tables, stage by stage."""

import re

import corpus_pipeline
from rowproof.llm import language, neardups
from rowproof.llm.common import is_held_out
from rowproof.session import cut

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, FOLDER))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
        if name == "language":
            model = language.train(before, ~is_held_out())
            rejected = language.identify(before, model).where("rejected").count()
            assert docs.count() == before.count() - rejected
        if name == "near_duplicates":
            classes = neardups.near_duplicates(before).select("class_id").distinct()
            assert sorted(r.doc_id for r in docs.collect()) == sorted(r.class_id for r in classes.collect())
        if name == "secrets":
            texts = {r.doc_id: r for r in docs.collect()}
            assert len(texts) == before.count()
            assert all(r.n_chars == len(r.text) for r in texts.values())
            assert not any(re.search(r"[0-9a-f]{24}", r.text) for r in texts.values())
    words = lambda frame: sum(len(r.text.split()) for r in frame.collect())
    assert abs(words(seen["mixing"]) / words(seen["secrets"]) - 1.5) < 0.1
    pieces = seen["packing"]
    assert pieces.where("piece = 0").count() == seen["mixing"].count()
    assert pieces.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_empty_documents_pass_all_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, FOLDER))
    assert docs.count() == 0
