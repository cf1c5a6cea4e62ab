"""One query per operator of this package, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.llm import (
    decontaminate,
    fingerprints,
    language,
    licenses,
    mixing,
    neardups,
    packing,
    ranked,
    repeats,
    secrets,
    topk,
    toxicity,
    transcripts,
)
from rowproof.llm.common import is_held_out, small_batches, table
from rowproof.llm.oracles import SQL  # noqa: F401
from rowproof.session import prepare as prepare_session


def prepare(spark: SparkSession) -> SparkSession:
    small_batches(prepare_session(spark))
    return spark


def op1_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(prepare(spark), folder, "documents"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(prepare(spark), folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    model = toxicity.train(documents, labels, ~is_held_out())
    return toxicity.score_toxicity(documents, model).select(
        "doc_id", is_held_out().alias("held_out"), "score", "predicted"
    )


def op3_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(prepare(spark), folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(prepare(spark), folder, "documents").select("doc_id", "text", "lang")
    model = language.train(documents, ~is_held_out())
    return language.identify(documents.select("doc_id", "text"), model).select(
        "doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected"
    )


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(prepare(spark), folder, "documents"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(prepare(spark), folder, "documents"))


def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Trained on three folds of the conversations, applied to all."""
    conversations = table(prepare(spark), folder, "conversations")
    model = transcripts.train(conversations, ~is_held_out("conv_id"))
    return transcripts.format_chats(conversations, model)


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(prepare(spark), folder, "documents"))


def op9_neardups(spark: SparkSession, folder: str) -> DataFrame:
    return neardups.near_duplicates(table(prepare(spark), folder, "documents"))


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(prepare(spark), folder, "documents").select("doc_id", "text")
    return secrets.scan_secrets(documents).drop("text")


def op11_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(prepare(spark), folder, "documents").select("doc_id", "text")
    items = table(spark, folder, "benchmark").select("item_id", "text")
    return decontaminate.scan_contamination(documents, items).drop("longest")


def op12_ranked(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(prepare(spark), folder, "documents").select("doc_id", "text")
    return ranked.rank_documents(documents, table(spark, folder, "benchmark").select("item_id", "text"))


def op13_repeats(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(prepare(spark), folder, "documents").select("doc_id", "text")
    return repeats.scan_repeats(documents, plant=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_licenses,
        op2_toxicity,
        op3_topk,
        op4_language,
        op5_packing,
        op6_mixing,
        op7_chat,
        op8_fingerprints,
        op9_neardups,
        op10_secrets,
        op11_decontaminate,
        op12_ranked,
        op13_repeats,
    )
}
