"""A training corpus from raw documents, in stages that are each written and read again.

Every stage takes (spark, docs, folder of the given tables) and works on all rows of ``docs``. Null and empty
texts leave at the first stage (no letter, no language); the other cases are those of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.llm import language, mixing, neardups, packing, secrets
from rowproof.llm.common import is_held_out, small_batches, table
from rowproof.session import cut
from rowproof.session import prepare as prepare_session


def prepare(spark: SparkSession) -> SparkSession:
    small_batches(prepare_session(spark))
    return spark


def known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language the model accepts; trained on three folds of the labelled ones."""
    prepare(spark)
    model = language.train(docs, ~is_held_out())
    # the document is one column, so that none of its own columns can clash with the stage's
    whole = docs.select(F.struct(*[f"`{name}`" for name in docs.columns]).alias("document"), "text")
    return language.identify(whole, model).where("NOT rejected").select("document.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of every near-duplicate class: the one with the smallest id."""
    prepare(spark)
    return neardups.drop_near_duplicates(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document, its secrets masked and ``n_chars`` counted anew where one was."""
    prepare(spark)
    return secrets.mask_secrets(docs, length="n_chars")


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("language", known_language),
    ("near_duplicates", without_near_duplicates),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

# Language models, sampling and packing have no equivalent in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(prepare(spark), folder, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if number < len(STAGES) - 1:
            docs = cut(docs)
    return docs
