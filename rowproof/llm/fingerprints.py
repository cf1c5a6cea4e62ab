"""Document fingerprints: bottom-k sketches of word shingle hashes, in DataFrame functions only.

A sketch holds the ``K`` smallest distinct 31-bit hashes of a text's runs of five words. Sketches merge:
the sketch of parts together is the bottom of their union. From sketches follow estimates of
resemblance, containment and the number of distinct shingles.

Defined cases: null text is empty; a text of fewer than five words has one shingle, of all its words; without a
word the sketch is empty; two empty sketches resemble fully, one empty sketch nothing; rows equal in id and
text are one document that is answered as often as it stands, null ids come last; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.llm.common import row_key, text_of
from rowproof.operators.ordering import number_rows

K, WORDS = 128, 5
HASHES = 1 << 31
_SPLIT = r"[^\p{L}\p{N}]+"


def add_sketch(frame: DataFrame, text: str, sketch: str, k: int = K) -> DataFrame:
    """``frame`` with the bottom-k sketch of ``text`` as an array of int."""
    words = F.array_remove(F.split(F.lower(F.col(text)), _SPLIT), "")
    hashed = frame.withColumn("_words", words).withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    last = F.greatest(F.size("_hashes") - WORDS, F.lit(0))

    def shingle(place: Column) -> Column:
        run = [F.get("_hashes", place + i) for i in range(WORDS)]
        return F.hash(*run).bitwiseAND(F.lit(HASHES - 1))

    every = F.when(F.size("_hashes") > 0, F.transform(F.sequence(F.lit(0), last), shingle)).otherwise(
        F.array().cast("array<int>")
    )
    return (
        hashed.withColumn("_every", every)
        .withColumn(sketch, F.slice(F.sort_array(F.array_distinct("_every")), 1, k))
        .drop("_words", "_hashes", "_every")
    )


def merge_sketches(*sketches: Column, k: int = K) -> Column:
    """The sketch of all parts together."""
    merged = sketches[0]
    for other in sketches[1:]:
        merged = F.array_union(merged, other)
    return F.slice(F.sort_array(merged), 1, k)


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    last = F.get(sketch, k - 1)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / ((last + 1.0) / HASHES))


def resemblance(one: Column, other: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the merged sketch that both hold."""
    merged = merge_sketches(one, other, k=k)
    both = F.size(F.array_intersect(F.array_intersect(merged, one), other))
    return F.when((F.size(one) == 0) & (F.size(other) == 0), F.lit(1.0)).otherwise(
        F.coalesce(both.cast("double") / F.nullif(F.size(merged), F.lit(0)), F.lit(0.0))
    )


def containment(one: Column, other: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``one`` that ``other`` has."""
    union = distinct_shingles(merge_sketches(one, other, k=k), k)
    shared = resemblance(one, other, k) * union
    return F.when(F.size(one) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(one, k)))


def as_text(sketch: Column) -> Column:
    """The sketch as one string of hexadecimal numbers."""
    return F.array_join(F.transform(sketch, lambda value: F.hex(value)), "-")


def fingerprint_documents(
    documents: DataFrame, id_column: str = "doc_id", text: str = "text", k: int = K
) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The last half of a text is replaced by the start of the next document by descending id (after the last
    the first). Only narrow rows are ordered; then each document sends the start its
    predecessor asks for, so whole texts move once.
    """
    base = documents.select(
        F.col(f"`{id_column}`").alias("_id"), *row_key(f"`{id_column}`", f"`{text}`"), text_of(documents, text).alias("_text")
    )
    narrow = base.select("_id", "_k1", "_k2", F.floor(F.char_length("_text") / 2).alias("_half")).distinct()
    placed = number_rows(narrow, [F.col("_id").desc_nulls_last(), "_k1", "_k2"], "_place")
    many = placed.count()
    asked = placed.select(
        F.col("_id").alias("to_id"), F.col("_k1").alias("to_k1"), F.col("_k2").alias("to_k2"), "_half",
        F.pmod(F.col("_place") + 1, F.lit(max(many, 1))).alias("_place"),
    )
    # who sends to whom: the next document's key, and how much of it the predecessor wants
    links = asked.join(
        placed.select(F.col("_id").alias("from_id"), F.col("_k1").alias("from_k1"), F.col("_k2").alias("from_k2"), "_place"),
        "_place",
    ).drop("_place")

    # sketches are made after each move of the texts: they cost less to make twice than to shuffle
    sent = base.join(
        links,
        (F.col("_k1") == F.col("from_k1")) & (F.col("_k2") == F.col("from_k2")) & F.col("_id").eqNullSafe(F.col("from_id")),
    )
    sent = (
        add_sketch(sent, "_text", "_next", k)
        .select("to_id", "to_k1", "to_k2", F.expr("substring(_text, 1, _half)").alias("_start"), "_next")
        .groupBy("to_k1", "to_k2", "to_id")  # equal rows send the same
        .agg(F.first("_start").alias("_start"), F.first("_next").alias("_next"))
    )
    joined = base.join(
        sent,
        (F.col("_k1") == F.col("to_k1")) & (F.col("_k2") == F.col("to_k2")) & F.col("_id").eqNullSafe(F.col("to_id")),
    )
    joined = add_sketch(joined, "_text", "_sketch", k)
    length = F.char_length("_text")
    edited = joined.select(
        F.col("_id"),
        length.alias("n_chars"),
        F.concat(F.expr("substring(_text, 1, char_length(_text) - floor(char_length(_text) / 2))"), "_start").alias("_edited"),
        "_sketch",
        "_next",
    )
    return add_sketch(edited, "_edited", "_other", k).select(
        F.col("_id").alias(id_column),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("_sketch")).alias("fingerprint"),
        as_text(F.col("_other")).alias("edited_fingerprint"),
        resemblance(F.col("_sketch"), F.col("_other"), k).alias("near_edited"),
        resemblance(F.col("_sketch"), F.col("_next"), k).alias("near_next"),
        distinct_shingles(F.col("_sketch"), k).alias("n_shingles"),
        containment(F.col("_sketch"), F.col("_other"), k).alias("kept"),
    )
