"""License scans by diagonal voting.

All rolling word k-gram hashes of all texts are joined with the k-gram positions of the templates.
A hit at text word p and template word t votes for the diagonal p - t. Votes are a bit set of template
positions, so repeated rows and repeated hits change nothing. A base phrase stands exactly where a
diagonal holds every k-gram of the phrase. For longer templates neighbouring diagonals (words added or
left out) are merged and the span is verified by the longest common subsequence of words.

Defined cases: null and empty texts have no words, labels "" and score 0; rows equal in id and text
get equal results; null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowproof.llm.blocks import mix, phrase_hashes, word_blocks
from rowproof.llm.common import BROADCAST_BYTES, row_key
from rowproof.session import cut, small_table

K = 3
SECTION = 56  # words of a template section: its k-grams fit the bits of a long
GAP = 3  # diagonals at most so far apart belong together
LEAST_VOTES = 0.3  # share of k-grams a span needs to be verified
LEAST_SIMILARITY = 0.8  # share of template words found in order

# The phrases of the scan and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Public license notices, in the words that projects put into files.
NOTICES = (
    ("mit", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
        "copies of the software and to permit persons to whom the software is furnished to do so",
    ),
    ("apache-2", "licensed under the apache license version 2 0"),
    (
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a copy of the license "
        "at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
        "software distributed under the license is distributed on an as is basis without warranties or "
        "conditions of any kind either express or implied",
    ),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation either version 3 of the license "
        "or at your option any later version",
    ),
    (
        "lgpl",
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
        "published by the free software foundation",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided "
        "that the following conditions are met redistributions of source code must retain the above copyright "
        "notice this list of conditions and the following disclaimer",
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is "
        "hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
)


class Template:
    """A section of a phrase or notice: label, word hashes, whether it is a base phrase."""

    def __init__(self, label: str, words: np.ndarray, base: bool) -> None:
        self.label, self.words, self.base = label, words, base
        # positions by word, as bit sets, for the common subsequence
        self.places: dict[int, int] = {}
        for at, word in enumerate(words.tolist()):
            self.places[word] = self.places.get(word, 0) | 1 << at

    def grams(self) -> int:
        return len(self.words) - K + 1

    def common(self, words: list[int]) -> int:
        """Length of the longest common subsequence with ``words`` (bit-parallel)."""
        full = (1 << len(self.words)) - 1
        rest = full
        for word in words:
            matched = rest & self.places.get(word, 0)
            rest = ((rest + matched) | (rest - matched)) & full
        return len(self.words) - rest.bit_count()


def templates(base=BASE, notices=NOTICES) -> list[Template]:
    """Templates of at most ``SECTION`` words; longer notices become several, base phrases must fit."""
    found = []
    for phrase, label in base:
        words = phrase_hashes(phrase)
        if not K <= len(words) <= SECTION:
            raise ValueError(f"A base phrase has {K} to {SECTION} words: {phrase!r}")
        found.append(Template(label, words, True))
    for label, notice in notices:
        words = phrase_hashes(notice)
        parts = -(-len(words) // SECTION)
        found += [Template(label, part, False) for part in np.array_split(words, parts) if len(part) >= K]
    return found


def _gram_positions(spark, known: list[Template]) -> DataFrame:
    """(gram, template, place, bit of the place) of all templates: a constant table."""
    rows = []
    for number, template in enumerate(known):
        for at in range(template.grams()):
            total = np.zeros(1, np.uint64)
            for place in range(K):
                total = total * np.uint64(0xD6E8FEB86659FD93) + template.words[at + place : at + place + 1]
            rows.append((int(mix(total).view(np.int64)[0]), number, at, 1 << at))
    return small_table(spark, rows, "gram long, template int, at int, vote long")


def _keyed(documents: DataFrame, id_column: str, text: str) -> DataFrame:
    return documents.select(
        F.col(f"`{id_column}`").alias("_id"),
        *row_key(f"`{id_column}`", f"`{text}`"),
        F.col(f"`{text}`").alias("_text"),
    )


def _gram_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end, words in word_blocks(batch.column("_text")):
            grams, first = words.grams(K)
            lists = pa.ListArray.from_arrays(
                pa.array(first, pa.int32()), pa.array(grams.view(np.int64))
            )
            part = batch.slice(start, end - start)
            yield pa.RecordBatch.from_arrays(
                [part.column("_k1"), part.column("_k2"), lists], ["_k1", "_k2", "grams"]
            )


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end, words in word_blocks(batch.column("_text")):
            part = batch.slice(start, end - start)
            counts = pa.array(np.diff(words.first).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), part.column("_k1"), part.column("_k2"), counts],
                ["_id", "_k1", "_k2", "n_words"],
            )


def _longest(spans: list[tuple]) -> list[tuple]:
    """Of spans with different labels at one place only the one with most words in common stays."""
    kept: list[tuple] = []
    last: dict[str, list[tuple]] = {}
    for span in sorted(spans, key=lambda s: (-s[0], -s[1], s[2], s[4])):
        _, _, low, high, label = span
        others = (other for name, own in last.items() if name != label for other in own)
        if all(high <= other[2] or other[3] <= low for other in others):
            kept.append(span)
            last.setdefault(label, []).append(span)
    return kept


def _verifier(known: list[Template]):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, words in word_blocks(batch.column("_text")):
                part = batch.slice(start, end - start)
                spans = part.column("spans").to_pylist()
                labels, best = [], []
                for row, candidates in enumerate(spans):
                    own = words.hash[words.first[row] : words.first[row + 1]]
                    good = []
                    for span in candidates:
                        template = known[span["template"]]
                        low = max(0, span["low"] - GAP)
                        common = template.common(own[low : span["high"] + GAP].tolist())
                        share = common / len(template.words)
                        if share >= LEAST_SIMILARITY:
                            good.append((common, share, span["low"], span["high"], template.label))
                    kept = _longest(good)
                    labels.append(sorted({span[-1] for span in kept}))
                    best.append(max([span[1] for span in kept], default=0.0))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_k1"),
                        part.column("_k2"),
                        pa.array(labels, pa.list_(pa.string())),
                        pa.array(best, pa.float64()),
                    ],
                    ["_k1", "_k2", "more", "similarity"],
                )

    return verify


def scan_licenses(
    documents: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    base=BASE,
    notices=NOTICES,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the share of template words of the best verified span, 1 for a base phrase, else 0.
    """
    spark = documents.sparkSession
    known = templates(base, notices)
    docs = _keyed(documents, id_column, text)
    key = ["_k1", "_k2"]
    grams = docs.mapInArrow(_gram_lists, "_k1 long, _k2 long, grams array<long>")
    hits = grams.select(*key, F.posexplode("grams").alias("at_text", "gram")).join(
        F.broadcast(_gram_positions(spark, known)), "gram"
    )
    votes = hits.select(
        *key,
        "template",
        (F.col("at_text") - F.col("at")).alias("diagonal"),
        "vote",
    )
    diagonals = cut(votes.groupBy(*key, "template", "diagonal").agg(F.bit_or("vote").alias("votes")))

    facts = small_table(
        spark,
        [(n, t.label, t.base, t.grams(), len(t.words)) for n, t in enumerate(known)],
        "template int, label string, base boolean, grams int, size int",
    )
    told = diagonals.join(F.broadcast(facts), "template")
    exact = told.where(F.col("base") & (F.bit_count("votes") == F.col("grams")))
    places = exact.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_base"),
        F.min("diagonal").cast("long").alias("first_word"),
        F.max("diagonal").cast("long").alias("last_word"),
        F.array_sort(F.collect_set("label")).alias("_base"),
    )

    line = Window.partitionBy(*key, "template").orderBy("diagonal")
    group = F.sum((F.col("diagonal") - F.col("_before") > GAP).cast("int")).over(
        line.rowsBetween(Window.unboundedPreceding, 0)
    )
    merged = (
        told.where(~F.col("base"))
        .withColumn("_before", F.lag("diagonal").over(line))
        .withColumn("_group", F.coalesce(group, F.lit(0)))
        .groupBy(*key, "template", "_group")
        .agg(
            F.min("diagonal").alias("low"),
            (F.max("diagonal") + F.max("size")).alias("high"),
            F.bit_count(F.bit_or("votes")).alias("share"),
            F.max("grams").alias("grams"),
        )
        .where(F.col("share") >= F.lit(LEAST_VOTES) * F.col("grams"))
    )
    spans = cut(
        merged.groupBy(*key).agg(F.collect_list(F.struct("template", "low", "high")).alias("spans"))
    )
    size = spans.agg(F.coalesce(F.sum(F.size("spans") * 16 + 32), F.lit(0))).first()[0]
    chosen = docs.join(F.broadcast(spans) if size <= broadcast_bytes else spans, key)
    verified = (
        chosen.select(*key, "_text", "spans")
        .mapInArrow(_verifier(known), "_k1 long, _k2 long, more array<string>, similarity double")
        .groupBy(*key)
        .agg(F.first("more").alias("more"), F.max("similarity").alias("similarity"))
    )

    counted = docs.mapInArrow(
        _counts, f"_id {documents.schema[id_column].dataType.simpleString()}, _k1 long, _k2 long, n_words long"
    )
    none = F.array().cast("array<string>")
    own, more = F.coalesce("_base", none), F.coalesce("more", none)
    return (
        counted.join(places, key, "left")
        .join(verified, key, "left")
        .select(
            F.col("_id").alias(id_column),
            "n_words",
            F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
            "first_word",
            "last_word",
            F.array_join(own, ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union(own, more)), ",").alias("labels"),
            F.when(F.size(own) > 0, F.lit(1.0))
            .otherwise(F.coalesce("similarity", F.lit(0.0)))
            .alias("score"),
        )
    )
