"""Language identification by interpolated Kneser-Ney character models.

Characters fold into 64 classes: 0 for a run of non-letters, a-z by themselves, other letters by a hash,
lower-cased. A 4-gram is a 24-bit number, so a model has at most 2^24 entries a language whatever the
corpus. All 4-grams of all training texts are counted on the executors; the lower orders (numbers of
distinct left contexts) follow from the table of 4-grams. Each order is a sorted array of n-gram hashes
with one log probability per language, and one of contexts with the back-off weights.

The language with the lowest cross-entropy per character wins; ties go to the smaller name. A document is
rejected if it has no letter, or if that cross-entropy lies far above what the training documents of
the language show; a short text is given more room.

Defined cases: null text or text without a letter: ``und``, score 0, rejected. Without training rows
everything is ``und``. Repeated rows count and are answered each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.llm.blocks import raw_texts, row_ranges
from rowproof.llm.common import with_fields

ORDER, BITS = 4, 6
UNKNOWN = "und"
FLUSH = 1 << 20  # distinct (language, 4-gram) pairs a task holds before it passes them on
# rejection above mean + the larger of Z deviations and LEAST + ROOM / sqrt(characters), in nats
Z, LEAST, ROOM = 8.0, 1.0, 4.0
BLOCK = 1 << 19


@cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    points = np.arange(0x110000)
    table = np.zeros(len(points), dtype=np.uint8)
    letters = np.fromiter((chr(p).isalpha() for p in range(len(points))), bool, len(points))
    lower = points.copy()
    for point in np.flatnonzero(letters):
        small = chr(point).lower()
        if len(small) == 1:
            lower[point] = ord(small)
    other = 27 + (lower * 2654435761 % (1 << 32) >> 8) % 37
    table[letters] = other[letters]
    plain = letters & (lower >= 97) & (lower <= 122)
    table[plain] = lower[plain] - 96
    return table


def classes_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class codes with runs of non-letters as one 0, first code of every row)."""
    if not len(data):
        return np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    whole = np.cumsum((data & 0xC0) != 0x80)
    rows = np.concatenate([[0], whole])[offsets]
    codes = _classes()[points]
    keep = codes > 0
    keep[1:] |= codes[:-1] > 0
    starts = rows[:-1][np.diff(rows) > 0]
    keep[starts] = codes[starts] > 0  # a text begins as after a non-letter
    places = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], places[rows]


def grams_of(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each code; before a text stands class 0."""
    starts = first[:-1][np.diff(first) > 0]
    total, shifted = codes.astype(np.uint32), codes.astype(np.uint32)
    for step in range(1, ORDER):
        moved = np.zeros_like(shifted)
        moved[1:] = shifted[:-1]
        moved[starts] = 0
        shifted = moved
        total |= shifted << np.uint32(BITS * step)
    return total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: list[str] = []
    keys, counts, held = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        every, amounts = every[order], np.concatenate(counts)[order]
        begin = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        return every[begin], np.add.reduceat(amounts, begin)

    def out() -> pa.RecordBatch:
        every, amounts = merged()
        label = pa.DictionaryArray.from_arrays(
            pa.array((every >> np.uint64(24)).astype(np.int32)), pa.array(names, pa.string())
        )
        return pa.RecordBatch.from_arrays(
            [
                label.cast(pa.string()),
                pa.array((every & np.uint64(0xFFFFFF)).astype(np.int32)),
                pa.array(amounts.astype(np.int64)),
            ],
            ["lang", "gram", "n"],
        )

    for batch in batches:
        data, offsets = raw_texts(batch.column("text"))
        labels = batch.column("lang").to_pylist()
        for label in set(labels) - set(names):
            names.append(label)
        numbers = np.array([names.index(x) for x in labels], dtype=np.uint64)
        for start, end in row_ranges(offsets, BLOCK):
            part = offsets[start : end + 1]
            codes, first = classes_of(data[part[0] : part[-1]], part - part[0])
            grams = grams_of(codes, first).astype(np.uint64)
            grams |= np.repeat(numbers[start:end], np.diff(first)) << np.uint64(24)
            if not len(grams):
                continue
            some, amounts = np.unique(grams, return_counts=True)
            keys.append(some)
            counts.append(amounts)
            held += len(some)
            if held > FLUSH:
                some, amounts = merged()
                if len(some) > FLUSH // 2:
                    yield out()
                    keys, counts, held = [], [], 0
                else:
                    keys, counts, held = [some], [amounts], len(some)
    if keys:
        yield out()


def _discount(values: np.ndarray) -> float:
    once, twice = int((values == 1).sum()), int((values == 2).sum())
    return once / (once + 2 * twice) if once else 0.5


def _kneser_ney(grams: np.ndarray, counts: np.ndarray) -> tuple[dict, dict]:
    """Per order: probability function over n-grams, back-off weight per context, as dense helpers."""
    seen, weight = {ORDER: grams}, {ORDER: counts.astype(np.float64)}
    for order in range(ORDER - 1, 0, -1):
        cutoff = (1 << BITS * order) - 1
        shorter = seen[order + 1] & cutoff
        seen[order], number = np.unique(shorter, return_counts=True)
        weight[order] = number.astype(np.float64)  # distinct left contexts
    probability, backoff = {}, {}
    lower = np.full(1, 1.0 / (1 << BITS))
    for order in range(1, ORDER + 1):
        some, amount = seen[order], weight[order]
        cutoff = _discount(amount)
        context = some >> BITS
        size = 1 << BITS * (order - 1)
        total = np.bincount(context, weights=amount, minlength=size)
        kinds = np.bincount(context, minlength=size)
        share = np.where(total > 0, cutoff * kinds / np.maximum(total, 1), 1.0)
        below = lower[some & ((1 << BITS * (order - 1)) - 1)] if order > 1 else lower[np.zeros_like(some)]
        value = np.maximum(amount - cutoff, 0) / total[context] + share[context] * below
        probability[order] = (some, value)
        backoff[order] = share
        if order < ORDER:
            # every possible n-gram of this order: seen, or backed off
            every = np.arange(1 << BITS * order)
            rest = lower[every & ((1 << BITS * (order - 1)) - 1)] if order > 1 else np.full(len(every), lower[0])
            full = share[every >> BITS] * rest
            full[some] = value
            lower = full
    probability["lower"] = lower
    return probability, backoff


@dataclass
class LanguageModel:
    """Sorted n-gram hashes per order with log probabilities per language, and rejection limits."""

    names: list[str]
    grams: dict[int, np.ndarray]
    logs: dict[int, np.ndarray]
    contexts: dict[int, np.ndarray]
    weights: dict[int, np.ndarray]
    mean: np.ndarray | None = None
    deviation: np.ndarray | None = None

    @classmethod
    def build(cls, names: list[str], tables: list[tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
        """From (sorted distinct 4-grams, counts) per language."""
        models = [_kneser_ney(grams, counts) for grams, counts in tables]
        grams, logs, contexts, weights = {}, {}, {}, {}
        for order in range(1, ORDER + 1):
            every = np.unique(np.concatenate([m[0][order][0] for m in models] or [np.zeros(0, np.int64)]))
            table = np.zeros((len(every), len(names)), dtype=np.float32)
            for column, (probability, backoff) in enumerate(models):
                # n-grams that only another language has: backed off here
                value = np.ones(len(every))
                rest, missing = every, np.ones(len(every), dtype=bool)
                for lower in range(order, 0, -1):
                    some, known = probability[lower]
                    at = np.minimum(np.searchsorted(some, rest), len(some) - 1)
                    hit = missing & (some[at] == rest)
                    value[hit] *= known[at[hit]]
                    missing &= ~hit
                    value[missing] *= backoff[lower][rest[missing] >> BITS]
                    rest = rest & ((1 << BITS * (lower - 1)) - 1)
                value[missing] /= 1 << BITS
                table[:, column] = np.log(value)
            grams[order], logs[order] = every.astype(np.uint32), table
            every = np.unique(every >> BITS)
            contexts[order] = every.astype(np.uint32)
            weights[order] = np.stack(
                [np.log(np.maximum(backoff[order][every], 1e-12)) for _, backoff in models], axis=1
            ).astype(np.float32) if models else np.zeros((0, 0), np.float32)
        return cls(names, grams, logs, contexts, weights)

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        """(4-grams x languages); n-grams no language has back off to the next order."""
        out = np.zeros((len(grams), len(self.names)), dtype=np.float32)
        left, rest = np.arange(len(grams)), grams
        for order in range(ORDER, 0, -1):
            some = self.grams[order]
            at = np.minimum(np.searchsorted(some, rest), len(some) - 1)
            hit = some[at] == rest
            if order == ORDER:
                out[:] = self.logs[order][at]
                out[~hit] = 0
            else:
                out[left[hit]] += self.logs[order][at[hit]]
            left, rest = left[~hit], rest[~hit]
            if not len(left):
                return out
            context = rest >> np.uint32(BITS)
            at = np.minimum(np.searchsorted(self.contexts[order], context), len(self.contexts[order]) - 1)
            hit = self.contexts[order][at] == context
            out[left[hit]] += self.weights[order][at[hit]]
            rest = rest & np.uint32((1 << BITS * (order - 1)) - 1)
        out[left] -= np.float32(np.log(1 << BITS))
        return out

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row: cross-entropy for each language, number of codes, whether it has a letter."""
        codes, first = classes_of(data, offsets)
        size = np.diff(first)
        total = np.zeros((len(size), len(self.names)))
        filled = np.flatnonzero(size)
        if len(filled) and self.names:
            scores = self.log_probabilities(grams_of(codes, first))
            for column in range(len(self.names)):
                total[filled, column] = np.add.reduceat(scores[:, column], first[:-1][filled], dtype=np.float64)
        letters = np.zeros(len(size), dtype=bool)
        if len(filled):
            letters[filled] = np.add.reduceat((codes > 0).astype(np.int64), first[:-1][filled]) > 0
        return -total / np.maximum(size, 1)[:, None], size, letters


def _judge(model: LanguageModel, column: pa.Array):
    """Per block of rows: (start, end, best language, entropy, size, letters, score)."""
    data, offsets = raw_texts(column)
    for start, end in row_ranges(offsets, BLOCK):
        part = offsets[start : end + 1]
        entropy, size, letters = model.entropies(data[part[0] : part[-1]], part - part[0])
        if not model.names:
            yield start, end, np.zeros(end - start, int), np.zeros(end - start), size, letters & False, np.zeros(end - start)
            continue
        best = entropy.argmin(axis=1)
        lowest = entropy[np.arange(len(best)), best]
        apart = (entropy - lowest[:, None]) * np.minimum(size, 50)[:, None]
        score = np.where(letters, 1 / np.exp(-apart).sum(axis=1), 0.0)
        yield start, end, best, lowest, size, letters, score


def train(documents: DataFrame, training: Column, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Count, estimate and calibrate on the rows where ``training`` holds and the language is known."""
    spark = documents.sparkSession
    rows = documents.where(training & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")
    )
    counts = (
        rows.mapInArrow(_count, "lang string, gram int, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()  # at most 2^24 rows a language
    )
    label = np.array(counts.column("lang").to_pylist(), dtype=object)
    gram = counts.column("gram").to_numpy().astype(np.int64)
    number = counts.column("n").to_numpy()
    names = sorted(set(label.tolist()))
    tables = []
    for name in names:
        own = np.flatnonzero(label == name)
        own = own[np.argsort(gram[own])]
        tables.append((gram[own], number[own]))
    model = LanguageModel.build(names, tables)
    shared = spark.sparkContext.broadcast(model)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        sums = np.zeros((len(known.names), 3))
        for batch in batches:
            labels = np.array(batch.column("lang").to_pylist(), dtype=object)
            for start, end, best, lowest, _, letters, _ in _judge(known, batch.column("text")):
                right = letters & (np.array(known.names, dtype=object)[best] == labels[start:end])
                for power in range(3):
                    sums[:, power] += np.bincount(
                        best[right], weights=lowest[right] ** power, minlength=len(known.names)
                    )
        yield pa.RecordBatch.from_arrays(
            [pa.array(known.names, pa.string()), *[pa.array(sums[:, power]) for power in range(3)]],
            ["lang", "n", "s", "q"],
        )

    model.mean, model.deviation = np.zeros(len(names)), np.full(len(names), np.inf)
    if names:
        found = rows.mapInArrow(moments, "lang string, n double, s double, q double")
        # one row per language
        for row in found.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect():
            if row["n"] > 1:
                at, mean = names.index(row["lang"]), row["s"] / row["n"]
                model.mean[at] = mean
                model.deviation[at] = max(row["q"] / row["n"] - mean * mean, 0.0) ** 0.5
    return model


def identify(documents: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All columns of ``documents`` plus lang_pred, score, cross_entropy and rejected; no shuffle.

    Columns of these names are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    added = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("cross_entropy", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
    schema = with_fields(documents.schema, *added)
    kept = [field.name for field in schema][: -len(added)]
    place = documents.columns.index(text)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        named = np.array([*known.names, UNKNOWN], dtype=object)
        for batch in batches:
            for start, end, best, lowest, size, letters, score in _judge(known, batch.column(place)):
                part = batch.slice(start, end - start)
                chosen = named[np.where(letters, best, len(known.names))]
                if known.names:
                    limit = known.mean + np.maximum(Z * known.deviation, LEAST)
                    far = lowest > limit[best] + ROOM / np.sqrt(np.maximum(size, 1))
                else:
                    far = np.zeros(end - start, dtype=bool)
                arrays = [part.column(batch.schema.get_field_index(name)) for name in kept]
                arrays += [
                    pa.array(chosen.tolist(), pa.string()),
                    pa.array(score),
                    pa.array(lowest, mask=~letters),
                    pa.array(far | ~letters),
                ]
                yield pa.RecordBatch.from_arrays(arrays, [*kept, *[f.name for f in added]])

    return documents.mapInArrow(label, schema)
