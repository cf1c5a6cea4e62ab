"""Toxicity scores by a factorization machine over hashed terms.

Terms are words and the first 6 and 8 bytes of longer words (inflected insults share a stem), hashed into
2^18 buckets. Every bucket that occurs is judged twice. Alone: those that differ between toxic and other training
documents (chi-square over all training rows, on the executors). In pairs: those that explain, together with other
buckets, what a machine of the first kind leaves unexplained, though each may be neutral by itself (truncated power
iterations over the matrix of pairs, which is never built). The machine, w0 + w·x + pairs of factors, is fitted
on both kinds.

The sample for the fit is bounded: at most ``MOST_ROWS`` distinct (id, text), by a hash of both, and at most
``MOST_NUMBERS`` terms in all; equal rows are one with their number as weight. Every document is scored, with its whole
text, in one pass without a shuffle.

Defined cases: null and empty texts have no feature and get the base rate as score; labels that are null, or
whose documents do not exist, are ignored; with several labels for one id any 1 makes it toxic; repeated
documents count and are scored each; without both kinds of training row every score is the base
rate; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.llm.blocks import word_blocks
from rowproof.llm.common import broadcast_if_small, with_fields
from rowproof.session import cut

BUCKETS = 1 << 18
FEATURES, PAIRED = 1024, 256  # most buckets chosen alone, in pairs
CHI_SQUARE, DEVIATIONS = 10.8, 4.0  # what chance rarely reaches: 1 in 1,000, 1 in 16,000
MOST_ROWS, MOST_NUMBERS = 16_000, 1 << 23
PROBES, ROUNDS = 8, 5
FACTORS = 8
STEPS, RATE, DECAY = 400, 0.03, 0.002
THRESHOLD = 0.3
STEMS = (6, 8)


def _terms(words) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every term occurrence."""
    rows, buckets = [words.row], [words.hash]
    length = words.end - words.start
    for size in STEMS:
        longer = length > size
        start = words.start[longer]
        rows.append(words.row[longer])
        buckets.append(words.hash_of(start, start + size) + np.uint64(size))
    return np.concatenate(rows), (np.concatenate(buckets) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _bags(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) with distinct (row, bucket), by row; value log2(1 + count)."""
    rows, buckets = _terms(words)
    some, count = np.unique(rows * BUCKETS + buckets, return_counts=True)
    return some // BUCKETS, some % BUCKETS, np.log2(1.0 + count)


def paired_buckets(
    row: np.ndarray, bucket: np.ndarray, value: np.ndarray, off: np.ndarray, spread: np.ndarray, most: int = PAIRED
) -> np.ndarray:
    """The buckets whose products with others go with the residuals ``off`` (of variance ``spread``) of the rows.

    A probe holds a number per bucket. Each round a bucket's new number is the sum, over its rows, of the
    residual times its value times the probe's sum over the row's other buckets; only the ``most`` numbers farthest from
    chance stay. A pair that matters reinforces itself, noise does not.
    """
    random = np.random.default_rng(17)
    documents = np.bincount(bucket, minlength=BUCKETS)
    few = 1 + 10 / np.maximum(documents, 1)  # sums over few rows vary more than their variance tells
    farthest = np.zeros(BUCKETS)
    for _ in range(PROBES):
        probe = random.normal(size=BUCKETS)
        for _ in range(ROUNDS):
            own = probe[bucket] * value
            rest = value * (np.bincount(row, weights=own, minlength=len(off))[row] - own)
            total = np.bincount(bucket, weights=off[row] * rest, minlength=BUCKETS)
            chance = np.bincount(bucket, weights=spread[row] * rest * rest, minlength=BUCKETS)
            far = np.abs(total) / np.sqrt(chance * few + 1e-12)
            kept = np.lexsort((np.arange(BUCKETS), -far))[:most]
            probe = np.zeros(BUCKETS)
            probe[kept] = total[kept] / max(np.abs(total[kept]).max(), 1e-12)
        farthest = np.maximum(farthest, far)
    best = np.lexsort((np.arange(BUCKETS), -farthest))[:most]
    return best[farthest[best] >= DEVIATIONS]


@dataclass
class FactorizationMachine:
    """w0 + w·x + ½ Σ ((Vx)² - V²x²), through a logistic function; ``place`` maps buckets to features."""

    place: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    @classmethod
    def fit(cls, place: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> FactorizationMachine:
        """Adam on the weighted logistic loss of all rows of the sample; deterministic."""
        share = (weight / max(weight.sum(), 1)).astype(np.float32)
        rate = float(np.clip(share @ y, 1e-4, 1 - 1e-4)) if len(y) else 0.01
        start = float(np.log(rate / (1 - rate)))
        size = x.shape[1]
        random = np.random.default_rng(17)
        value = {
            "b": np.array([start], np.float32),
            "w": np.zeros(size, np.float32),
            "v": random.normal(0, 0.02, (size, FACTORS)).astype(np.float32),
        }
        if size and 0 < y.sum() < len(y):
            squared = x * x
            moment = {k: [np.zeros_like(p), np.zeros_like(p)] for k, p in value.items()}
            for step in range(1, STEPS + 1):
                v = value["v"]
                mixed = x @ v
                logit = value["b"] + x @ value["w"] + 0.5 * ((mixed**2).sum(1) - (squared @ (v * v)).sum(1))
                off = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * share
                slope = {
                    "b": np.array([off.sum()], np.float32),
                    "w": x.T @ off + DECAY * value["w"] / 10,
                    "v": x.T @ (off[:, None] * mixed) - v * (squared.T @ off)[:, None] + DECAY * v,
                }
                for k, p in value.items():
                    first, second = moment[k]
                    first += 0.1 * (slope[k] - first)
                    second += 0.01 * (slope[k] ** 2 - second)
                    p -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        return cls(place, float(value["b"][0]), value["w"], value["v"])

    def scores(self, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """Scores of ``rows`` texts from their bags."""
        feature = self.place[bucket]
        used = feature >= 0
        row, feature, value = row[used], feature[used], value[used]
        linear = np.bincount(row, weights=self.weights[feature] * value, minlength=rows)
        pairs = np.zeros(rows)
        for factor in range(FACTORS):
            part = self.factors[feature, factor] * value
            pairs += np.bincount(row, weights=part, minlength=rows) ** 2
            pairs -= np.bincount(row, weights=part * part, minlength=rows)
        logit = np.clip(self.bias + linear + 0.5 * pairs, -30, 30)
        return 1 / (1 + np.exp(-logit))


def _fit_on(chosen, row, bucket, value, y, weight) -> FactorizationMachine:
    place = np.full(BUCKETS, -1, dtype=np.int64)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(y), len(chosen)), dtype=np.float32)
    feature = place[bucket]
    used = feature >= 0
    x[row[used], feature[used]] = value[used]
    return FactorizationMachine.fit(place, x, y, weight)


def train(
    documents: DataFrame,
    labels: DataFrame,
    training: Column,
    text: str = "text",
    id_column: str = "doc_id",
    label: str = "toxic",
    most_rows: int = MOST_ROWS,
) -> FactorizationMachine:
    """Judge buckets alone over all training rows, in pairs and fit on a sample of at most ``most_rows``."""
    spark = documents.sparkSession
    marks = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).groupBy(id_column).agg(
        (F.max(label) > 0).cast("int").alias("_y")
    )
    marks = broadcast_if_small(marks, 48)  # else the labelled side decides; texts are shuffled once a pass
    rows = (
        documents.where(training)
        .select(F.col(id_column), F.col(text).alias("_text"))
        .join(marks, id_column)
        .select(F.xxhash64(F.col(id_column).cast("string"), "_text").alias("_key"), "_text", "_y")
    )

    def documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per task: in how many documents of either kind each bucket stands."""
        count = np.zeros((2, BUCKETS), dtype=np.int64)
        size = np.zeros(2, dtype=np.int64)
        for batch in batches:
            kind = batch.column("_y").to_numpy(zero_copy_only=False)
            for start, end, words in word_blocks(batch.column("_text")):
                row, bucket = _terms(words)
                some = np.unique(row * BUCKETS + bucket)
                own = kind[start:end][some // BUCKETS]
                for y in (0, 1):
                    count[y] += np.bincount((some % BUCKETS)[own == y], minlength=BUCKETS)
                size += np.bincount(kind[start:end], minlength=2)[:2]
        used = np.flatnonzero(count.any(axis=0))
        # bucket -1: the number of documents
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(count[0, used], size[0])), pa.array(np.append(count[1, used], size[1]))],
            ["bucket", "clean", "toxic"],
        )

    counted = rows.mapInArrow(documents_with, "bucket long, clean long, toxic long").groupBy("bucket").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    ).toArrow()  # at most BUCKETS rows
    bucket, clean, toxic = (counted.column(i).to_numpy().astype(np.float64) for i in range(3))
    total = bucket == -1
    n0, n1 = clean[total].sum(), toxic[total].sum()
    bucket, clean, toxic = bucket[~total].astype(np.int64), clean[~total], toxic[~total]
    alone = bucket[:0]
    if n0 and n1:
        n = n0 + n1
        with_term, odds = clean + toxic, toxic * n0 - clean * n1
        chi = n * odds**2 / np.maximum(n0 * n1 * with_term * (n - with_term), 1)
        order = np.lexsort((bucket, -chi))[:FEATURES]
        alone = bucket[order[chi[order] >= CHI_SQUARE]]

    share = min(1.0, most_rows / max(n0 + n1, 1))
    some = rows.where(F.pmod("_key", F.lit(1 << 20)) <= F.lit(int(share * (1 << 20))))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bag of every key at its first sight in the task, and how often it came again."""
        known: dict[int, int] = {}
        names = ["key", "y", "n", "buckets", "amounts"]
        kinds = {}
        for batch in batches:
            keys = batch.column("_key").to_pylist()
            fresh = []
            for at, key in enumerate(keys):
                if key in known:
                    known[key] += 1
                else:
                    known[key] = 0
                    kinds[key] = batch.column("_y")[at].as_py()
                    fresh.append(at)
            part = batch.take(pa.array(fresh, pa.int32()))
            for start, end, words in word_blocks(part.column("_text")):
                row, bucket, value = _bags(words)
                first = pa.array(np.searchsorted(row, np.arange(end - start + 1)).astype(np.int32))
                size = end - start
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_key").slice(start, size),
                        part.column("_y").slice(start, size),
                        pa.array(np.ones(size, np.int64)),
                        pa.ListArray.from_arrays(first, pa.array(bucket.astype(np.int32))),
                        pa.ListArray.from_arrays(first, pa.array(value.astype(np.float32))),
                    ],
                    names,
                )
        again = [key for key, n in known.items() if n]
        none = len(again)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(again, pa.int64()),
                pa.array([kinds[key] for key in again], pa.int32()),
                pa.array([known[key] for key in again], pa.int64()),
                pa.nulls(none, pa.list_(pa.int32())),
                pa.nulls(none, pa.list_(pa.float32())),
            ],
            names,
        )

    sample = cut(
        some.mapInArrow(bags, "key long, y int, n long, buckets array<int>, amounts array<float>")
        .groupBy("key")
        .agg(
            F.max("y").alias("y"),
            F.sum("n").alias("n"),
            F.first("buckets", ignorenulls=True).alias("buckets"),
            F.first("amounts", ignorenulls=True).alias("amounts"),
        )
    )
    # about most_rows rows; those in front whose terms fit
    sizes = sample.select("key", F.size("buckets").alias("size")).orderBy("key").limit(most_rows).toArrow()
    fits = int(np.searchsorted(np.cumsum(sizes.column("size").to_numpy()), MOST_NUMBERS, side="right"))
    last = sizes.column("key")[fits - 1].as_py() if fits else None
    taken = sample.where(F.col("key") <= F.lit(last)).toArrow().sort_by("key").combine_chunks()
    y, weight = (taken.column(i).to_numpy().astype(np.float32) for i in (1, 2))
    lists = taken.column("buckets").combine_chunks() if taken.num_rows else pa.array([], pa.list_(pa.int32()))
    row = np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    bucket = lists.flatten().to_numpy()
    value = taken.column("amounts").combine_chunks().flatten().to_numpy() if taken.num_rows else bucket.astype(np.float32)

    model = _fit_on(alone, row, bucket, value, y, weight)
    if not 0 < y.sum() < len(y):
        return model
    expected = model.scores(row, bucket, value, len(y))
    pairs = paired_buckets(row, bucket, value, weight * (expected - y), weight * weight * expected * (1 - expected))
    pairs = np.setdiff1d(pairs, alone)
    return _fit_on(np.concatenate([alone, pairs]), row, bucket, value, y, weight) if len(pairs) else model


def score_toxicity(documents: DataFrame, model: FactorizationMachine, text: str = "text") -> DataFrame:
    """All columns of ``documents`` plus score and predicted; columns of these names are replaced."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    schema = with_fields(documents.schema, *added)
    kept = [field.name for field in schema][: -len(added)]
    place = documents.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for start, end, words in word_blocks(batch.column(place)):
                part = batch.slice(start, end - start)
                values = known.scores(*_bags(words), end - start)
                arrays = [part.column(batch.schema.get_field_index(name)) for name in kept]
                arrays += [pa.array(values), pa.array((values >= THRESHOLD).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, [f.name for f in schema])

    return documents.mapInArrow(score, schema)
