"""Ranked lexical search over posting lists in geometric blocks.

Documents become rows of (length, distinct query terms, their counts), written once; texts are read once
for each pass of queries and never move. Every task takes its documents in shards of bounded size. In a shard
each term's posting list is sorted by document similarity, that is by nearest pivot document and likeness
to it, and cut into blocks of ``BLOCK`` documents, and every block keeps the coordinatewise maximum of its
documents' term impacts. Terms go by falling weight. A block of a list needs to be looked at for a query
only for documents without the query's earlier terms, so its bound is the query's weights times the summary
over this and the later terms: exact integers, never below the score of a document that the block may add.
It is skipped only if the bound is below the query's k-th best score so far, which a task carries from shard
to shard; a whole list is skipped, and its blocks are not even built, if the maxima of the shard fail the
same test. The best k of every task are merged by a rank.

Queries come in passes of at most ``PASS_PAIRS`` (item, term) pairs, which bounds what is broadcast, and
are searched in groups of ``GROUP_PAIRS``, which bounds the width of a shard; one longer query is a group of its own.

Defined cases: null texts have no term; items without a term have no row; equal item rows are answered once, rows
of one id with different texts each on their own; repeated documents are ranked each on its own, with equal
scores by id, null ids last; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.llm.blocks import raw_texts, row_ranges
from rowproof.llm.decontaminate import words_of
from rowproof.operators.ordering import running_sums
from rowproof.session import cut, small_table

K = 50
BLOCK = 32  # documents of a block
PIVOTS = 16
PASS_PAIRS, GROUP_PAIRS = 1 << 20, 1 << 13
SHARD_CELLS, SHARD_ROWS = 1 << 23, 4096  # documents times terms, documents
SHARPNESS = 50  # m = 100 - SHARPNESS + (SHARPNESS * n * N) div L
_NONE = np.int64(-1)
_LAST = np.iinfo(np.int64).max


def item_terms(items: DataFrame, id_column: str, text: str) -> DataFrame:
    """(_item struct, _digest, terms array<binary>) of the distinct (id, text) rows with a term."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_texts(batch.column(2))
            content = data.tobytes()
            terms = [
                sorted(set(words_of(content[offsets[i] : offsets[i + 1]]))) for i in range(batch.num_rows)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(terms, pa.list_(pa.binary())),
                    pa.array([len(found) for found in terms], pa.int64()),
                ],
                ["_item", "_digest", "terms", "pairs"],
            )

    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = items.select(F.col(f"`{id_column}`").alias("_item"), F.md5(content).alias("_digest"), content.alias("_content"))
    fields = [*rows.schema.fields[:2], T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("pairs", T.LongType())]
    return rows.dropDuplicates(["_item", "_digest"]).mapInArrow(split, T.StructType(fields)).where("pairs > 0")


class Queries:
    """The queries of a pass: for each its terms as numbers of the pass's vocabulary."""

    def __init__(self, terms: list[list[bytes]]) -> None:
        self.known: dict[bytes, int] = {}
        number = self.known.setdefault
        self.terms = [np.array([number(term, len(self.known)) for term in found], np.int64) for found in terms]

    def groups(self, most: int) -> Iterator[list[int]]:
        """Numbers of queries with at most ``most`` pairs together, or one longer query."""
        held, pairs = [], 0
        for number, found in enumerate(self.terms):
            if held and pairs + len(found) > most:
                yield held
                held, pairs = [], 0
            held.append(number)
            pairs += len(found)
        if held:
            yield held


def forward_rows(documents: DataFrame, id_column: str, text: str, known) -> DataFrame:
    """(id, n, terms, counts) of the documents with at least one term; terms: the queries' only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        wide = max(len(known.value), 1)
        for batch in batches:
            data, offsets = raw_texts(batch.column(1))
            sizes, bounds, terms, counts, before = [], [0], [], [], 0
            for low, high in row_ranges(offsets):
                texts = [words_of(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(low, high)]
                many = np.array([len(words) for words in texts], np.int64)
                found = np.fromiter((get(word, -1) for words in texts for word in words), np.int64, int(many.sum()))
                row = np.repeat(np.arange(len(texts)), many)
                keys, number = np.unique((row * wide + found)[found >= 0], return_counts=True)
                sizes.append(many)
                terms.append((keys % wide).astype(np.int32))
                counts.append(number)
                ends = np.searchsorted(keys, np.arange(1, len(texts) + 1) * wide)
                bounds += (before + ends).tolist()
                before += len(keys)
            n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            limits = pa.array(bounds, pa.int32())
            columns = [
                pa.ListArray.from_arrays(limits, np.concatenate(part) if part else np.zeros(0, kind))
                for part, kind in ((terms, np.int32), (counts, np.int64))
            ]
            rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *columns], ["id", "n", "terms", "counts"])
            yield rows.filter(pa.array(n > 0))

    source = documents.select(F.col(f"`{id_column}`").cast("long"), F.col(f"`{text}`").cast("string"))
    return source.mapInArrow(count, "id long, n long, terms array<int>, counts array<long>")


class Best:
    """The k best (score, id) of every query so far, best first; ``_NONE`` marks free places."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.scores = np.full((queries, k), _NONE)
        self.ids = np.full((queries, k), _LAST)

    def kth(self, queries: np.ndarray) -> np.ndarray:
        return self.scores[queries, -1]

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        take = (scores > 0) & (scores >= self.scores[query, -1])
        if not take.any():
            return
        scores = np.concatenate([self.scores[query], scores[take]])
        ids = np.concatenate([self.ids[query], ids[take]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[query], self.ids[query] = scores[order], ids[order]


class Shard:
    """Documents of one shard over the terms of a group of queries, as columns by falling weight.

    ``looked``: (query, document) pairs scored; ``lists``/``built``: query terms, and lists with blocks.
    """

    def __init__(self, ids: np.ndarray, impacts: np.ndarray, block: int) -> None:
        self.ids, self.impacts, self.block = ids, impacts, block
        self.looked = self.lists = self.built = 0
        self.most = impacts.max(axis=0, initial=0).astype(np.float64)
        pivots = impacts[:: max(1, -(-len(ids) // PIVOTS))]
        length = np.sqrt(np.square(pivots).sum(axis=1, dtype=np.float64))
        likeness = impacts @ (pivots / np.maximum(length, 1)[:, None].astype(np.float32)).T
        # places of the documents in the order of their cluster, the likest first
        nearest = likeness.argmax(axis=1) if len(ids) else np.zeros(0, np.int64)
        near = likeness.max(axis=1) if len(ids) else np.zeros(0)
        self.order = np.lexsort((-near, nearest))

    def search(self, numbers: list[int], columns: list[np.ndarray], weights: np.ndarray, best: Best) -> None:
        """Answer the queries ``numbers`` with the sorted ``columns`` of their terms."""
        many, wide = len(numbers), self.impacts.shape[1]
        asked = np.zeros((many, wide), dtype=bool)
        for place, found in enumerate(columns):
            asked[place, found] = True
        number = np.array(numbers)
        # what the documents can still score from a term on, for every query
        rest = np.where(asked, weights * self.most, 0.0)[:, ::-1].cumsum(axis=1)[:, ::-1]
        scored = np.zeros((many, len(self.ids)), dtype=bool)
        present = np.asfortranarray(self.impacts[self.order] > 0)
        for term in range(wide):
            holders = np.flatnonzero(asked[:, term])
            listed = self.order[present[:, term]]
            self.lists += len(holders)
            alive = holders[(rest[holders, term] >= best.kth(number[holders])) & (rest[holders, term] > 0)]
            if not len(alive) or not len(listed):
                continue
            self.built += 1
            later = np.flatnonzero(asked[alive, term:].any(axis=0)) + term
            starts = np.arange(0, len(listed), self.block)
            summary = np.maximum.reduceat(self.impacts[np.ix_(listed, later)], starts, axis=0)
            bounds = (asked[np.ix_(alive, later)] * weights[later]) @ summary.T.astype(np.float64)
            for place, bound in zip(alive.tolist(), bounds):
                self._visit(place, number[place], bound, starts, listed, columns[place], weights, scored, best)
        self.looked += int(scored.sum())

    def _visit(self, place, query, bound, starts, listed, columns, weights, scored, best: Best) -> None:
        """Score the documents of the blocks whose bound does not fail, the best block first."""
        while True:
            open_ = np.flatnonzero(bound >= max(best.scores[query, -1], 1))
            if not len(open_):
                return
            if len(open_) > 2:  # two blocks raise the k-th score before the others are judged
                open_ = open_[np.argpartition(-bound[open_], 1)[:2]]
            rows = (starts[open_][:, None] + np.arange(self.block)[None, :]).ravel()
            rows = listed[rows[rows < len(listed)]] if len(starts) > 1 else listed
            rows = rows[~scored[place, rows]]
            bound[open_] = -1
            if len(rows):
                scored[place, rows] = True
                scores = self.impacts[np.ix_(rows, columns)].astype(np.float64) @ weights[columns]
                best.add(query, scores.astype(np.int64), self.ids[rows])


def _impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Searcher:
    """Answers all queries of a pass over the documents of one task."""

    def __init__(self, queries: Queries, df: np.ndarray, count: int, total: int, k: int, block: int = BLOCK) -> None:
        weight = np.floor(1000 * np.log((2 * count + 2) / (2 * df.astype(np.float64) + 1)))
        self.count, self.total, self.block = count, total, block
        self.best = Best(len(queries.terms), k)
        self.groups = []
        for numbers in queries.groups(GROUP_PAIRS):
            terms = np.unique(np.concatenate([queries.terms[number] for number in numbers]))
            terms = terms[np.lexsort((terms, -weight[terms]))]
            column = np.full(len(weight), -1, np.int64)
            column[terms] = np.arange(len(terms))
            columns = [np.sort(column[queries.terms[number]]) for number in numbers]
            self.groups.append((numbers, columns, column, weight[terms]))
        self.widest = max((len(group[3]) for group in self.groups), default=1)
        self.looked = self.lists = self.built = 0

    def shard_rows(self) -> int:
        return max(BLOCK, min(SHARD_ROWS, SHARD_CELLS // self.widest))

    def add(self, ids: np.ndarray, n: np.ndarray, bounds: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        """Search one shard: documents with their terms in ``terms[bounds[i]:bounds[i + 1]]``."""
        m = 100 - SHARPNESS + SHARPNESS * n * self.count // self.total
        row = np.repeat(np.arange(len(ids)), np.diff(bounds))
        impact = _impacts(counts, m[row])
        for numbers, columns, column, weights in self.groups:
            place = column[terms]
            inside = place >= 0
            # impacts are below 1,000,000: exact in 32 bits
            table = np.zeros((len(ids), len(weights)), np.float32)
            table[row[inside], place[inside]] = impact[inside]
            shard = Shard(ids, table, self.block)
            shard.search(numbers, columns, weights, self.best)
            self.looked += shard.looked
            self.lists += shard.lists
            self.built += shard.built


def _search_pass(forward: DataFrame, content, k: int) -> DataFrame:
    """(query, doc, score): the best k of every task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*content.value, k)
        most = searcher.shard_rows()
        for batch in batches:
            for low in range(0, batch.num_rows, most):
                part = batch.slice(low, most)
                ids = part.column(0).fill_null(_LAST).to_numpy()
                terms, counts = part.column(2), part.column(3)
                bounds = terms.offsets.to_numpy()
                searcher.add(
                    ids,
                    part.column(1).to_numpy(),
                    bounds - bounds[0],
                    terms.flatten().to_numpy(),
                    counts.flatten().to_numpy(),
                )
        query, place = np.nonzero(searcher.best.scores > 0)
        ids = searcher.best.ids[query, place]
        yield pa.RecordBatch.from_arrays(
            [pa.array(query), pa.array(ids, mask=ids == _LAST), pa.array(searcher.best.scores[query, place])],
            ["query", "doc", "score"],
        )

    return forward.mapInArrow(search, "query long, doc long, score long")


def rank_documents(
    documents: DataFrame,
    items: DataFrame,
    k: int = K,
    id_column: str = "doc_id",
    text: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    pass_pairs: int = PASS_PAIRS,
) -> DataFrame:
    """(item id, rank, doc id, score): the ``k`` best documents with a score above 0 for every item."""
    spark = documents.sparkSession
    terms = running_sums(item_terms(items, item_column, item_text), [], ["_item", "_digest"], ["pairs"])
    number = F.floor((F.col("pairs_running") - F.col("pairs")) / F.lit(pass_pairs)).cast("int")
    queries = cut(terms.select("_item", "_digest", "terms", number.alias("_pass")))
    kind = queries.schema["_item"].dataType.simpleString()
    answers = None
    for row in sorted(queries.groupBy("_pass").count().collect()):
        # at most PASS_PAIRS pairs and the last item's
        asked = queries.where(F.col("_pass") == row[0]).orderBy("_item", "_digest").collect()
        held = Queries([[bytes(term) for term in found["terms"]] for found in asked])
        known = spark.sparkContext.broadcast(held.known)
        forward = cut(forward_rows(documents, id_column, text, known))
        count, total = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(1))).first()
        df = np.zeros(len(held.known), np.int64)
        for term, many in forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[term] = many
        content = spark.sparkContext.broadcast((held, df, count, total))
        names = small_table(spark, [(place, found["_item"]) for place, found in enumerate(asked)], f"query long, _item {kind}")
        # no more rows than queries in a pass
        found = _search_pass(forward, content, k).join(F.broadcast(names), "query").withColumn("_pass", F.lit(row[0]))
        answers = found if answers is None else answers.unionByName(found)
    if answers is None:
        layout = f"query long, doc long, score long, _item {kind}, _pass int"
        answers = small_table(spark, [], layout)
    best_first = Window.partitionBy("_pass", "query").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    return (
        answers.withColumn("rank", F.row_number().over(best_first))
        .where(F.col("rank") <= k)
        .select(F.col("_item").alias(item_column), "rank", F.col("doc").alias(id_column), "score")
    )
