"""Exact top-k search by the threshold algorithm over sorted lists per dimension.

Rows belong to the cell of the nearest of at most 256 pivots; a cell is cut by a hash into blocks of bounded size. A query
first searches one block of the cell that promises most; its k-th score there is the query's floor. Of the other
blocks it is sent only to those of cells whose bound, pivot product plus radius, reaches the floor. A (block, chunk of
queries) pair is one bounded task. It sorts every dimension once. The threshold at a depth is the sum of the values
at that depth of the lists, each from the end that helps the query; the first depth whose threshold is below the
k-th score so far is where this query stops. Depth 0 skips the block; else its own lists are read in doubling
depth and the rows seen are scored, until the depth read is the depth to stop at. A tie could still win by its smaller
id, so equality goes on. Only a query whose depth to stop at comes to as many list entries as the block has rows scores
all of them at once instead, as reading could save nothing. The best k of every block are merged by a window.

Defined cases: vectors that are null or empty or hold null or non-finite components, and rows without an id, take
no part; shorter vectors count as filled with zeros; of several rows with one id the smallest vector asks,
none of them answers it, and as candidates each counts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowproof.session import cut, small_table

MOST_ROWS, LEAST_ROWS, SPREAD = 32_768, 256, 24
MOST_PIVOTS = 256
CHUNK = 8192
AT_ONCE = 64  # queries whose scores are held at once
DEPTH = 8
_LOW = np.iinfo(np.int64).min


class SortedLists:
    """The rows of a block with one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")  # ties go to the smaller id: the earlier row
        self.ids, self.vectors = ids[order], vectors[order]
        self.order = np.argsort(self.vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.vectors, self.order, axis=0)
        self.reach = float(np.abs(self.vectors).max(initial=0))
        self.flat = self.vectors.astype(np.float64)
        self.scored = 0  # pairs scored in full

    def products(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact integer inner products."""
        bound = self.reach * float(np.abs(queries).max(initial=0)) * max(queries.shape[1], 1)
        if bound < 2**52:
            return (queries.astype(np.float64) @ self.flat[rows].T).astype(np.int64)
        return queries @ self.vectors[rows].T

    def depths(self, queries: np.ndarray, kth: np.ndarray, ladder: np.ndarray) -> np.ndarray:
        """For each query the first depth of the ladder whose threshold is below the k-th score; else all rows."""
        size = len(self.ids)
        from_top, from_bottom = size - np.maximum(ladder, 1), np.maximum(ladder, 1) - 1
        limit = np.maximum(queries, 0) @ self.sorted[from_top].T + np.minimum(queries, 0) @ self.sorted[from_bottom].T
        enough = limit < kth[:, None]
        return np.where(enough.any(axis=1), ladder[enough.argmax(axis=1)], size)

    def read(self, query: np.ndarray, depth: int) -> np.ndarray:
        """Rows among the first ``depth`` of the lists that matter to one query."""
        size = len(self.ids)
        return np.unique(np.append(self.order[size - depth :, query > 0], self.order[:depth, query < 0]))

    def search(
        self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query index, row index, score) of the best k rows for each query that reach its floor."""
        size, many = len(self.ids), len(queries)
        floors = np.full(many, _LOW) if floors is None else floors
        if not size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        ladder = np.append(0, np.minimum(DEPTH << np.arange(max(size // DEPTH, 1).bit_length() + 1), size))
        lists = (queries != 0).sum(axis=1)
        kth = floors.copy()
        stop = self.depths(queries, kth, ladder)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        whole = []
        for query in np.flatnonzero(stop > 0):
            depth, rows, scores = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
            while depth < stop[query]:
                depth = min(max(DEPTH, 2 * depth), int(stop[query]))
                # with a k-th score known, the depth to stop at tells at once whether reading saves anything
                ahead = int(stop[query]) if kth[query] > _LOW else depth
                # a query of zeros has no list, every row scores 0
                if not lists[query] or ahead * lists[query] >= size:
                    whole.append(query)
                    rows = rows[:0]
                    break
                rows = self.read(queries[query], depth)
                scores = self.score(query_ids[query : query + 1], queries[query : query + 1], rows)[0]
                if len(rows) >= k:
                    kth[query] = max(kth[query], np.partition(scores, len(rows) - k)[len(rows) - k])
                    stop[query] = self.depths(queries[query : query + 1], kth[query : query + 1], ladder)[0]
            if len(rows):
                best, chosen = _top(scores[None], rows[None], k, size)
                found.append((np.full(best.shape[1], query), chosen[0], best[0]))
        if whole:
            every = np.arange(size)
            whole = np.array(whole)
            best = self.score(query_ids[whole], queries[whole], every)
            enough = best >= floors[whole][:, None]
            few = enough.sum(axis=1) <= k
            place, row = np.nonzero(enough & few[:, None])
            found.append((whole[place], row, best[place, row]))
            if not few.all():
                whole, best = whole[~few], best[~few]
                best, rows = _top(best, np.broadcast_to(every, best.shape), k, size)
                found.append((np.repeat(whole, best.shape[1]), rows.ravel(), best.ravel()))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        query, row, score = (np.concatenate(part) for part in zip(*found))
        keep = (score > _LOW) & (score >= floors[query])
        return query[keep], row[keep], score[keep]

    def score(self, query_ids: np.ndarray, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scores of some rows; a query's own id never answers it."""
        self.scored += len(queries) * len(rows)
        scores = self.products(queries, rows)
        scores[query_ids[:, None] == self.ids[rows][None, :]] = _LOW
        return scores


def _top(scores: np.ndarray, rows: np.ndarray, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k per line by score, then smaller row."""
    if scores.shape[1] <= k:
        return scores, rows
    known = scores[scores > _LOW]
    if not len(known) or max(abs(int(known.max())), abs(int(known.min()))) < 2**60 // max(size, 1):
        key = np.where(scores > _LOW, scores * size + (size - 1 - rows), _LOW)
        chosen = np.argpartition(key, key.shape[1] - k, axis=1)[:, -k:]
        within = np.argsort(-np.take_along_axis(key, chosen, axis=1), axis=1)
        chosen = np.take_along_axis(chosen, within, axis=1)
    else:
        chosen = np.lexsort((-rows, scores), axis=1)[:, ::-1][:, :k]
    return np.take_along_axis(scores, chosen, axis=1), np.take_along_axis(rows, chosen, axis=1)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    table = np.zeros((len(lists), width), dtype=np.int64)
    table[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
    return table


def _widest(*columns: pa.ChunkedArray) -> int:
    return max(int(np.diff(c.combine_chunks().offsets.to_numpy()).max(initial=0)) for c in columns)


def quantised(vectors: DataFrame, id_column: str, column: str, scale: int = 64) -> DataFrame:
    """(_id, v array<long>) of the rows that take part: floor(scale * component)."""
    value = F.col(f"`{column}`").cast("array<double>")
    whole = F.size(value) > 0
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col(f"`{id_column}`").isNotNull() & value.isNotNull() & whole & sound).select(
        F.col(f"`{id_column}`").cast("long").alias("_id"),
        F.transform(value, lambda x: F.floor(x * scale)).cast("array<long>").alias("v"),
    )


class Cells:
    """Pivots with the number of rows, the radius and the number of blocks of their cells: at most MOST_PIVOTS."""

    def __init__(self, pivots: np.ndarray) -> None:
        self.pivots = pivots
        self.number = np.arange(len(pivots))
        self.radius = np.zeros(len(pivots))
        self.blocks = np.ones(len(pivots), dtype=np.int64)

    def nearest(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot) of each vector."""
        table, pivots = _same_width(table, self.pivots)
        squares = (table**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * table @ pivots.T
        cell = squares.argmin(axis=1)
        return cell, np.sqrt(((table - pivots[cell]) ** 2).sum(axis=1))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No row of the cell scores more, rounding included: q.x = q.p + q.(x - p)."""
        queries, pivots = _same_width(queries, self.pivots)
        centre = queries @ pivots.T
        spread = np.linalg.norm(queries, axis=1)[:, None] * self.radius[None, :]
        size = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(pivots, axis=1)[None, :]
        return centre + spread + 1e-9 * (size + spread) + 1


def _same_width(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(left.shape[1], right.shape[1])
    return tuple(np.pad(m.astype(np.float64), ((0, 0), (0, width - m.shape[1]))) for m in (left, right))


def _cells(rows: DataFrame, per_block: int, wanted: int) -> tuple[DataFrame, Cells]:
    """Rows with their block (cell, slice), written once, and the cells."""
    # at most MOST_PIVOTS rows
    chosen = rows.orderBy(F.xxhash64("_id", "v"), "_id").limit(wanted).toArrow()
    cells = Cells(_matrix(chosen.column("v"), _widest(chosen.column("v"))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table(batch)
            vectors = table.column("v")
            cell, distance = cells.nearest(_matrix(vectors, _widest(vectors)))
            placed = table.append_column("cell", pa.array(cell.astype(np.int32))).append_column("far", pa.array(distance))
            yield from placed.to_batches()

    placed = cut(rows.mapInArrow(place, "_id long, v array<long>, cell int, far double"))
    # at most MOST_PIVOTS rows
    held = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("many"), F.max("far").alias("radius")).toArrow().sort_by("cell")
    cells.number = held.column("cell").to_numpy().astype(np.int64)
    cells.pivots = cells.pivots[cells.number]
    cells.radius = held.column("radius").to_numpy()
    cells.blocks = -(-held.column("many").to_numpy() // per_block)
    slices = small_table(
        rows.sparkSession, list(zip(cells.number.tolist(), cells.blocks.tolist())), "cell int, slices long"
    )
    sliced = placed.join(F.broadcast(slices), "cell").select(
        "_id", "v", "cell", F.pmod(F.xxhash64("_id", "v", F.lit(1)), "slices").alias("slice")
    )
    return sliced, cells


def _visits(queries: DataFrame, cells: Cells, first: bool) -> DataFrame:
    """(_id, v, floor, cell, slice): one promising block a query, or afterwards every other block that may matter."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table(batch)
            ids, vectors = table.column("_id").to_numpy(), table.column("v")
            bounds = cells.bounds(_matrix(vectors, _widest(vectors)))
            home = bounds.argmax(axis=1)
            home_slice = ids % cells.blocks[home]  # of either sign in, never negative out
            if first:
                row, cell, piece = np.arange(len(ids)), home, home_slice
            else:
                row, cell = np.nonzero(bounds >= table.column("floor").to_numpy()[:, None])
                times = cells.blocks[cell]
                piece = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                other = (cell != home[row]) | (piece != home_slice[row])
                row, cell, piece = row[other], cell[other], piece[other]
            for start in range(0, len(row), CHUNK):
                part = slice(start, start + CHUNK)
                asked = table.take(pa.array(row[part])).append_column("cell", pa.array(cells.number[cell[part]].astype(np.int32)))
                yield from asked.append_column("slice", pa.array(piece[part])).combine_chunks().to_batches()

    return queries.mapInArrow(choose, "_id long, v array<long>, floor long, cell int, slice long")


def _search(
    rows: DataFrame, visits: DataFrame, k: int, chunk: int, scored: Accumulator | None
) -> DataFrame:
    """(query_id, vec_id, score): for every visit the best k rows of the block that reach the floor."""
    block = ["cell", "slice"]
    load = visits.groupBy(block).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("chunks"))
    # a block is bounded, so no key of these joins is hot in rows; visits stay within their chunks
    answering = rows.join(load, block).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    most = visits.sparkSession.sparkContext.defaultParallelism
    tasks = max(int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions")), most)
    asking = visits.join(load, block).withColumn(
        "chunk", F.pmod(F.xxhash64("_id", F.lit(2)), F.col("chunks"))
    )

    def search(held: pa.Table, asked: pa.Table) -> pa.Table:
        out = ([], [], [])
        if held.num_rows and asked.num_rows:
            width = _widest(held.column("v"), asked.column("v"))
            lists = SortedLists(held.column("_id").to_numpy(), _matrix(held.column("v"), width))
            ids, table = asked.column("_id").to_numpy(), _matrix(asked.column("v"), width)
            floors = asked.column("floor").to_numpy()
            for start in range(0, len(ids), AT_ONCE):
                part = slice(start, start + AT_ONCE)
                query, row, score = lists.search(ids[part], table[part], k, floors[part])
                for values, value in zip(out, (ids[part][query], lists.ids[row], score)):
                    values.append(value)
            if scored is not None:
                scored.add(lists.scored)
        arrays = [pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)) for values in out]
        return pa.table(arrays, names=["query_id", "vec_id", "score"])

    # an explicit number of partitions: little data but much work, so nothing to coalesce
    return (
        answering.select(*block, "chunk", "_id", "v")
        .repartition(tasks, *block, "chunk")
        .groupBy(*block, "chunk")
        .cogroup(asking.select(*block, "chunk", "_id", "v", "floor").repartition(tasks, *block, "chunk").groupBy(*block, "chunk"))
        .applyInArrow(search, "query_id long, vec_id long, score long")
    )


def top_k(
    vectors: DataFrame,
    asking: Column,
    k: int = 20,
    id_column: str = "vec_id",
    column: str = "embedding",
    block_rows: int | None = None,
    chunk: int = CHUNK,
    scored: Accumulator | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best rows for each row where ``asking`` holds.

    ``asking`` is a condition on ``vectors``. Each row is sent once per chunk of the queries that visit its block, each
    query once per block it visits. ``scored`` gets the number of pairs scored in full, when the result is computed.
    """
    rows = quantised(vectors, id_column, column)
    queries = cut(quantised(vectors.where(asking), id_column, column).groupBy("_id").agg(F.min("v").alias("v")))
    size = rows.count()
    if not size:
        return small_table(vectors.sparkSession, [], "query_id long, rank int, vec_id long, score long")
    per_block = block_rows or min(MOST_ROWS, max(LEAST_ROWS, -(-size // SPREAD)))
    blocks, cells = _cells(rows, per_block, min(MOST_PIVOTS, -(-size // per_block)))

    unknown = queries.withColumn("floor", F.lit(_LOW).cast("long"))
    home = cut(_search(blocks, _visits(unknown, cells, first=True), k, chunk, scored))
    floors = home.groupBy(F.col("query_id").alias("_id")).agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor")
    )
    # unique ids on both sides
    asked = queries.join(floors, "_id", "left").select("_id", "v", F.coalesce("floor", F.lit(_LOW).cast("long")).alias("floor"))
    others = _search(blocks, cut(_visits(asked, cells, first=False)), k, chunk, scored)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        home.unionByName(others)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
