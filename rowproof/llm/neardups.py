"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles, banded, verified.

Shingles are runs of five words. A shingle weighs (1 + ln tf) times a damped inverse document frequency
between 0.95 and 1, counted over all documents in 2^18 hash buckets: the damping keeps what a
large group of near copies shares from weighing less than its edits. Improved consistent weighted sampling
draws ``BANDS * ROWS`` samples per document; ``ROWS`` samples together are a band key. Documents that
share a key are compared by their samples inside bounded groups, where each passes on its nearest few;
these pairs are verified by exact weighted Jaccard similarity of whole texts, and classes are the connected
components of the verified pairs. A key whose texts then still belong to several components is searched
again, in blocks bounded by texts and shingles: all its texts outside its largest component against all its
texts. The samples choose the close pairs of different components, the shingle sets verify them where they
are, and a block returns only links that connect components not yet connected in it: fewer than it has
components. So no link is lost to a limit and pairs inside a component are not verified. Samples are still
compared for all texts outside times all texts of such a key, and a text goes into one block per block of
the other side; only what leaves the blocks is bounded by the components.

Equal texts are one text from the start, counted before any shuffle. In the first round a key that more than
``GROUP`` texts share is dealt into groups of about that size by a hash, and its ``ANCHORS`` best connected
texts join each group, so a family of any size hangs together without one task that holds it.

Defined cases: null and empty texts, and texts without a word, are never near to anything: each row is a
class of its own, unless its text equals another's exactly and has at least a word. A text of fewer than
five words has one shingle. Rows without an id keep a null id; a class is named by its smallest id (null
if none has one). Repeated rows are in one class. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.llm import common
from rowproof.llm.blocks import SHINGLE_ROWS, mix, raw_texts, row_ranges, shingles, word_blocks
from rowproof.llm.common import broadcast_if_small
from rowproof.operators.lookup import lookup
from rowproof.session import cut

WORDS, SIMILAR = 5, 0.8
ROWS, BANDS = 5, 16
SAMPLES = ROWS * BANDS
GROUP, ANCHORS = 512, 8
NEAREST = 8  # pairs each member of a group passes on in the first round
GROUP_SHINGLES = 1 << 18  # shingles of one side of a block in the second
CLOSE = 0.6  # share of equal samples from which a pair is verified
LEAST_EQUAL = int(np.ceil(CLOSE * SAMPLES))
FREQUENCY_BITS = 18
DAMPING = 0.05
_BLOCK = 1 << 19
_SHINGLE = np.dtype([("hash", "<u8"), ("count", "<u4")])


@cache
def _draws() -> tuple[np.ndarray, ...]:
    """Tables of Gamma(2, 1) draws r, their inverses and ln c; a hash picks the entry."""
    random = np.random.default_rng(9)
    r = random.gamma(2.0, 1.0, 1 << 16)
    return r.astype(np.float32), (1 / r).astype(np.float32), np.log(random.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)


def samples(hashes: np.ndarray, weights: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(SAMPLES x rows) 64-bit samples; rows are the runs that begin at ``first`` (none empty).

    Two rows agree in a sample with a probability equal to their weighted Jaccard similarity. The sampled
    (shingle, quantised weight) is known by its minimal value, which depends on nothing else.
    """
    r, inverse, lnc = _draws()
    lnw = np.log(weights).astype(np.float32)
    out = np.empty((SAMPLES, len(first)), dtype=np.uint64)
    for number in range(SAMPLES):
        x = (hashes + np.uint64(2 * number + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        a = (x & np.uint64(0xFFFF)).astype(np.int64)
        beta = (x >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2**-16)
        c = (x >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.int64)
        t = np.floor(lnw * inverse[a] + beta)
        value = (lnc[c] - r[a] * (t - beta + 1)).astype(np.float64)
        value += (x >> np.uint64(40)).astype(np.float64) * 1e-12  # tells shingles with equal draws apart
        out[number] = np.minimum.reduceat(value, first).view(np.uint64)
    return out


def _weights(hashes: np.ndarray, count: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    return (1 + np.log(count)) * rarity[(hashes & np.uint64((1 << FREQUENCY_BITS) - 1)).astype(np.int64)]


def _digest(text: str) -> Column:
    """128 bits of a text; equal texts are one text."""
    content = text_of(text)
    return F.struct(F.xxhash64(content).alias("x"), F.xxhash64(F.lit(1), content).alias("y"))


def text_of(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


def _digests(documents: DataFrame, id_column: str, text: str) -> DataFrame:
    return documents.select(
        F.col(f"`{id_column}`").alias("_id"), _digest(text).alias("d"), text_of(text).alias("_text")
    )


def rarities(texts: DataFrame, column: str = "_text") -> np.ndarray:
    """Damped inverse document frequency per hash bucket, over all rows of ``texts``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << FREQUENCY_BITS, dtype=np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, words in word_blocks(batch.column(0), _BLOCK, SHINGLE_ROWS):
                _, hashes, _ = shingles(words, WORDS)
                bucket = (hashes & np.uint64(len(total) - 1)).astype(np.int64)
                total += np.bincount(bucket, minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(total[used], rows))], ["bucket", "n"]
        )

    found = texts.select(column).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    rows = max(int(n[bucket == -1].sum()), 1)
    rarity = np.ones(1 << FREQUENCY_BITS, dtype=np.float32)
    own = bucket >= 0
    share = np.log(np.minimum(n[own], rows)) / np.log(rows + 1)
    rarity[bucket[own]] = 1 - DAMPING * share
    return rarity


def signatures(texts: DataFrame, rarity) -> DataFrame:
    """(d, many, keys array<long>, signature binary) per row of (d, _text) that has ``many`` > 0 shingles."""
    odd = np.uint64(0xD6E8FEB86659FD93)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, words in word_blocks(batch.column("_text"), _BLOCK, SHINGLE_ROWS):
                rows, hashes, count = shingles(words, WORDS)
                filled, first, many = np.unique(rows, return_index=True, return_counts=True)
                if not len(filled):
                    continue
                drawn = samples(hashes, _weights(hashes, count, rarity.value), first)
                keys = np.zeros((BANDS, len(filled)), dtype=np.uint64)
                for row in range(ROWS):
                    keys = mix(keys * odd + drawn[row::ROWS])
                keys = mix(keys + np.arange(BANDS, dtype=np.uint64)[:, None])
                short = (mix(drawn) >> np.uint64(48)).astype("<u2").T.copy()
                width = np.arange(len(filled) + 1, dtype=np.int32)
                content = pa.Array.from_buffers(
                    pa.binary(), len(filled), [None, pa.py_buffer(width * 2 * SAMPLES), pa.py_buffer(short)]
                )
                lists = pa.ListArray.from_arrays(
                    pa.array(width * BANDS), pa.array(keys.T.reshape(-1).view(np.int64))
                )
                part = batch.column("d").take(pa.array(filled + start))
                yield pa.RecordBatch.from_arrays(
                    [part, pa.array(many.astype(np.int64)), lists, content], ["d", "many", "keys", "signature"]
                )

    return texts.select("d", "_text").mapInArrow(
        sign, "d struct<x:long,y:long>, many long, keys array<long>, signature binary"
    )


def shared_bands(signed: DataFrame) -> DataFrame:
    """(key, d, many, n) of every band key that n > 1 texts share, as a written table."""
    bands = cut(signed.select("d", "many", F.explode("keys").alias("key")))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return cut(bands.join(shared, "key"))


def nearest_pairs(signed: DataFrame, members: DataFrame, group: int = GROUP, nearest: int = NEAREST) -> DataFrame:
    """Pairs (a, b) of digests, a < b, that share a band key and enough samples: the first round."""
    members = members.drop("many")
    parts = F.ceil(F.col("n") / group)
    dealt = members.withColumn("part", F.pmod(F.xxhash64("d", "key"), parts))
    if not members.where(F.col("n") > group).isEmpty():
        # texts that share most with others; each group of a hot key gets the best of them
        reach = members.groupBy("d").agg(F.sum("n").alias("reach"))
        some = members.where(F.col("n") > group).join(reach, "d")
        # the best of each of ANCHORS slots: no sort of a hot key's members in one task
        best = some.groupBy("key", "n", F.pmod(F.xxhash64("d"), F.lit(ANCHORS)).alias("slot")).agg(
            F.max(F.struct("reach", "d")).alias("top")
        )
        anchors = best.select("key", "n", F.col("top.d").alias("d")).withColumn(
            "part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
        )
        dealt = dealt.unionByName(anchors.select(*dealt.columns)).distinct()
    grouped = dealt.select("key", "part", "d").join(signed.select("d", "signature"), "d")
    boxed = grouped.groupBy("key", "part").agg(F.collect_list(F.struct("d", "signature")).alias("members"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            offsets = lists.offsets.to_numpy()
            inner = lists.values
            content, digests = inner.field("signature"), inner.field("d")
            one, other = [], []
            for row in range(len(lists)):
                low, high = int(offsets[row]), int(offsets[row + 1])
                if high - low < 2:
                    continue
                part = content.slice(low, high - low)
                begin = np.frombuffer(part.buffers()[1], np.int32)[part.offset]
                table = np.frombuffer(part.buffers()[2], "<u2")[begin // 2 :][: (high - low) * SAMPLES]
                a, b = _nearest(table.reshape(high - low, SAMPLES), nearest)
                one.append(a + low)
                other.append(b + low)
            if one:
                a, b = np.concatenate(one), np.concatenate(other)
                yield pa.RecordBatch.from_arrays(
                    [digests.take(pa.array(a)), digests.take(pa.array(b))], ["a", "b"]
                )

    digest = "struct<x:long,y:long>"
    found = boxed.select("members").mapInArrow(pairs, f"a {digest}, b {digest}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _equal_samples(part: np.ndarray, table: np.ndarray) -> np.ndarray:
    equal = np.zeros((len(part), len(table)), dtype=np.uint8)
    for sample in range(SAMPLES):
        equal += part[:, sample, None] == table[None, :, sample]
    return equal


def _nearest(table: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """For every row of a bounded group its nearest others with enough equal samples, as index pairs."""
    size = len(table)
    step = max(1, (1 << 22) // size)
    one, other = [], []
    for start in range(0, size, step):
        part = table[start : start + step]
        equal = _equal_samples(part, table)
        equal[np.arange(len(part)), np.arange(start, start + len(part))] = 0
        for _ in range(min(nearest, size - 1)):
            best = equal.argmax(axis=1)
            enough = np.flatnonzero(equal[np.arange(len(part)), best] >= LEAST_EQUAL)
            one.append(enough + start)
            other.append(best[enough])
            equal[np.arange(len(part)), best] = 0
    return np.concatenate(one), np.concatenate(other)


def open_members(members: DataFrame, placed: DataFrame, group: int = GROUP) -> DataFrame:
    """(key, d, root, top, rows, columns) of the keys whose texts are in several components.

    ``top`` is the component with most texts of the key; the texts outside it fill ``rows`` blocks, all
    its texts ``columns`` blocks of about ``group`` texts and ``GROUP_SHINGLES`` shingles at most.
    """
    own = cut(members.join(placed, "d"))
    each = own.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("many").alias("m"))
    largest = each.groupBy("key").agg(
        F.max(F.struct("c", "root", "m")).alias("top"),
        F.count(F.lit(1)).alias("roots"), F.sum("c").alias("size"), F.sum("m").alias("m"),
    )

    def blocks(texts: Column, shingled: Column) -> Column:
        return F.greatest(F.ceil(texts / group), F.ceil(shingled / GROUP_SHINGLES))

    several = largest.where("roots > 1").select(
        "key", F.col("top.root").alias("top"), "size",
        blocks(F.col("size") - F.col("top.c"), F.col("m") - F.col("top.m")).alias("rows"),
        blocks(F.col("size"), F.col("m")).alias("columns"),
    )
    found = lookup(own, several, "key", weight="size", spread="d").where(F.col("top").isNotNull())
    return found.select("key", "d", "root", "top", "rows", "columns")


def text_per_digest(texts: DataFrame, ends: DataFrame) -> DataFrame:
    """(d, _text) of the digests in ``ends``, each once.

    Copies become one row per task before anything moves: with few digests the others stay, with many all
    texts are brought together by digest, and the digests join them there.
    """
    written = cut(ends)
    if written.count() * 40 <= common.BROADCAST_BYTES:
        texts = texts.join(F.broadcast(written), "d")
        return texts.groupBy("d").agg(F.first("_text").alias("_text"))
    return texts.groupBy("d").agg(F.first("_text").alias("_text")).join(written, "d", "left_semi")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(d, shingles) of rows of (d, _text): hash and count of every distinct shingle, by hash."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, words in word_blocks(batch.column("_text"), _BLOCK, SHINGLE_ROWS):
                rows, hashes, count = shingles(words, WORDS)
                packed = np.empty(len(hashes), _SHINGLE)
                packed["hash"], packed["count"] = hashes, count
                first = np.searchsorted(rows, np.arange(end - start + 1)) * _SHINGLE.itemsize
                content = pa.Array.from_buffers(
                    pa.binary(), end - start, [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(packed)]
                )
                yield pa.RecordBatch.from_arrays([batch.column("d").slice(start, end - start), content], ["d", "shingles"])

    return texts.select("d", "_text").mapInArrow(sets, "d struct<x:long,y:long>, shingles binary")


class _Side:
    """One side of a block: samples, roots, band keys and weighted shingles of its texts."""

    def __init__(self, side: pa.Table, rarity: np.ndarray) -> None:
        roots = side.column("root").combine_chunks()
        self.root = np.stack([roots.field("x").to_numpy(), roots.field("y").to_numpy()], axis=1)
        self.table = np.frombuffer(b"".join(side.column("signature").to_pylist()), "<u2").reshape(-1, SAMPLES)
        self.bands = side.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        contents = side.column("shingles").to_pylist()
        self.first = np.cumsum([0, *map(len, contents)]) // _SHINGLE.itemsize
        packed = np.frombuffer(b"".join(contents), _SHINGLE)
        self.hash = packed["hash"].astype(np.uint64)
        self.weight = _weights(self.hash, packed["count"], rarity)

    def similarities(self, other: _Side, place: int, rows: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of the text at ``place`` of ``other`` with the texts at ``rows``."""
        own = slice(other.first[place], other.first[place + 1])
        hashes, weight = other.hash[own], other.weight[own]
        counts = self.first[rows + 1] - self.first[rows]
        at = np.arange(counts.sum()) + np.repeat(self.first[rows] - np.cumsum(counts) + counts, counts)
        row = np.repeat(np.arange(len(rows)), counts)
        found = np.minimum(np.searchsorted(hashes, self.hash[at]), len(hashes) - 1)
        same = hashes[found] == self.hash[at]
        lesser = np.minimum(weight[found], self.weight[at])[same]
        common = np.bincount(row[same], weights=lesser, minlength=len(rows))
        total = weight.sum() + np.bincount(row, weights=self.weight[at], minlength=len(rows))
        return common / np.maximum(total - common, 1e-12)


def _links(left: _Side, right: _Side, key: int, least: float = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """Roots (one, other) that similar texts of the two sides connect, fewer than there are roots.

    A pair belongs to the first key that its texts share, so several shared keys look at it once.
    """
    roots, node = np.unique(np.concatenate([left.root, right.root]), axis=0, return_inverse=True)
    own, their = np.split(node.reshape(-1), [len(left.root)])
    label = np.arange(len(roots))
    one, other = [], []
    step = max(1, (1 << 22) // len(their))
    for start in range(0, len(own), step):
        equal = _equal_samples(left.table[start : start + step], right.table)
        for part in np.flatnonzero((equal >= LEAST_EQUAL).any(axis=1)):
            place = start + part
            close = np.flatnonzero(equal[part] >= LEAST_EQUAL)
            mine = left.bands[place]
            close = close[mine[(right.bands[close] == mine).argmax(axis=1)] == key]
            close = close[np.argsort(-equal[part, close].astype(np.int16), kind="stable")]
            several = NEAREST
            # the nearest first: whoever joins their component need not be compared with its other texts
            while len(close := close[label[their[close]] != label[own[place]]]):
                near, close = close[:several], close[several:]
                several = min(8 * several, GROUP)
                for row in near[right.similarities(left, place, near) >= least]:
                    if label[their[row]] != label[own[place]]:
                        label[label == label[their[row]]] = label[own[place]]
                        one.append(own[place])
                        other.append(their[row])
    return roots[np.array(one, np.int64)], roots[np.array(other, np.int64)]


def crossing_links(signed: DataFrame, texts: DataFrame, rarity, searched: DataFrame) -> DataFrame:
    """(a, b) roots of different components that a verified pair of texts of one key connects.

    Every (block of outside texts, block of all texts) of a key is one task of bounded size.
    """
    sets = shingle_sets(text_per_digest(texts, searched.select("d").distinct()))
    full = cut(searched.join(signed.select("d", "signature", "keys"), "d").join(sets, "d"))
    names = ["key", "row", "column", "root", "signature", "keys", "shingles"]

    def own(count: str) -> Column:
        return F.pmod(F.xxhash64("d", "key"), F.col(count))

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    outside = full.where(F.col("root") != F.col("top")).withColumn("row", own("rows")).withColumn("column", every("columns"))
    # own attributes for this side: both come from one table
    whole = full.withColumn("column", own("columns")).withColumn("row", every("rows"))
    whole = whole.select(*[F.col(name).alias(f"{name}_") for name in names])

    def cross(left: pa.Table, right: pa.Table) -> pa.Table:
        ends = [np.zeros((0, 2), np.int64)] * 2
        if len(left) and len(right):
            key = left.column("key")[0].as_py()
            right = right.rename_columns(names)
            ends = _links(_Side(left, rarity.value), _Side(right, rarity.value), key)
        return pa.table({
            name: pa.StructArray.from_arrays([pa.array(end[:, 0]), pa.array(end[:, 1])], ["x", "y"])
            for name, end in zip("ab", ends)
        })

    digest = "struct<x:long,y:long>"
    return (
        outside.select(*names).groupBy(*names[:3]).cogroup(whole.groupBy(*whole.columns[:3]))
        .applyInArrow(cross, f"a {digest}, b {digest}")
    )


def linked_texts(
    signed: DataFrame, texts: DataFrame, rarity, group: int = GROUP, nearest: int = NEAREST
) -> DataFrame:
    """(v, root) of every text that shares a band key: its component of verified pairs."""
    members = shared_bands(signed)
    tested = cut(nearest_pairs(signed, members, group, nearest))
    linked = components(cut(verify(tested, texts, rarity))).withColumnRenamed("v", "d")
    placed = cut(members.select("d").distinct().join(linked, "d", "left").withColumn("root", F.coalesce("root", "d")))
    # groups of up to nearest + 1 texts have passed on all their pairs already
    unfinished = members.where((F.col("n") > nearest + 1) | (F.col("n") > group))
    searched = cut(open_members(unfinished, placed, group))
    if not searched.isEmpty():
        links = cut(crossing_links(signed, texts, rarity, searched).distinct())
        moved = components(links).select(F.col("v").alias("root"), F.col("root").alias("to"))
        placed = placed.join(broadcast_if_small(moved, 40), "root", "left").select("d", F.coalesce("to", "root").alias("root"))
    return placed.withColumnRenamed("d", "v")


def similarities(left: pa.Array, right: pa.Array, rarity: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of two columns of texts, row by row."""
    sides = []
    for column in (left, right):
        parts = []
        for start, _, words in word_blocks(column, _BLOCK, SHINGLE_ROWS):
            rows, hashes, count = shingles(words, WORDS)
            parts.append((rows + start, hashes, _weights(hashes, count, rarity)))
        sides.append(tuple(np.concatenate(x) for x in zip(*parts)))
    (rows_a, hash_a, a), (rows_b, hash_b, b) = sides
    rows, hashes = np.concatenate([rows_a, rows_b]), np.concatenate([hash_a, hash_b])
    weight = np.concatenate([a, b])
    order = np.lexsort((hashes, rows))
    rows, hashes, weight = rows[order], hashes[order], weight[order]
    same = (rows[1:] == rows[:-1]) & (hashes[1:] == hashes[:-1])
    common = np.bincount(rows[1:][same], weights=np.minimum(weight[1:], weight[:-1])[same], minlength=len(left))
    total = np.bincount(rows, weights=weight, minlength=len(left))
    return common / np.maximum(total - common, 1e-12)


def verify(pairs: DataFrame, texts: DataFrame, rarity, least: float = SIMILAR) -> DataFrame:
    """The pairs whose texts reach ``least``; ``texts`` has (d, _text)."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("d")).distinct()
    chosen = cut(text_per_digest(texts, ends))
    both = pairs.join(chosen.select(F.col("d").alias("a"), F.col("_text").alias("_one")), "a").join(
        chosen.select(F.col("d").alias("b"), F.col("_text").alias("_other")), "b"
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(np.diff(raw_texts(batch.column(name))[1]) for name in ("_one", "_other"))
            # bounded work whatever the texts: long ones are compared a pair at a time
            for start, end in row_ranges(np.concatenate([[0], np.cumsum(sizes)]), _BLOCK):
                part = batch.slice(start, end - start)
                near = similarities(part.column("_one"), part.column("_other"), rarity.value)
                yield part.select(["a", "b"]).filter(pa.array(near >= least))

    digest = "struct<x:long,y:long>"
    return both.select("a", "b", "_one", "_other").mapInArrow(check, f"a {digest}, b {digest}")


def components(pairs: DataFrame) -> DataFrame:
    """(v, root) for every end of the pairs: its connected component, by contraction.

    Every vertex points to its smallest neighbour if that is smaller; edges move to the pointed-at vertices
    until none is left. Each round at least halves the vertices of a component.
    """
    edges = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = None
    while True:
        step = cut(edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")))
        jump = step.join(step.select(F.col("a").alias("p"), F.col("p").alias("q")), "p").select("a", "q")
        jump = cut(jump)
        if labels is None:
            labels = jump.select(F.col("a").alias("v"), F.col("q").alias("root"))
        else:
            moved = jump.select(F.col("a").alias("root"), "q")
            labels = labels.join(moved, "root", "left").select("v", F.coalesce("q", "root").alias("root"))
        labels = cut(labels)
        to = jump.select(F.col("a").alias("b"), F.col("q").alias("r"))
        edges = cut(
            edges.join(jump, "a").join(to, "b").where("q <> r").select(F.col("q").alias("a"), F.col("r").alias("b")).distinct()
        )
        if edges.isEmpty():
            return labels


def text_classes(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per distinct text with a word: d, _rows, _least (smallest id), class_id, class_size, keeper.

    ``keeper`` is the digest of the class's text that stays: the one of the smallest id, then digest.
    """
    rows = _digests(documents, id_column, text)
    spark = documents.sparkSession
    rarity = spark.sparkContext.broadcast(rarities(rows))
    # copies are signed where they stand and become one row before they move
    signed = cut(
        signatures(rows, rarity).groupBy("d").agg(*[F.first(name).alias(name) for name in ("many", "keys", "signature")])
    )
    counted = cut(rows.groupBy("d").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_rows")))
    linked = linked_texts(signed, rows, rarity)
    known = counted.join(signed.select("d"), "d", "left_semi").join(
        linked.withColumnRenamed("v", "d"), "d", "left"
    ).withColumn("root", F.coalesce("root", "d"))
    known = cut(known)
    first = F.min(F.struct(F.col("_least").isNull().alias("none"), F.col("_least").alias("id"), "d"))
    classes = known.groupBy("root").agg(first.alias("first"), F.sum("_rows").alias("class_size"))
    return known.join(classes, "root").select(
        "d", "_rows", "_least", F.col("first.id").alias("class_id"), "class_size", F.col("first.d").alias("keeper")
    )


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, class_id (smallest id of the class), class_size (documents)."""
    known = text_classes(documents, id_column, text)
    rows = _digests(documents, id_column, text).select("_id", "d")
    found = lookup(rows, known.select("d", "_rows", "class_id", "class_size"), "d", weight="_rows", spread="_id")
    return found.select(
        F.col("_id").alias(id_column),
        F.when(F.col("class_size").isNull(), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
    )


def drop_near_duplicates(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with one row of every class: the one with the smallest id (then text, then columns)."""
    known = text_classes(documents, id_column, text)
    # what goes: every text but the keeper, and of the keeper's rows all but one
    gone = known.where((F.col("d") != F.col("keeper")) | (F.col("_rows") > 1)).select(
        "d", "_rows", (F.col("d") == F.col("keeper")).alias("kept")
    )
    # the document is one column, so that none of its own columns can clash
    rows = documents.select(
        F.struct(*[f"`{name}`" for name in documents.columns]).alias("row"),
        _digest(text).alias("d"),
        F.col(f"`{id_column}`").alias("id"),
        F.xxhash64(F.col(f"`{id_column}`").cast("string"), F.spark_partition_id()).alias("spread"),
    )
    marked = lookup(rows, gone, "d", weight="_rows", spread="spread")
    alone = marked.where(F.col("kept").isNull()).select("row")
    order = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("i"), F.xxhash64("row").alias("h"))
    one = marked.where(F.col("kept")).groupBy("d").agg(F.min_by("row", order).alias("row")).select("row")
    return alone.unionByName(one).select("row.*")
