"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words are dealt into shards of bounded size and every shard's automaton is built in one task. The
documents stream past one automaton at a time: each word moves the state and the longest matching length, so
a window of ``limit`` item words ends wherever that length reaches ``limit``; the state then tells the items
that hold the window. Items shorter than ``limit`` are one window each, found over suffix links. Texts never
move: only if there are several shards the (few) hits are brought together by a digest of id and text.

Words no item has, and word pairs that stand side by side in no item, reset the state; numpy cuts the texts
there first, and the automaton walks the stretches that are long enough for a window.

Defined cases: null texts have no words; items without words have no window; equal item rows count once, rows of
one id with different texts are one item in every count; items without an id are matched, but neither
listed nor counted; repeated documents each get their row; very long items are cut into overlapping
pieces, so that every window lies in one; an empty table of items marks nothing.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.llm.blocks import raw_texts, row_ranges
from rowproof.operators.lookup import lookup
from rowproof.operators.ordering import running_sums
from rowproof.session import cut

LIMIT = 10  # words of a window
COVERAGE = 0.5  # a document with a larger share of hit words goes whole
SHARD_WORDS, PIECE_WORDS = 100_000, 20_000
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text: ASCII letters and digits and everything above U+007F."""
    return text.translate(_WORD_BYTES).split()


class Automaton:
    """Suffix automaton of several word lists; state 0 is the empty word."""

    def __init__(self, items: list[list[int]], limit: int) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.limit = [-1], [0], limit
        for item in items:
            last = 0
            for word in item:
                last = self._extend(last, word)
        self.window = self._ancestors()
        self.short: dict[int, list[tuple[int, int]]] = {}
        holders: dict[int, set[int]] = {}
        for number, item in enumerate(items):
            state = 0
            for place, word in enumerate(item):
                state = self.next[state][word]
                if place + 1 >= limit:
                    holders.setdefault(self.window[state], set()).add(number)
            if 0 < len(item) < limit:
                self.short.setdefault(state, []).append((len(item), number))
        self.holders = {state: sorted(found) for state, found in holders.items()}
        self.marked = [-1] * len(self.link)  # nearest state on the suffix path that ends a short item
        for state in self._by_length():
            self.marked[state] = state if state in self.short else self.marked[self.link[state]] if state else -1
        self.least = min([limit] * bool(holders) + [size for found in self.short.values() for size, _ in found], default=0)

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A copy of ``target`` for the shorter words that end in it, entered from ``state`` upwards."""
        copy = self._new(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        target = self.next[last].get(word)
        if target is not None:
            direct = self.length[target] == self.length[last] + 1
            return target if direct else self._split(last, word, target)
        current = self._new(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = current
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            direct = self.length[target] == self.length[state] + 1
            self.link[current] = target if direct else self._split(state, word, target)
        return current

    def _by_length(self) -> list[int]:
        return sorted(range(len(self.link)), key=self.length.__getitem__)

    def _ancestors(self) -> list[int]:
        """For states of at least ``limit`` words: the suffix state that holds their last ``limit`` words."""
        window = [-1] * len(self.link)
        for state in self._by_length():
            if self.length[state] >= self.limit:
                above = self.link[state]
                window[state] = state if self.length[above] < self.limit else window[above]
        return window

    def walk(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(place, state, longest matching length) behind every word."""
        following, link, length = self.next, self.link, self.length
        state = matched = 0
        for place, word in enumerate(words):
            step = following[state].get(word)
            while step is None and state:
                state = link[state]
                matched = length[state]
                step = following[state].get(word)
            if step is not None:
                state, matched = step, matched + 1
            yield place, state, matched

    def hits(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int], int]:
        """(merged hit spans, items whose windows occur, longest match)."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        longest = 0
        for place, state, matched in self.walk(words):
            longest = max(longest, matched)
            reach = 0
            if matched >= self.limit:
                reach = self.limit
                items.update(self.holders[self.window[state]])
            mark = self.marked[state]
            while mark > 0:
                for size, number in self.short[mark]:
                    if size <= matched:
                        reach = max(reach, size)
                        items.add(number)
                mark = self.marked[self.link[mark]]
            if reach:
                start = place + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, place + 1))
        return spans, items, longest


class Index:
    """One shard's automaton with its vocabulary, item ids and word-pair filter."""

    def __init__(self, words: list[list[bytes]], ids: list[str | None], limit: int) -> None:
        self.known: dict[bytes, int] = {}
        number = self.known.setdefault
        items = [[number(word, len(self.known)) for word in item] for item in words]
        self.automaton, self.ids = Automaton(items, limit), ids
        pairs = np.array([pair for item in items for pair in zip(item, item[1:])], np.int64).reshape(-1, 2)
        self.mask = (1 << max(16, (16 * len(pairs)).bit_length())) - 1
        self.pairs = np.zeros(self.mask + 1, dtype=bool)
        self.pairs[self._slot(pairs[:, 0], pairs[:, 1])] = True

    def _slot(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left * 0x9E3779B1 + right * 0x85EBCA77 >> 7) & self.mask

    def search(self, texts: list[list[bytes]]) -> list[tuple[int, list[tuple[int, int]], list[int], int]]:
        """(text number, spans, items, longest match) of the texts with at least one window."""
        least = self.automaton.least
        if not least:
            return []
        get = self.known.get
        sizes = np.array([len(text) for text in texts], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        words = np.fromiter((get(word, -1) for text in texts for word in text), np.int64, int(first[-1]))
        joined = np.zeros(len(words), dtype=bool)  # the word goes on from the one before
        if len(words):
            known = words >= 0
            joined[1:] = known[1:] & known[:-1] & self.pairs[self._slot(words[:-1], words[1:])]
            joined[first[:-1][sizes > 0]] = False
            begin = np.flatnonzero(known & ~joined)
            last = known.copy()
            last[:-1] &= ~joined[1:]
            end = np.flatnonzero(last) + 1
            keep = end - begin >= least
            begin, end = begin[keep], end[keep]
        else:
            begin = end = np.zeros(0, np.int64)
        found: dict[int, tuple[list, set, int]] = {}
        for low, high, row in zip(begin.tolist(), end.tolist(), (np.searchsorted(first, begin, "right") - 1).tolist()):
            spans, items, longest = self.automaton.hits(words[low:high].tolist())
            if spans:
                shift = low - int(first[row])
                held = found.setdefault(row, ([], set(), 0))
                held[0].extend((start + shift, stop + shift) for start, stop in spans)
                held[1].update(items)
                found[row] = (held[0], held[1], max(held[2], longest))
        return [(row, spans, sorted(items), longest) for row, (spans, items, longest) in found.items()]


def _pieces(benchmark: DataFrame, id_column: str, text: str, limit: int, most: int) -> DataFrame:
    """(_id, _text, piece, words, size): words joined by spaces, at most ``most`` in a piece."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_texts(batch.column("_content"))
            content = data.tobytes()
            rows, piece, joined, size = [], [], [], []
            for row in range(batch.num_rows):
                words = words_of(content[offsets[row] : offsets[row + 1]])
                for place, start in enumerate(range(0, max(len(words) - limit + 1, min(len(words), 1)), most - limit + 1)):
                    part = words[start : start + most]
                    rows.append(row)
                    piece.append(place)
                    joined.append(b" ".join(part))
                    size.append(len(part))
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id").take(taken),
                    batch.column("_text").take(taken),
                    pa.array(piece, pa.int64()),
                    pa.array(joined, pa.binary()),
                    pa.array(size, pa.int64()),
                ],
                ["_id", "_text", "piece", "words", "size"],
            )

    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    items = benchmark.select(
        F.col(f"`{id_column}`").cast("string").alias("_id"), F.md5(content).alias("_text"), content.alias("_content")
    )
    return items.dropDuplicates(["_id", "_text"]).mapInArrow(
        split, "_id string, _text string, piece long, words binary, size long"
    )


def build_indexes(
    benchmark: DataFrame,
    id_column: str = "item_id",
    text: str = "text",
    limit: int = LIMIT,
    shard_words: int = SHARD_WORDS,
    piece_words: int = PIECE_WORDS,
) -> DataFrame:
    """(shard, index): pickled ``Index`` objects of at most ``shard_words`` + ``piece_words`` words each."""
    pieces = _pieces(benchmark, id_column, text, limit, max(piece_words, limit))
    placed = running_sums(pieces, [], ["_id", "_text", "piece"], ["size"])
    shard = F.floor((F.col("size_running") - F.col("size")) / F.lit(shard_words)).cast("long")

    def build(group: pa.Table) -> pa.Table:
        words = [joined.split(b" ") for joined in group.column("words").to_pylist()]
        index = Index(words, group.column("_id").to_pylist(), limit)
        return pa.table(
            {"shard": group.column("shard")[:1], "index": pa.array([pickle.dumps(index, protocol=5)], pa.binary())}
        )

    return cut(placed.withColumn("shard", shard).groupBy("shard").applyInArrow(build, "shard long, index binary"))


_LOADED: dict[str, Index] = {}


def _loaded(number: str, content) -> Index:
    """The index of a broadcast; a worker holds one at a time."""
    if number not in _LOADED:
        _LOADED.clear()
        _LOADED[number] = pickle.loads(content.value)
    return _LOADED[number]


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(_SPAN)),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("longest", T.LongType()),
]
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _stream(rows: DataFrame, content, every: bool) -> DataFrame:
    """The hits of the texts (last column) with the other columns; only texts with a hit unless ``every``."""
    number, names = uuid.uuid4().hex, rows.columns[:-1]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = _loaded(number, content)
            data, offsets = raw_texts(batch.column(batch.num_columns - 1))
            sizes, hits = [], {}
            for low, high in row_ranges(offsets):
                texts = [words_of(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(low, high)]
                sizes += map(len, texts)
                for row, spans, items, longest in index.search(texts):
                    ids = sorted({index.ids[item] for item in items} - {None})
                    hits[low + row] = ([{"start": a, "end": b} for a, b in spans], ids, longest)
            kept = range(batch.num_rows) if every else sorted(hits)
            found = [hits.get(row, ([], [], 0)) for row in kept]
            taken = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i).take(taken) for i in range(len(names))],
                    pa.array([sizes[row] for row in kept], pa.int64()),
                    pa.array([spans for spans, _, _ in found], _ARROW_SPANS),
                    pa.array([ids for _, ids, _ in found], pa.list_(pa.string())),
                    pa.array([longest for _, _, longest in found], pa.int64()),
                ],
                [*names, "n_words", "spans", "items", "longest"],
            )

    return rows.mapInArrow(search, T.StructType([*rows.schema.fields[:-1], *_FOUND]))


def _merge(spans: Column) -> Column:
    """Sorted spans with those that touch made one."""
    start = F.aggregate(
        F.array_sort(spans),
        F.array().cast(T.ArrayType(_SPAN)),
        lambda done, span: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= span["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(F.element_at(done, -1)["end"], span["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(span))),
    )
    return start


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    limit: int = LIMIT,
    keep: list[str] | None = None,
    **sizes: int,
) -> DataFrame:
    """(row, n_words, spans, items, longest): ``row`` is a struct of the columns ``keep`` (all if None).

    ``spans``: merged [start, end) of hit words; ``items``: sorted ids of the items with an occurring window.
    """
    spark = documents.sparkSession
    indexes = build_indexes(benchmark, item_column, item_text, limit, **sizes)
    # one index of bounded size at a time comes to the driver
    contents = [
        spark.sparkContext.broadcast(bytes(indexes.where(F.col("shard") == shard).first()["index"]))
        for shard in sorted(row[0] for row in indexes.select("shard").collect())
    ] or [spark.sparkContext.broadcast(pickle.dumps(Index([], [], limit)))]
    kept = documents.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{name}`") for name in kept]).alias("row")
    content = F.col(f"`{text}`").cast("string").alias("content")
    if len(contents) == 1:
        return _stream(documents.select(row, content), contents[0], True)

    named = F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("\x00null"))
    key = F.md5(F.concat(named, F.lit("\x00"), F.coalesce(content, F.lit("")))).alias("key")
    every = _stream(documents.select(row, key, content), contents[0], True)
    texts = documents.select(key, content)
    more = _stream(texts, contents[1], False)
    for other in contents[2:]:
        more = more.unionByName(_stream(texts, other, False))
    # a text's hits differ by shard only: equal ones of repeated rows become one
    table = (
        more.groupBy("key", "spans", "items", "longest")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("key")
        .agg(
            F.flatten(F.collect_list("spans")).alias("more_spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("more_items"),
            F.max("longest").alias("more_longest"),
            F.max("rows").alias("rows"),
        )
    )
    spread = every.withColumn("part", F.spark_partition_id())
    joined = lookup(spread, table, "key", weight="rows", spread="part")
    none = F.array()
    return joined.select(
        "row",
        "n_words",
        _merge(F.concat("spans", F.coalesce("more_spans", none.cast(T.ArrayType(_SPAN))))).alias("spans"),
        F.array_sort(F.array_union("items", F.coalesce("more_items", none.cast("array<string>")))).alias("items"),
        F.greatest("longest", F.coalesce("more_longest", F.lit(0))).alias("longest"),
    )


def hit_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["start"])


def scan_contamination(
    documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", **settings
) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated, longest of every document."""
    found = find_contamination(documents, benchmark, id_column, text, keep=[id_column], **settings)
    return found.select(
        F.col("row")[id_column].alias(id_column),
        "n_words",
        hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "longest",
    )


def without_spans(text: str, spans: list[dict], limit: int) -> str:
    """``text`` without the characters from the first to the last word of every span of ``limit`` words."""
    places = [match.span() for match in _WORD.finditer(text)]
    kept, at = [], 0
    for span in spans:
        if span["end"] - span["start"] >= limit:
            kept.append(text[at : places[span["start"]][0]])
            at = places[span["end"] - 1][1]
    return "".join([*kept, text[at:]])


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    limit: int = LIMIT,
    coverage: float = COVERAGE,
    **settings,
) -> DataFrame:
    """The documents without their hit spans of at least ``limit`` words; covered beyond ``coverage`` they go.

    All columns stay as they are but the text of the documents that lose a span.
    """
    names, schema = documents.columns, documents.schema
    found = find_contamination(documents, benchmark, id_column, text, limit=limit, **settings)
    left = found.where(hit_words() <= F.lit(coverage) * F.col("n_words")).select("row", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            spans = batch.column("spans").to_pylist()
            arrays = [rows.field(i) for i in range(len(names))]
            place = names.index(text)
            texts = arrays[place]
            if any(spans):
                plain = texts.to_pylist()
                plain = [without_spans(t, s, limit) if s else t for t, s in zip(plain, spans)]
                texts = pa.array(plain, texts.type)
            arrays[place] = texts
            yield pa.RecordBatch.from_arrays(arrays, names)

    return left.mapInArrow(remove, T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]))
