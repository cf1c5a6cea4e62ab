"""Periodic runs of words by longest common extensions (LCE) over a difference cover.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least
max(6, 4 q) words that no neighbouring word extends. The words of a block of texts form one array of numbers,
with a number of its own behind every text.

* Harmonic grid: for every period q only the words at multiples of q are compared with the next one of
  the grid. A run holds three such pairs in a row, so n/q comparisons a period, n log n in all, find every run.
* Difference cover: only suffixes that start at a residue in ``COVER`` modulo ``MODULUS`` are sorted, by their
  first ``MODULUS`` words and then by doubling. An LCE compares fewer than ``MODULUS`` words until both suffixes
  are sampled ones, and takes the rest as a range minimum of their neighbours' common prefixes (sparse table).
* The grid pair's LCE forwards and backwards give the stretch; of equal stretches the smallest period counts.

Texts are scanned where they lie, without a shuffle. Defined cases: null and empty texts have no word and no
run; repeated rows each get their result; a text longer than a block is a block of its own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.llm.blocks import raw_texts, row_ranges

LEAST_WORDS, LEAST_PERIODS = 6, 4
# fixed values: a perfect difference set, every residue is a difference of two members
MODULUS = 31
COVER = (0, 1, 3, 8, 12, 18)
CANDIDATES = 1 << 19  # grid pairs extended together; those of one period always are


def _reach() -> np.ndarray:
    """For two residues the smallest shift that brings both into the cover."""
    inside = np.isin(np.arange(2 * MODULUS) % MODULUS, COVER)
    shift = np.zeros((MODULUS, MODULUS), np.int64)
    for i in range(MODULUS):
        for j in range(MODULUS):
            shift[i, j] = np.flatnonzero(inside[i : i + MODULUS] & inside[j : j + MODULUS])[0]
    return shift


_SHIFT = _reach()
_PLACE = np.full(MODULUS, -1, np.int64)  # residue -> its number in the cover
_PLACE[list(COVER)] = np.arange(len(COVER))


def _dense(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks of rows under several keys, the most significant first; equal rows share a rank."""
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), dtype=np.int64)
    for key in keys:
        sorted_key = key[order]
        fresh[1:] |= sorted_key[1:] != sorted_key[:-1]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(fresh)
    return ranks


class CoverExtensions:
    """Longest common extensions of the suffixes of ``words``, whose last number occurs once."""

    def __init__(self, words: np.ndarray) -> None:
        size = len(words)
        # beyond the end: numbers that differ from everything and from one another
        self.words = np.concatenate([words, -(2**62) - np.arange(2 * MODULUS + 1)])
        blocks = -(-size // MODULUS)
        places = (np.arange(blocks)[:, None] * MODULUS + np.array(COVER)[None, :]).ravel()
        self.samples = places[places < size]
        self.levels = [_dense([self.words[self.samples + i] for i in range(MODULUS)])]
        step = len(COVER)  # samples from one suffix to the one MODULUS words on
        while len(self.samples) and self.levels[-1].max() < len(self.samples) - 1:
            ranks = self.levels[-1]
            following = np.full(len(ranks), -1, np.int64)
            following[: max(len(ranks) - step, 0)] = ranks[step:]
            self.levels.append(_dense([ranks, following]))
            step *= 2
        self.rank = self.levels[-1]
        order = np.argsort(self.rank, kind="stable")
        common = np.zeros(len(order), np.int64)
        if len(order) > 1:
            common[1:] = self._common_prefix(order[:-1], order[1:])
        self.table = [common]  # table[k][i]: minimum of common[i : i + 2**k]
        while 2 ** len(self.table) <= len(common):
            half, above = 2 ** (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(above[:-half], above[half:]))

    def _common_prefix(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Common prefixes of sampled suffixes (numbers of samples), from the doubling's ranks."""
        left, right = left.copy(), right.copy()
        total = np.zeros(len(left), np.int64)
        many = len(self.samples)
        for level in range(len(self.levels) - 1, -1, -1):
            ranks, step = self.levels[level], len(COVER) << level
            inside = np.maximum(left, right) < many
            equal = inside.copy()
            equal[inside] = ranks[left[inside]] == ranks[right[inside]]
            total[equal] += MODULUS << level
            left[equal] += step
            right[equal] += step
        inside = np.flatnonzero(np.maximum(left, right) < many)
        total[inside] += self._compare(
            self.samples[left[inside]], self.samples[right[inside]], np.full(len(inside), MODULUS)
        )
        return total

    def _compare(self, left: np.ndarray, right: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from the places ``left`` and ``right``, at most ``most``."""
        equal = np.zeros(len(left), np.int64)
        active = np.flatnonzero(most > 0)
        while len(active):
            at = equal[active]
            same = self.words[left[active] + at] == self.words[right[active] + at]
            active = active[same]
            equal[active] += 1
            active = active[equal[active] < most[active]]
        return equal

    def _minimum(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Range minimum of the common prefixes over [low, high]."""
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        found = np.empty(len(low), np.int64)
        for k in np.unique(level):
            of = level == k
            row = self.table[k]
            found[of] = np.minimum(row[low[of]], row[high[of] - 2**k + 1])
        return found

    def extend(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of the suffixes at ``left`` and ``right`` (never equal)."""
        shift = _SHIFT[left % MODULUS, right % MODULUS]
        total = self._compare(left, right, shift)
        on = np.flatnonzero((total == shift) & (np.maximum(left, right) + shift < len(self.words) - 2 * MODULUS - 1))
        first, second = (self._sample(place[on] + shift[on]) for place in (left, right))
        low, high = np.minimum(self.rank[first], self.rank[second]), np.maximum(self.rank[first], self.rank[second])
        total[on] += self._minimum(low + 1, high)
        return total

    def _sample(self, places: np.ndarray) -> np.ndarray:
        return places // MODULUS * len(COVER) + _PLACE[places % MODULUS]


def _grid_pairs(words: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) in portions: middle pairs of three equal neighbours in a row on the grid of each period."""
    places, periods, held = [], [], 0
    for period in range(1, longest // LEAST_PERIODS + 1):
        grid = words[::period]
        equal = grid[1:] == grid[:-1]
        three = np.flatnonzero(equal[2:] & equal[1:-1] & equal[:-2])
        if len(three):
            places.append((three + 1) * period)
            periods.append(np.full(len(three), period, np.int64))
            held += len(three)
        if held > CANDIDATES:
            yield np.concatenate(places), np.concatenate(periods)
            places, periods, held = [], [], 0
    if held:
        yield np.concatenate(places), np.concatenate(periods)


def _stretches(starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (start, length, smallest period), by start, length."""
    order = np.lexsort((periods, lengths, starts))
    starts, lengths, periods = starts[order], lengths[order], periods[order]
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (starts[1:] != starts[:-1]) | (lengths[1:] != lengths[:-1])
    return starts[fresh], lengths[fresh], periods[fresh]


def find_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start, period.

    ``words``: numbers (>= 0) of the words of all texts; ``sizes``: words of each text.
    """
    none = np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    text = np.repeat(np.arange(len(sizes)), sizes)
    begins = first[:-1] + np.arange(len(sizes))
    # every text ends in a number of its own
    apart = np.empty(len(words) + len(sizes), np.int64)
    apart[np.arange(len(words)) + text] = words
    apart[begins + sizes] = -1 - np.arange(len(sizes))
    some = np.zeros(len(sizes), dtype=bool)
    for place, _ in _grid_pairs(apart, int(sizes.max(initial=0))):
        some[np.searchsorted(begins, place, side="right") - 1] = True
    chosen = np.flatnonzero(some)
    if not len(chosen):
        return none, none, none, none
    # only texts with a candidate are sorted
    lengths = sizes[chosen] + 1
    moved = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(moved[-1]) + np.repeat(begins[chosen] - moved[:-1], lengths)
    small = apart[at]
    forwards = CoverExtensions(small)
    # mirrored, the ends stand before their texts; the one of the last text goes to the end
    backwards = CoverExtensions(np.concatenate([small[-2::-1], small[-1:]]))
    last = len(small) - 2
    found = none, none, none
    for left, period in _grid_pairs(small, int(lengths.max())):
        right = left + period
        end = right + forwards.extend(left, right)
        start = left + 1 - backwards.extend(last - left, last - right)
        enough = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        portion = start[enough], (end - start)[enough], period[enough]
        found = _stretches(*map(np.concatenate, zip(found, portion)))
    starts, length, period = found
    number = np.searchsorted(moved, starts, side="right") - 1
    order = np.lexsort((period, starts))
    number = number[order]
    return chosen[number], starts[order] - moved[number], length[order], period[order]


def keep_words(size: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: a run (start, length, period) drops all behind its first period."""
    edges = np.zeros(size + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document with the repeats that its id plants in one of ten; a null id plants none."""
    if doc_id is None or not words:
        return words
    mark = zlib.crc32(str(doc_id).encode())
    if mark % 10:
        return words
    many, rest = len(words), mark // 10
    start = rest % many
    period = 1 + (many - start) // (3 + rest % 8)
    tail = words[start : start + period]
    copies = -(-(many - start) // period)
    return words[:start] + (tail * copies)[: many - start]


def _runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text, by start, then period."""
    numbers: dict[bytes, int] = {}
    number = numbers.setdefault
    sizes = np.array([len(words) for words in texts], np.int64)
    flat = np.fromiter((number(word, len(numbers)) for words in texts for word in words), np.int64, int(sizes.sum()))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for text, *run in zip(*(values.tolist() for values in find_runs(flat, sizes))):
        found[text].append(tuple(run))
    return found


def _blocks(column: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words of its texts) of every block; words are split by ASCII white space."""
    data, offsets = raw_texts(column)
    for low, high in row_ranges(offsets):
        yield low, [data[offsets[i] : offsets[i + 1]].tobytes().split() for i in range(low, high)]


def repeat_runs(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, runs): all runs of every document as (start, length, period), in words."""
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs = [], []
            for _, texts in _blocks(batch.column(1)):
                sizes += map(len, texts)
                for found in _runs_of(texts):
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, run)], [id_column, "n_words", "runs"]
            )

    kind = documents.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>"
    return documents.select(f"`{id_column}`", F.col(f"`{text}`").cast("string")).mapInArrow(scan, schema)


def collapse_repeats(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents, in each with a run the text collapsed to its kept words joined by one space."""
    names = documents.columns

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = names.index(text)
        for batch in batches:
            column = batch.column(place)
            changed = {}
            for low, texts in _blocks(column):
                for row, (words, runs) in enumerate(zip(texts, _runs_of(texts))):
                    if runs:
                        kept = np.flatnonzero(keep_words(len(words), runs)).tolist()
                        changed[low + row] = b" ".join([words[i] for i in kept]).decode()
            if changed:
                column = pa.array([changed.get(i, t) for i, t in enumerate(column.to_pylist())], column.type)
            arrays = [column if i == place else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    fields = [T.StructField(f.name, f.dataType, True) for f in documents.schema]
    return documents.mapInArrow(collapse, T.StructType(fields))


_NO_RUNS = hashlib.sha256(b"").hexdigest()
_DIGEST = [
    ("n_runs", pa.int64()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("period", pa.int64()),
    ("exponent_milli", pa.int64()),
    ("runs_sha256", pa.string()),
    ("collapsed_sha256", pa.string()),
]


def _digest(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    if not runs:
        return 0, None, None, None, None, _NO_RUNS, hashlib.sha256(b" ".join(words)).hexdigest()
    start, length, period = max(runs, key=lambda run: (run[1], -run[0], -run[2]))
    lines = "".join([f"{s},{n},{q}\n" for s, n, q in runs]).encode()
    kept = np.flatnonzero(keep_words(len(words), runs)).tolist()
    collapsed = b" ".join([words[i] for i in kept])
    return (
        len(runs),
        start,
        length,
        period,
        1000 * length // period,
        hashlib.sha256(lines).hexdigest(),
        hashlib.sha256(collapsed).hexdigest(),
    )


def scan_repeats(documents: DataFrame, id_column: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """Number of runs, the longest one and digests of all runs and of the collapsed text of every document.

    ``plant``: look at the text that ``planted`` makes of a document with an integer id.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist() if plant else []
            rows = []
            for low, texts in _blocks(batch.column(1)):
                if plant:
                    texts = [planted(words, ids[low + row]) for row, words in enumerate(texts)]
                rows += map(_digest, texts, _runs_of(texts))
            columns = list(zip(*rows)) or [()] * len(_DIGEST)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(values, kind) for values, (_, kind) in zip(columns, _DIGEST)]],
                [id_column, *[name for name, _ in _DIGEST]],
            )

    kind = documents.schema[id_column].dataType.simpleString()
    columns = ", ".join(f"{name} {'long' if type_ == pa.int64() else 'string'}" for name, type_ in _DIGEST)
    return documents.select(f"`{id_column}`", F.col(f"`{text}`").cast("string")).mapInArrow(
        scan, f"`{id_column}` {kind}, {columns}"
    )
