"""Texts of Arrow batches as flat arrays: bytes, words and word hashes without a Python loop per row.

A text column is cut into blocks of about ``BLOCK_BYTES``; a longer text is a block of its own.
Words are runs of ASCII letters and digits and of all characters above U+007F, with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    values = values.astype(np.uint64)
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case byte, byte belongs to a word, random value of the byte)."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    member = np.zeros(256, dtype=bool)
    member[48:58] = member[65:91] = member[97:123] = member[128:] = True
    return lower, member, mix(np.arange(1, 257, dtype=np.uint64) << np.uint64(17))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, size: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < size:
        steps = np.full(max(size, BLOCK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= BLOCK_BYTES + 1:
            _POWERS[base] = have  # those of a very long text are not kept
    return have


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all rows, offsets of the rows); null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, content = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(places, wide)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_ranges(
    offsets: np.ndarray, limit: int = BLOCK_BYTES, most: int = 1 << 30
) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``most`` rows with at most ``limit`` bytes, or one longer row."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), rows, start + most)
        yield start, end
        start = end


class Words:
    """The words of a block of texts.

    ``start``/``end``: byte places in the block; ``row``: the row of each word;
    ``first``: for each row the index of its first word (one more entry than rows);
    ``hash``: a 64-bit hash of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        lower, member, value = _tables()
        self.data, self.offsets = lower[data], offsets
        inside = member[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
        after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
        if not len(data):
            before = after = inside
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        weighed = value[self.data] * _powers(_BASE, len(data) + 1)[: len(data)]
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighed, dtype=np.uint64)])
        self._inverse = _powers(_BASE_INVERSE, len(data) + 1)
        self.hash = self.hash_of(self.start, self.end)

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges of the block; equal for equal bytes wherever they stand."""
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start] + np.uint64(7))

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every run of ``size`` words, index of the first gram per row)."""
        counts = np.maximum(np.diff(self.first) - size + 1, 0)
        first = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], counts)
        total = np.zeros(len(at), dtype=np.uint64)
        for place in range(size):
            total = total * np.uint64(0xD6E8FEB86659FD93) + self.hash[at + place]
        return mix(total), first


SHINGLE_ROWS = 1000  # rows of a block of shingles: the row fits the upper 10 bits


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 54-bit hash, count) of the distinct word shingles, by row, then hash.

    A text of fewer words than ``size`` has one shingle, of all its words; no word: none.
    """
    grams, first = words.grams(size)
    rows = [np.repeat(np.arange(len(first) - 1), np.diff(first))]
    every = [grams]
    many = np.diff(words.first)
    for length in range(1, size):
        short = np.flatnonzero(many == length)
        if len(short):
            total = np.full(len(short), length, dtype=np.uint64)
            for place in range(length):
                total = total * np.uint64(0xD6E8FEB86659FD93) + words.hash[words.first[short] + place]
            rows.append(short)
            every.append(mix(total))
    key = np.concatenate(rows).astype(np.uint64) << np.uint64(54) | np.concatenate(every) >> np.uint64(10)
    key, count = np.unique(key, return_counts=True)
    return (key >> np.uint64(54)).astype(np.int64), key & np.uint64((1 << 54) - 1), count


def word_blocks(
    column: pa.Array, limit: int = BLOCK_BYTES, most: int = 1 << 30
) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of every block of a text column."""
    data, offsets = raw_texts(column)
    for start, end in row_ranges(offsets, limit, most):
        part = offsets[start : end + 1]
        yield start, end, Words(data[part[0] : part[-1]], part - part[0])


def phrase_hashes(phrase: str) -> np.ndarray:
    """Word hashes of one phrase, for tables of constants."""
    return Words(*raw_texts(pa.array([phrase]))).hash
