"""Best-fit packing by minimum bin slack.

Only piece lengths matter for packing, and there are at most ``SIZE`` of them. The executors tokenize and
cut the documents; the driver sees the histogram of lengths. Per bin it takes the largest length left and
finds the fullest feasible combination of available lengths by subset sums over a bit set. That pattern is
removed as often as the histogram allows, so every round uses up a length and the number of rounds does not
grow with the data. The pieces of each length are numbered without a global sort, and number and
length give the sequence and the offset.

Defined cases: null and empty texts are the end id alone; only documents longer than a sequence are cut; rows
are packed one by one, repeated ones too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowproof.llm.blocks import raw_texts, row_ranges
from rowproof.session import cut

SIZE = 2048
END = b"\0\0\0\0"
KNOWN_WORDS = 400_000  # encoded words a worker remembers
TOGETHER = 2000  # new words encoded as one text
TOKENIZER = "word_bpe_49k.json"
MARKS = ".,;:!?#$%&*"  # none of them begins a contraction or can combine with a letter


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of texts as little-endian bytes.

    The vocabulary drops white space and never joins across it, so a text's ids are those of its
    words one after another; words come again and again, and their ids are kept.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.known: dict[str, bytes] = {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.last[[number for token, number in vocabulary.items() if token.endswith("</w>")]] = True
        self.apart: dict[str, bool] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts. The tokenizer lower-cases: doing A-Z first makes more words known.

        It composes accents first, though, and some (U+0300 to U+036F) compose with small letters only.
        """
        split = [
            (text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower())
            .decode("utf-8", "replace")
            .replace("\n", " ")
            .split(" ")
            for text in texts
        ]
        new = set().union(*split).difference(self.known)
        if new:
            if len(self.known) + len(new) > KNOWN_WORDS:
                self.known = {"": b""}
                new = set().union(*split)
            self._learn(new)
        known = self.known.__getitem__
        return [b"".join(map(known, words)) for words in split]

    def _stands_apart(self, character: str) -> bool:
        """Whether every mark after ``character`` is a token run of its own, by the tokenizer's own answer.

        Not all letters are: some end in a combining mark once normalised, and that joins the mark.
        """
        if character not in self.apart:
            one, *rest = (
                found.ids
                for found in self.tokenizer.encode_batch_fast(
                    [character, *MARKS, *(character + mark for mark in MARKS)], add_special_tokens=False
                )
            )
            marks, both = rest[: len(MARKS)], rest[len(MARKS) :]
            self.apart[character] = all(one + mark == found for mark, found in zip(marks, both))
        return self.apart[character]

    def _learn(self, words: set[str]) -> None:
        """A mark after a letter or digit is a token run of its own: ``word,`` is ``word`` and ``,``."""
        stems = {
            word: stem
            for word in words
            if (stem := word.rstrip(MARKS)) != word and stem and stem[-1].isalnum() and self._stands_apart(stem[-1])
        }
        parts = set(words).difference(stems)
        for word, stem in stems.items():
            parts.add(stem)
            parts.add(word[len(stem) :])
        new = parts.difference(self.known)
        plain = [word for word in new if word.isalpha()]
        for start in range(0, len(plain), TOGETHER):
            some = plain[start : start + TOGETHER]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(ends) == len(some):  # each word ends once: these are its own ids
                content, begin = ids.tobytes(), 0
                for word, end in zip(some, ends.tolist()):
                    self.known[word] = content[begin:end]
                    begin = end
        rest = list(new.difference(self.known))
        for word, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.known[word] = np.array(found.ids, "<u4").tobytes()
        for word, stem in stems.items():
            self.known[word] = self.known[stem] + self.known[word[len(stem) :]]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut_documents(documents: DataFrame, path: str, id_column: str, text: str, size: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32, _task, _n): ``_n`` counts a task's pieces of each length."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            data, offsets = raw_texts(batch.column(1))
            content = data.tobytes()
            rows, piece, start, length, crc, number = [], [], [], [], [], []
            encoded = (
                ids
                for low, high in row_ranges(offsets)
                for ids in encoder.encode([content[offsets[i] : offsets[i + 1]] for i in range(low, high)])
            )
            for row, ids in enumerate(encoded):
                ids += END
                for place, begin in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[begin : begin + 4 * size]
                    many = len(part) // 4
                    rows.append(row)
                    piece.append(place)
                    start.append(begin // 4)
                    length.append(many)
                    crc.append(zlib.crc32(part))
                    number.append(seen[many])
                    seen[many] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array([task] * len(rows), pa.int32()),
                    pa.array(number, pa.int64()),
                ],
                [id_column, "piece", "start", "length", "ids_crc32", "_task", "_n"],
            )

    kind = documents.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long, _task int, _n long"
    return documents.select(f"`{id_column}`", F.col(f"`{text}`").cast("string")).mapInArrow(pieces, schema)


def fullest(counts: np.ndarray, present: list[int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``room``: length -> how often.

    ``present``: the lengths with a count, descending.
    """
    reach, taken = 1, []  # bit s: some combination adds up to s
    mask = (1 << room + 1) - 1
    for length in present:
        if length > room:
            continue
        left, copies = int(min(counts[length], room // length)), 1
        while left and not reach >> room & 1:
            copies = min(copies, left)
            taken.append((length, copies, reach))
            reach |= reach << length * copies & mask
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, copies, before in reversed(taken):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + copies
            total -= length * copies
    return used


def plan_bins(histogram: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> how often in the bin) and how many bins have them."""
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, number in histogram.items():
        counts[length] = number
    present = [int(length) for length in np.flatnonzero(counts)[::-1]]
    plan = []
    while present:
        largest = present[0]
        counts[largest] -= 1
        pattern = fullest(counts, present, size - largest)
        counts[largest] += 1
        pattern[largest] = pattern.get(largest, 0) + 1
        times = min(int(counts[length]) // number for length, number in pattern.items())
        for length, number in pattern.items():
            counts[length] -= number * times
        plan.append((pattern, times))
        present = [length for length in present if counts[length]]
    return plan


def _slots(plan: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """Sorted (length and first number as one key), first sequence and offset of every pattern slot."""
    given: dict[int, int] = {}
    key, sequence, offset, first = [], [], [], 0
    for pattern, times in plan:
        at = 0
        for length in sorted(pattern, reverse=True):
            for _ in range(pattern[length]):
                number = given.get(length, 0)
                key.append(length << 48 | number)
                sequence.append(first)
                offset.append(at)
                given[length] = number + times
                at += length
        first += times
    order = np.argsort(np.array(key, np.int64), kind="stable")
    return tuple(np.array(values, np.int64)[order] for values in (key, sequence, offset))


def pack(
    documents: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    size: int = SIZE,
    path: str | None = None,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = documents.sparkSession
    pieces = cut(cut_documents(documents, path or tokenizer_path(), id_column, text, size))
    per_task = pieces.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_many"))
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select(
        "_task", "length", F.coalesce(F.sum("_many").over(earlier), F.lit(0)).alias("_before")
    )
    # at most `size` rows
    histogram = {row[0]: row[1] for row in pieces.groupBy("length").count().collect()}
    slots = spark.sparkContext.broadcast(_slots(plan_bins(histogram, size)))
    names = [id_column, "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequences, offsets = slots.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("_number").to_numpy()
            slot = np.searchsorted(keys, length << 48 | number, side="right") - 1
            copy = number - (keys[slot] & ((1 << 48) - 1))
            arrays = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(sequences[slot] + copy), pa.array(offsets[slot])],
                [*names, "sequence_id", "offset"],
            )

    kind = documents.schema[id_column].dataType.simpleString()
    schema = (
        f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long, "
        "sequence_id long, offset long"
    )
    return (
        pieces.join(before, ["_task", "length"])
        .select(*[f"`{name}`" for name in names], (F.col("_before") + F.col("_n")).alias("_number"))
        .mapInArrow(place, schema)
    )
