"""Records of CSV files whose quoted fields may hold line breaks, read by many tasks a file.

A task that starts in the middle of a file cannot know whether it is inside quotes. So every split is read twice:

1. For each split, in which state (inside quotes or not) it ends for either state it may begin in. The
   states compose, so the true one before every split is a running composition over the splits of a file.
2. With it, every task cuts its lines into records. What hangs over a split's edges, an end without a
   beginning or a beginning without an end, is small and is put together across splits.

A quote opens a field only where the field begins, and a doubled quote inside is one quote. Files with different
headers are one scan: values are taken by the column positions of their own file's header, its first line.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowproof.operators.lookup import BROADCAST_BYTES, lookup, measure
from rowproof.session import cut

_SPLIT = "file string, block long"


def ends_open(line: str, open_: bool) -> bool:
    """Whether ``line``, begun inside quotes or not, ends inside quotes."""
    at = 0
    while True:
        if open_:
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == '"':
                at += 2
                continue
            at, open_ = at + 1, False
        else:
            at = line.find('"', at)
            if at < 0:
                return False
            open_ = at == 0 or line[at - 1] == ","
            at += 1


def read_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file, block, line): the lines of every split in their order."""
    lines = spark.read.option("pathGlobFilter", pattern).option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"),
    )


def _split_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: lines, the end state for either beginning, and the first line of a file."""
    found: dict[tuple[str, int], list] = {}
    for batch in batches:
        files, blocks, lines = (batch.column(i).to_pylist() for i in range(3))
        for file, block, line in zip(files, blocks, lines):
            held = found.get((file, block))
            if held is None:
                held = found[file, block] = [0, False, True, line if block == 0 else None]
            held[0] += 1
            if '"' in line:
                held[1], held[2] = ends_open(line, held[1]), ends_open(line, held[2])
    keys, states = list(found), list(found.values())
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([key[0] for key in keys], pa.string()),
            pa.array([key[1] for key in keys], pa.int64()),
            pa.array([state[0] for state in states], pa.int64()),
            pa.array([state[1] for state in states], pa.bool_()),
            pa.array([state[2] for state in states], pa.bool_()),
            pa.array([state[3] for state in states], pa.string()),
        ],
        ["file", "block", "lines", "from_closed", "from_open", "header"],
    )


def split_states(lines: DataFrame) -> DataFrame:
    """(file, block, key, lines, header, begins_open) of every split; begins_open: it starts inside quotes."""
    states = lines.mapInArrow(
        _split_states, f"{_SPLIT}, lines long, from_closed boolean, from_open boolean, header string"
    )
    # a file's splits are few: its size by the split size; packed as (state if closed, state if open)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    steps = F.collect_list(F.struct("from_closed", "from_open")).over(earlier)
    begins = F.aggregate(
        steps, F.lit(False), lambda state, step: F.when(state, step["from_open"]).otherwise(step["from_closed"])
    )
    return states.select(
        "file", "block", _split_key().alias("key"), "lines", "header", begins.alias("begins_open")
    )


def _split_key():
    return F.concat(F.col("block").cast("string"), F.lit(" "), F.col("file"))


# kinds of pieces: a whole record, the end of one begun in an earlier split, a beginning, lines of one that only passes
WHOLE, END, BEGIN, PASSING, HEADER = 0, 1, 2, 3, 4


def _cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, kind, record): the lines of every split put together to records and loose ends."""
    now, open_, held, inherited, first = None, False, [], False, False
    out: tuple[list, list, list, list] = ([], [], [], [])

    def give(kind: int) -> None:
        for column, value in zip(out, (*now, kind, "\n".join(held))):
            column.append(value)
        held.clear()

    def batch_of() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
        made = pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(out, kinds)], ["file", "block", "kind", "record"]
        )
        for column in out:
            column.clear()
        return made

    for batch in batches:
        files, blocks, lines, begins = (batch.column(i).to_pylist() for i in range(4))
        for file, block, line, begin in zip(files, blocks, lines, begins):
            if (file, block) != now:
                if held:
                    give(PASSING if inherited else BEGIN)
                now, open_, inherited, first = (file, block), bool(begin), bool(begin), block == 0
            held.append(line)
            open_ = ends_open(line, open_) if '"' in line else open_
            if not open_:
                give(END if inherited else HEADER if first else WHOLE)
                inherited = first = False
        yield batch_of()
    if held:
        give(PASSING if inherited else BEGIN)
    yield batch_of()


def csv_records(lines: DataFrame, states: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(file, record): the records of all files as text without the headers, in no order."""
    known = states.select("key", "lines", "begins_open")
    marked = lines.withColumn("key", _split_key())
    if measure(known, "key", "lines")[0] <= broadcast_bytes:
        marked = marked.join(F.broadcast(known), "key")  # the lines stay where and as they are
    else:
        # a split's lines come together again, in their order
        marked = marked.withColumn("at", F.monotonically_increasing_id()).join(known, "key")
        marked = marked.repartition("key").sortWithinPartitions("key", "at")
    pieces = marked.select("file", "block", "line", "begins_open").mapInArrow(
        _cut_records, f"{_SPLIT}, kind int, record string"
    )
    pieces = cut(pieces)
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "record")
    # few rows: at most two a split
    loose = pieces.where(F.col("kind").isin(END, BEGIN, PASSING))
    order = Window.partitionBy("file").orderBy("block", "_rank")
    place = F.when(F.col("kind") == BEGIN, 1).otherwise(0)  # of one split the end stands before the beginning
    numbered = loose.withColumn("_rank", place).withColumn("_number", F.sum(place).over(order))
    joined = numbered.groupBy("file", "_number").agg(
        F.array_sort(F.collect_list(F.struct("block", "_rank", "record"))).alias("_parts")
    )
    together = joined.select("file", F.array_join(F.col("_parts.record"), "\n").alias("record"))
    return whole.unionByName(together)


def parse_header(line: str) -> tuple[str, ...]:
    return tuple(next(csv.reader([line.removeprefix("﻿").rstrip("\r")]), []))


def read_csv_records(
    spark: SparkSession,
    path: str,
    pattern: str,
    columns: Sequence[str] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """All files as one table of strings, in a number of jobs that does not depend on that of the files.

    ``columns``: the declared list; what a file lacks is null, what is not declared is left out. By default all
    columns of all headers, in the order in which the files, by name, bring them up.
    """
    lines = read_lines(spark, path, pattern)
    states = cut(split_states(lines))
    # one row per different header, however many files have it
    headers = (
        states.where(F.col("header").isNotNull())
        .groupBy("header")
        .agg(F.min("file").alias("file"))
        .orderBy("file")
        .collect()
    )
    parsed = [(row["header"], parse_header(row["header"])) for row in headers]
    if not parsed:
        raise FileNotFoundError(f"No file with a header matches {pattern} in {path}")
    names = list(columns or dict.fromkeys(name for _, header in parsed for name in header))
    widest = max(len(header) for _, header in parsed)
    fields = ", ".join(f"_{i} string" for i in range(widest))
    records = csv_records(lines, states, broadcast_bytes)
    record = F.regexp_replace("record", "\r$", "")
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    read = records.where(F.trim(record) != "")
    if len(parsed) > 1:
        own = states.groupBy("file").agg(F.max("header").alias("_header"), F.sum("lines").alias("_lines"))
        read = lookup(read, own, "file", weight="_lines", spread="record")
    else:
        read = read.withColumn("_header", F.lit(parsed[0][0]))
    values = read.select("_header", F.from_csv(record, fields, options).alias("_v"))

    def value(name: str):
        found = None
        for header, held in parsed:
            if name in held:
                own = F.when(F.col("_header") == header, F.col(f"_v._{held.index(name)}"))
                found = own if found is None else F.coalesce(found, own)
        return (F.lit(None).cast("string") if found is None else found).alias(name)

    return values.select(*[value(name) for name in names])
