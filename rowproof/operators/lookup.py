"""Joining a large table with a table of unique keys, whatever the key distribution."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowproof.session import cut, side_by_side

BROADCAST_BYTES = 32 * 1024 * 1024
FEWEST_PORTIONS, MOST_PORTIONS = 64, 4096
ROWS_PER_TASK = 1_000_000
_SALT = "_salt"


def measure(table: DataFrame, key: str, weight: str) -> tuple[int, int]:
    """(bytes, total weight) of a lookup table; one aggregate."""
    size = F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(8))
    size = size + 16 * len(table.columns) + 16
    return tuple(
        table.agg(
            F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(weight), F.lit(0))
        ).first()
    )


def settle(table: DataFrame, key: str, weight: str) -> tuple[DataFrame, tuple[int, int]]:
    """Write a lookup table and measure what was written."""
    written = cut(table)
    return written, measure(written, key, weight)


def settle_all(
    tables: Sequence[tuple[DataFrame, str, str]],
) -> list[tuple[DataFrame, tuple[int, int]]]:
    """``settle`` for independent tables, as jobs that run side by side."""
    return side_by_side([partial(settle, *table) for table in tables])


def rows_per_task(total: int) -> int:
    """Rows of one key that stay together: a million, within 1/4096 and 1/64 of all rows."""
    most, least = -(-total // FEWEST_PORTIONS), -(-total // MOST_PORTIONS)
    return max(1, min(most, max(ROWS_PER_TASK, least)))


def lookup(
    frame: DataFrame,
    table: DataFrame,
    key: str,
    *,
    weight: str,
    spread: str,
    measured: tuple[int, int] | None = None,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Left join ``frame`` with ``table`` (unique ``key``), keeping every row of ``frame``.

    ``weight`` counts how many rows of ``frame`` hold the key. The table is written and
    measured, unless the caller did so: a small one is broadcast, so the wide side never
    moves. Otherwise both sides are shuffled; a key with more rows than one task should hold
    gets as many salts as it has such portions, null keys get ``MOST_PORTIONS``, and rows are
    spread over the salts by a hash of the ``spread`` column.
    """
    if measured is None:
        table, measured = settle(table, key, weight)
    size, total = measured
    if size <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        return frame.join(F.broadcast(table), key, "left")

    portion = rows_per_task(total)
    salts = F.ceil(F.col(weight) / portion).cast("int")
    heavy = F.col(weight) > portion
    # at most MOST_PORTIONS keys can each hold more than a portion of the rows
    hot = table.where(heavy).select(key, salts.alias("_salts"))
    many = F.coalesce("_salts", F.when(F.col(key).isNull(), F.lit(MOST_PORTIONS)), F.lit(1))
    salted = frame.join(F.broadcast(hot), key, "left").withColumn(
        _SALT, F.pmod(F.xxhash64(spread), many).cast("int")
    )
    every = F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)
    copies = table.withColumn(_SALT, F.explode(every))
    return salted.join(copies, [key, _SALT], "left").drop(_SALT, "_salts")
