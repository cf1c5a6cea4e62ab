"""Positions, running sums, quantiles and ranks over data that has no row order.

Nothing here uses a window without a partition. Rows are range partitioned on a
total order, written once, and every partition gets the offset of the partitions
before it. The driver sees one number per partition (and group), never rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.operators.lookup import lookup
from rowproof.session import cut, small_table

_PART, _AT, _BEFORE = "_part", "_at", "_before"
PLACE, DIGEST = "_place", "_digest"
_ROW_BITS = 33  # monotonically_increasing_id keeps the row's place in its lower bits
COPIES_AT_ONCE = 100_000  # rows that one task may write out for one group of equal rows


def number_rows(
    frame: DataFrame, order: Sequence[str | Column], column: str = "position", without: Sequence[str] = ()
) -> DataFrame:
    """Add each row's 0-based position under ``order``, which must be total.

    ``without`` are columns that only serve the order: they are sorted, not written.
    """
    keys = [F.col(key) if isinstance(key, str) else key for key in order]
    placed = cut(
        frame.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop(*without)
        .withColumn(_PART, F.spark_partition_id())
        .withColumn(
            _AT, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
        )
    )
    sizes = sorted(tuple(row) for row in placed.groupBy(_PART).count().collect())
    before, offsets = 0, []
    for part, size in sizes:
        offsets.append((part, before))
        before += size
    # one row per range partition
    shifts = small_table(frame.sparkSession, offsets, f"{_PART} int, {_BEFORE} long")
    return (
        placed.join(F.broadcast(shifts), _PART)
        .withColumn(column, F.col(_BEFORE) + F.col(_AT))
        .drop(_PART, _AT, _BEFORE)
    )


def with_places(frame: DataFrame) -> DataFrame:
    """``frame`` as a written table with ``_place``, a number per row that is fixed by the writing."""
    return cut(frame.withColumn(PLACE, F.monotonically_increasing_id()))


def _digest(placed: DataFrame) -> Column:
    """A hash of the row. Nested values, of which maps have no hash, are written out as text for it."""
    plain = (T.StringType, T.NumericType, T.BooleanType, T.DatetimeType)
    return F.xxhash64(
        *[
            F.col(f"`{f.name}`") if isinstance(f.dataType, plain) else F.col(f"`{f.name}`").cast("string")
            for f in placed.schema
            if f.name != PLACE
        ]
    )


def with_digest(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    """``frame`` with a hash of the named columns, so that ``place_positions`` need not read them again."""
    return frame.withColumn(DIGEST, _digest(frame.select(*[f"`{name}`" for name in names])))


def place_positions(
    placed: DataFrame, order: Sequence[str], column: str = "position", kept: Sequence[str] = ()
) -> DataFrame:
    """(_place, ``kept``, position) under ``order``; ties go by a digest of the row, equal rows by their places.

    Only these narrow columns are sorted: wide rows stay where they were written, and a row that is
    repeated a million times is a million places, not one key.
    """
    digest = F.col(DIGEST) if DIGEST in placed.columns else _digest(placed)
    names = list(dict.fromkeys([*order, *kept]))
    narrow = placed.select(*[f"`{name}`" for name in names], digest.alias(DIGEST), PLACE)
    sorted_only = [name for name in names if name not in kept]
    numbered = number_rows(narrow, [*order, DIGEST, PLACE], column, without=[*sorted_only, DIGEST])
    return numbered.select(PLACE, *[f"`{name}`" for name in kept], column)


def number_narrow(frame: DataFrame, order: Sequence[str], column: str = "position") -> DataFrame:
    """Positions as ``place_positions`` gives them, for rows hardly wider than ``order``: they move once, whole.

    ``frame`` is read from files, so that a task that runs again meets its rows in the same order: equal rows
    are told apart by the places where they were read, and these are not written.
    """
    digest = F.xxhash64(*[F.col(f"`{name}`").cast("string") for name in frame.columns])
    placed = frame.withColumn(PLACE, F.monotonically_increasing_id())
    return number_rows(placed, [*order, digest, PLACE], column, without=[PLACE])


def number_copies(
    frame: DataFrame,
    order: Sequence[str],
    column: str = "position",
    at_once: int = COPIES_AT_ONCE,
) -> DataFrame:
    """Positions for rows that may be equal in every column; ties go by the other columns.

    Equal rows cannot be told apart by a range partitioning, so a large group of copies
    would be one task. Each distinct row is numbered once with its count, and the copies
    are written out again, large groups in chunks that are spread over the cluster.
    """
    names = frame.columns
    keys = [*order, *[name for name in names if name not in order]]
    counted = frame.groupBy(*[f"`{name}`" for name in names]).agg(
        F.count(F.lit(1)).alias("_copies")
    )
    numbered = running_sums(counted, [], keys, ["_copies"])
    first = F.col("_copies_running") - F.col("_copies")
    placed = numbered.select(*names, "_copies", first.alias("_first"))
    few = placed.where(F.col("_copies") <= at_once).select(
        *names, "_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias(_AT)
    )
    last = F.floor((F.col("_copies") - 1) / at_once)
    # a number, or chunks, being few bytes before they are written out, would be put together again
    tasks = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = (
        placed.where(F.col("_copies") > at_once)
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .repartition(tasks, "_first", "_chunk")
    )
    start = F.col("_chunk") * at_once
    end = F.least(start + at_once, F.col("_copies")) - 1
    many = chunks.select(*names, "_first", F.explode(F.sequence(start, end)).alias(_AT))
    return few.unionByName(many).select(*names, (F.col("_first") + F.col(_AT)).alias(column))


def running_sums(
    frame: DataFrame, groups: Sequence[str], order: Sequence[str], amounts: Sequence[str]
) -> DataFrame:
    """Add ``<amount>_running``, the inclusive running sum within each group.

    ``groups`` + ``order`` must identify a row, so no hot key can fill a partition;
    the groups themselves must be few (features, tables), not data keys.
    """
    return _summed(frame, groups, order, amounts)[0]


def _summed(
    frame: DataFrame, groups: Sequence[str], order: Sequence[str], amounts: Sequence[str]
) -> tuple[DataFrame, dict[tuple, list[int]]]:
    """The running sums, and the total amounts per group."""
    placed = cut(
        frame.repartitionByRange(*groups, *order).withColumn(_PART, F.spark_partition_id())
    )
    sums = placed.groupBy(_PART, *groups).agg(*[F.sum(name).alias(name) for name in amounts])
    ordered = sorted(sums.collect(), key=lambda row: row[_PART])
    so_far: dict[tuple, list[int]] = {}
    offsets = []
    for row in ordered:
        group = tuple(row[name] for name in groups)
        current = so_far.setdefault(group, [0] * len(amounts))
        offsets.append((row[_PART], *group, *current))
        so_far[group] = [have + row[name] for have, name in zip(current, amounts)]
    fields = [f"{_PART} int"]
    fields += [f"`{name}` {frame.schema[name].dataType.simpleString()}" for name in groups]
    fields += [f"`{_BEFORE}_{name}` long" for name in amounts]
    # one row per range partition and group
    shifts = small_table(frame.sparkSession, offsets, ", ".join(fields))
    upto = (
        Window.partitionBy(_PART, *groups)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = placed.join(F.broadcast(shifts), [_PART, *groups])
    for name in amounts:
        summed = summed.withColumn(
            f"{name}_running", F.sum(name).over(upto) + F.col(f"{_BEFORE}_{name}")
        ).drop(f"{_BEFORE}_{name}")
    return summed.drop(_PART), so_far


def exact_quantiles(
    values: DataFrame, group: str, value: str, probabilities: Sequence[float], prefix: str = "q"
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column ``q0``, ``q1``, ... each.

    Equal values are counted first, so a value held by a third of the rows is one row
    afterwards; unlike ``percentile`` no task holds all values of a group.
    """
    counted = (
        values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(group, value)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    running, sums = _summed(counted, [group], [value], ["n"])
    # one row per group
    totals = small_table(
        values.sparkSession,
        [(name, total) for (name,), (total,) in sums.items()],
        f"`{group}` {counted.schema[group].dataType.simpleString()}, total long",
    )
    picks = []
    for index, probability in enumerate(probabilities):
        place = F.lit(float(probability)) * (F.col("total") - 1)
        picks += [
            F.min(F.when(F.col("n_running") > F.floor(place), F.col(value))).alias(f"_lo{index}"),
            F.min(F.when(F.col("n_running") > F.ceil(place), F.col(value))).alias(f"_hi{index}"),
        ]
    found = running.join(F.broadcast(totals), group).groupBy(group, "total").agg(*picks)
    columns = []
    for index, probability in enumerate(probabilities):
        place = F.lit(float(probability)) * (F.col("total") - 1)
        low, high = F.col(f"_lo{index}"), F.col(f"_hi{index}")
        columns.append((low + (high - low) * (place - F.floor(place))).alias(f"{prefix}{index}"))
    return found.select(group, *columns)


def approximate_quantiles(
    values: DataFrame,
    group: str,
    value: str,
    probabilities: Sequence[float],
    relative_error: float = 0.001,
    prefix: str = "q",
) -> DataFrame:
    """Quantiles per group from mergeable sketches: one partial aggregation, nothing is sorted.

    A result is a value of the group whose rank differs from ``p * n`` by at most ``relative_error * n``;
    a sketch holds some 1 / ``relative_error`` values, and only sketches are shuffled.
    """
    number = F.col(value).cast("double")
    sketch = F.percentile_approx(
        F.when(~F.isnan(number), number), [float(p) for p in probabilities], F.lit(round(1 / relative_error))
    )
    found = values.groupBy(group).agg(sketch.alias("_found")).where(F.col("_found").isNotNull())
    return found.select(
        group, *[F.get("_found", F.lit(i)).alias(f"{prefix}{i}") for i in range(len(probabilities))]
    )


def rank_errors(
    values: DataFrame,
    estimates: DataFrame,
    group: str,
    value: str,
    probabilities: Sequence[float],
    prefix: str = "q",
) -> DataFrame:
    """(group, probability, n, rank_error): how far off the estimated quantiles are, as a share of the rows.

    An estimate held by several rows covers all of their ranks; the nearest one counts.
    """
    names = [f"{prefix}{i}" for i in range(len(probabilities))]
    number = F.col(value).cast("double")
    joined = values.where(number.isNotNull() & ~F.isnan(number)).join(
        F.broadcast(estimates.select(group, *names)), group  # one row per group
    )
    counted = joined.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(number < F.col(name)).alias(f"_below{i}") for i, name in enumerate(names)],
        *[F.count_if(number <= F.col(name)).alias(f"_upto{i}") for i, name in enumerate(names)],
    )
    found = []
    for i, p in enumerate(probabilities):
        place = F.lit(float(p)) * F.col("n")
        off = F.greatest(F.col(f"_below{i}") - place, place - F.col(f"_upto{i}"), F.lit(0.0))
        found.append(F.struct(F.lit(float(p)).alias("probability"), (off / F.col("n")).alias("rank_error")))
    return counted.select(group, "n", F.explode(F.array(*found)).alias("_one")).select(group, "n", "_one.*")


def higher_quantile(scores: DataFrame, score: str, probability: float) -> float:
    """The quantile that rounds up to an existing value: ``sorted[ceil((n-1)*p)]``."""
    counted = scores.groupBy(score).agg(F.count(F.lit(1)).alias("n"))
    running, sums = _summed(counted, [], [score], ["n"])
    total = sums[()][0] if sums else None
    place = F.ceil(F.lit(probability) * (F.lit(total) - 1))
    return running.where(F.col("n_running") > place).agg(F.min(score)).first()[0]


def share_at_or_below(
    scores: DataFrame, training: DataFrame, score: str, spread: str, column: str
) -> DataFrame:
    """Add the share of training scores that are <= each row's score.

    Both sides are reduced to distinct scores before the sort, and the answer is looked
    up per distinct score.
    """
    weighed = training.groupBy(score).agg(
        F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("asked")
    )
    asked = scores.groupBy(score).agg(
        F.lit(0).cast("long").alias("n"), F.count(F.lit(1)).alias("asked")
    )
    distinct = (
        weighed.unionByName(asked)
        .groupBy(score)
        .agg(F.sum("n").alias("n"), F.sum("asked").alias("asked"))
    )
    running, sums = _summed(distinct, [], [score], ["n"])
    total = sums[()][0] if sums else None
    table = running.where(F.col("asked") > 0).select(
        score, "asked", (F.col("n_running") / F.lit(total)).alias(column)
    )
    return lookup(scores, table, score, weight="asked", spread=spread).drop("asked")


def stack_columns(frame: DataFrame, columns: dict[str, Column], name: str, value: str) -> DataFrame:
    """One row per (row, column): the long form that the group-wise operators take."""
    pairs = [
        F.struct(F.lit(label).alias(name), expression.cast("double").alias(value))
        for label, expression in columns.items()
    ]
    return frame.select(F.explode(F.array(*pairs)).alias("_pair")).select("_pair.*")
