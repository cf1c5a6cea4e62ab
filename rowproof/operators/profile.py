"""Exploratory summaries of tables and of the relation between two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.functions.text import digest_long, signed_log1p
from rowproof.operators.ordering import approximate_quantiles, exact_quantiles, number_rows, stack_columns

_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)
CATEGORICAL_RATIO = 0.05


def semantic_type(name: str, kind: T.DataType, unique_ratio: Column) -> Column:
    """date, identifier, numeric, categorical or text; names count before types."""
    lower = name.lower()
    if lower.endswith("_date") or "date_" in lower or isinstance(kind, _DATES):
        return F.lit("date")
    if lower.endswith(("_id", "_key", "_code")):
        return F.lit("identifier")
    if isinstance(kind, T.NumericType):
        return F.lit("numeric")
    return F.when(unique_ratio < CATEGORICAL_RATIO, F.lit("categorical")).otherwise(F.lit("text"))


def _comparable(name: str, kind: T.DataType) -> Column:
    """A value as short text for distinct counting; equal texts mean equal values."""
    return digest_long(_present(name, kind).cast("string"))


def _present(name: str, kind: T.DataType) -> Column:
    """The value with NaN as missing and one zero."""
    value = F.col(f"`{name}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), F.when(value == 0, F.lit(0.0).cast(kind)).otherwise(value))
    return value


def profile_table(frame: DataFrame, exact: bool = True) -> DataFrame:
    """Type, completeness and cardinality of every column.

    Exact distinct counts go through (field, value) pairs: two partial aggregations,
    long texts as digests, no task per column. ``exact=False`` uses HyperLogLog.
    """
    fields = [(field.name, field.dataType) for field in frame.schema]
    if exact:
        pairs = F.array(
            *[
                F.struct(F.lit(name).alias("field"), _comparable(name, kind).alias("value"))
                for name, kind in fields
            ]
        )
        values = (
            frame.select(F.explode(pairs).alias("_pair"))
            .select("_pair.field", "_pair.value")
            .groupBy("field", "value")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        counts = values.groupBy("field").agg(
            F.sum("n").alias("rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias(
                "missing_count"
            ),
            F.count("value").alias("unique_count"),
        )
    else:
        wide = frame.agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.count_if(_present(n, k).isNull()).alias(f"_m{i}") for i, (n, k) in enumerate(fields)],
            *[F.approx_count_distinct(_present(n, k)).alias(f"_u{i}") for i, (n, k) in enumerate(fields)],
        )
        rows = [
            F.struct(
                F.lit(name).alias("field"),
                F.col("_rows").alias("rows"),
                F.col(f"_m{i}").alias("missing_count"),
                F.col(f"_u{i}").alias("unique_count"),
            )
            for i, (name, _) in enumerate(fields)
        ]
        counts = wide.select(F.explode(F.array(*rows)).alias("_row")).select("_row.*")
    ratio = F.col("unique_count") / F.greatest(F.col("rows"), F.lit(1))
    dtype, semantic = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, kind in fields:
        here = F.col("field") == name
        dtype = F.when(here, F.lit(kind.simpleString())).otherwise(dtype)
        semantic = F.when(here, semantic_type(name, kind, ratio)).otherwise(semantic)
    return counts.select(
        "field",
        dtype.alias("dtype"),
        semantic.alias("semantic_type"),
        "missing_count",
        F.round(F.col("missing_count") / F.col("rows") * 100, 3).alias("missing_percent"),
        "unique_count",
    ).orderBy(F.desc("missing_percent"), "field")


def duplicate_summary(frame: DataFrame, key: str) -> DataFrame:
    """One row: exact copies after the first, and rows and values of repeated keys."""
    narrow = frame.select(
        *[
            digest_long(F.col(f"`{field.name}`")).alias(field.name)
            if isinstance(field.dataType, T.StringType)
            else F.col(f"`{field.name}`")
            for field in frame.schema
        ]
    )
    copies = (
        narrow.groupBy(*[f"`{name}`" for name in narrow.columns])
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("exact_duplicate_rows"),
        )
    )
    repeated = (F.col("_key").isNotNull()) & (F.col("n") > 1)
    keys = (
        frame.groupBy(F.col(key).alias("_key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum(F.when(repeated, F.col("n"))), F.lit(0)).alias("duplicate_key_rows"),
            F.count_if(repeated).alias("duplicate_key_values"),
            F.coalesce(F.sum(F.when(F.col("_key").isNull(), F.col("n"))), F.lit(0)).alias(
                "missing_key_rows"
            ),
        )
    )
    # one row on each side
    return copies.join(F.broadcast(keys), F.lit(True))


def join_quality(
    parent: DataFrame, child: DataFrame, parent_key: str = "vendor_id", key: str = "vendor_id"
) -> DataFrame:
    """One row: how many child rows find a parent. Works on counted keys, not on rows."""
    used = child.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    present = (
        parent.select(F.col(parent_key).alias("_key"))
        .where("_key is not null")
        .distinct()
        .withColumn("_found", F.lit(True))
    )
    none, found = F.col("_key").isNull(), F.col("_found").isNotNull()

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    counts = used.join(present, "_key", "left").agg(
        rows(F.lit(True)).alias("transaction_rows"),
        rows(none).alias("missing_vendor_key_rows"),
        rows(~none & ~found).alias("unmatched_vendor_key_rows"),
        rows(~none & found).alias("matched_transaction_rows"),
    )
    vendors = parent.agg(F.count(F.lit(1)).alias("vendor_rows"))
    return counts.join(F.broadcast(vendors), F.lit(True)).select(
        "transaction_rows",
        "vendor_rows",
        "missing_vendor_key_rows",
        "unmatched_vendor_key_rows",
        "matched_transaction_rows",
        F.round(
            F.col("matched_transaction_rows") / F.col("transaction_rows") * 100, 3
        ).alias("match_rate_percent"),
    )


def shape_comparison(frames: dict[str, DataFrame], period: str = "fiscal_year") -> DataFrame:
    """Rows and columns of each table per period."""
    parts = [
        frame.groupBy(F.col(period).cast("string").alias("period")).agg(
            F.lit(name).alias("table"),
            F.count(F.lit(1)).alias("rows"),
            F.lit(len(frame.columns)).cast("long").alias("columns"),
        )
        for name, frame in frames.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def missingness_comparison(
    first: DataFrame, second: DataFrame, labels: tuple[str, str], top: int = 12
) -> DataFrame:
    """The fields most missing in either profile, in long form."""
    left, right = labels
    joined = (
        first.select("field", F.col("missing_percent").alias(left))
        .join(second.select("field", F.col("missing_percent").alias(right)), "field")
        .withColumn("_worst", F.greatest(left, right))
        .orderBy(F.desc("_worst"), "field")
        .limit(top)
    )
    return joined.unpivot("field", [left, right], "period", "missing_percent")


def distribution_summary(
    frame: DataFrame,
    columns: Sequence[str],
    percentiles: Sequence[float],
    approx: bool = False,
    relative_error: float = 0.001,
) -> DataFrame:
    """count, mean, sample deviation, extremes and percentiles per column.

    Percentiles are exact, or with ``approx`` values whose rank is off by at most ``relative_error`` of the rows.
    """
    long = stack_columns(frame, {name: F.col(name) for name in columns}, "field", "value")
    moments = long.groupBy("field").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    if approx:
        quantiles = approximate_quantiles(long, "field", "value", percentiles, relative_error)
    else:
        quantiles = exact_quantiles(long, "field", "value", percentiles)
    names = [f"p{round(p * 100, 3):g}".replace(".", "_") for p in percentiles]
    renamed = quantiles.select(
        "field", *[F.col(f"q{i}").alias(name) for i, name in enumerate(names)]
    )
    # one row per column of the table
    return moments.join(F.broadcast(renamed), "field", "left")


def log_histogram(frame: DataFrame, column: str, bins: int = 80) -> DataFrame:
    """Counts of ``sign(x)*log1p(|x|)`` in equally wide bins between its extremes."""
    scaled = frame.select(signed_log1p(F.col(column)).alias("x")).where("x is not null")
    bounds = scaled.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    place = F.least(
        F.lit(bins - 1),
        F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins),
    )
    number = F.when(F.col("high") == F.col("low"), F.lit(0)).otherwise(place).cast("long")
    return (
        scaled.join(F.broadcast(bounds), F.lit(True))
        .groupBy(number.alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def group_counts(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row counts per group; groups with a null are dropped."""
    present = frame.dropna("any", subset=list(columns))
    return present.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))


def monthly_volume(frame: DataFrame, moment: str) -> DataFrame:
    known = frame.where(F.col(moment).isNotNull())
    return known.groupBy(
        F.year(moment).alias("year"), F.month(moment).alias("month")
    ).agg(F.count(F.lit(1)).alias("rows"))


def concentration_ranks(counts: DataFrame, key: str, volume: str) -> DataFrame:
    """Rank 1 for the largest volume; ties by key."""
    ordered = number_rows(counts, [F.desc(volume), F.asc(key)], "_place")
    return ordered.withColumn("rank", F.col("_place") + 1).drop("_place")


def concentration_quantiles(
    counts: DataFrame,
    volume: str,
    probabilities: Sequence[float] = (0, 0.5, 0.9, 0.95, 0.99, 1),
) -> DataFrame:
    """(quantile, volume) over all keys."""
    long = counts.select(F.lit("all").alias("group"), F.col(volume).cast("double").alias("value"))
    wide = exact_quantiles(long, "group", "value", probabilities)
    pairs = [
        F.struct(F.lit(float(p)).alias("quantile"), F.col(f"q{i}").alias("volume"))
        for i, p in enumerate(probabilities)
    ]
    return wide.select(F.explode(F.array(*pairs)).alias("_row")).select("_row.*")
