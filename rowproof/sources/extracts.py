"""Reading raw extracts, prepared periods and uploaded pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.functions.text import missing_tokens_to_null
from rowproof.sources.records import read_csv_records

RAW_PARTS = "*PrimeTransactions*.csv"


def _csv(spark: SparkSession, multi_line: bool = True):
    reader = spark.read.option("header", True).option("escape", '"')
    return reader.option("multiLine", multi_line)


def read_strings(
    spark: SparkSession, paths: str | list[str], multi_line: bool = True
) -> DataFrame:
    """A CSV with a header, every column as string; missing tokens become null.

    Texts with line breaks need ``multi_line``, which reads a file in one task; turn it
    off to split large files without such texts.
    """
    frame = _csv(spark, multi_line).csv(paths)
    return frame.select(
        *[missing_tokens_to_null(F.col(f"`{name}`")).alias(name) for name in frame.columns]
    )


def read_raw_transactions(
    spark: SparkSession,
    folder: str,
    fiscal_year: int | str,
    pattern: str = RAW_PARTS,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """All parts of a year as one table of strings; missing tokens become null.

    Every part is split over tasks, also one with line breaks inside quotes. ``columns``: the declared list, for
    parts with different headers; by default all columns of all headers.
    """
    nothing = f"There is no raw extract of FY{fiscal_year}. Run acquisition first."
    try:
        frame = read_csv_records(spark, f"{folder}/fy{fiscal_year}", pattern, columns)
    except (AnalysisException, FileNotFoundError) as error:
        raise FileNotFoundError(nothing) from error
    return frame.select(
        *[missing_tokens_to_null(F.col(f"`{name}`")).alias(name) for name in frame.columns]
    )


def read_period(
    spark: SparkSession, folder: str, fiscal_year: int | str
) -> tuple[DataFrame, DataFrame]:
    """(vendors, transactions) of one period; the partition filter prunes the others."""
    year = F.col("fiscal_year") == int(fiscal_year)
    return (
        spark.read.parquet(f"{folder}/vendors").where(year),
        spark.read.parquet(f"{folder}/transactions").where(year),
    )


def read_upload(
    spark: SparkSession, vendors: str, transactions: str
) -> tuple[DataFrame, DataFrame]:
    """An uploaded CSV pair as strings, so leading zeros survive until the contract types it."""
    return read_strings(spark, vendors), read_strings(spark, transactions)
