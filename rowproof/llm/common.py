"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.session import cut

BROADCAST_BYTES = 32 * 1024 * 1024


ARROW_ROWS = 1000


def table(spark, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark) -> None:
    """Whole texts in batches of ``ARROW_ROWS`` rows: what a Python worker holds stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def text_of(frame: DataFrame, column: str = "text") -> Column:
    """The text column, null read as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def id_text(column: str = "doc_id") -> Column:
    return F.col(column).cast("string")


def fold(column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; null for null ids."""
    return F.pmod(F.crc32(id_text(column).cast("binary")), F.lit(4))


def is_held_out(column: str = "doc_id") -> Column:
    """Fold 2 is held out; rows without an id are never held out."""
    return F.coalesce(fold(column) == 2, F.lit(False))


def row_key(id_column: str = "doc_id", text: str = "text") -> list[Column]:
    """128 bits that identify (id, text); rows equal in both share them and any result."""
    named = F.coalesce(id_text(id_column), F.lit("\x00null"))
    content = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(named, content).alias("_k1"), F.xxhash64(content, named, F.lit(1)).alias("_k2")]


def with_fields(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    """``schema`` without nullability limits, plus further fields; names that clash go."""
    new = {field.name.lower() for field in fields}
    kept = [T.StructField(f.name, f.dataType, True) for f in schema if f.name.lower() not in new]
    return T.StructType([*kept, *fields])


def broadcast_if_small(frame: DataFrame, row_bytes: int, most: int | None = None) -> DataFrame:
    """``frame`` as a written table, marked for broadcast only if its counted size is within ``most``."""
    written = cut(frame)
    most = BROADCAST_BYTES if most is None else most
    return F.broadcast(written) if written.count() * row_bytes <= most else written
