"""Integrity of stored files and the manifest of a prepared period."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.session import small_table

PART = 1 << 20


def file_digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file, bytes, sha256) of every file below ``folder``.

    Files are hashed on the executors a megabyte at a time, whatever their size, and opened by
    Arrow, which knows local files, HDFS, S3 and GCS.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(folder)
    )
    # paths come back as URIs; keep what follows the resolved folder
    root = _resolved(spark, folder)
    listed = files.select(
        F.substring("path", len(root) + 2, 1 << 20).alias("file"), F.col("length").alias("bytes"), "path"
    )
    return listed.mapInArrow(_hashed, "file string, bytes long, sha256 string")


def _resolved(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.makeQualified(path).toString().rstrip("/")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for path in batch.column("path").to_pylist():
            if path.startswith("file:"):
                files, name = pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
            else:
                files, name = pyarrow.fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with files.open_input_stream(name) as content:
                while part := content.read(PART):
                    digest.update(part)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("file"), batch.column("bytes"), pa.array(digests, pa.string())],
            ["file", "bytes", "sha256"],
        )


MANIFEST = "file string, bytes long, sha256 string"


def snapshot_report(manifest: DataFrame, folder: str) -> DataFrame:
    """(file, problem): every file of the manifest or the folder; ``problem`` is null where both agree.

    ``manifest`` has file, bytes and sha256, one row per file, and may be of any length: it is joined
    with the digests. Problems: incomplete entry, outside the folder, listed twice, missing, other size, other hash,
    and extra for a file that the manifest does not list.
    """
    spark = manifest.sparkSession
    listed = manifest.select(
        F.col("file").cast("string").alias("file"),
        F.col("bytes").try_cast("long").alias("bytes"),
        F.col("sha256").cast("string").alias("sha256"),
    )
    wanted = listed.groupBy("file").agg(
        F.count(F.lit(1)).alias("_listed"),
        F.min("bytes").alias("_bytes"),
        F.min("sha256").alias("_sha256"),
        (F.count_if(F.col("bytes").isNull() | F.col("sha256").isNull()) > 0).alias("_torn"),
    )
    if _exists(spark, folder):
        found = file_digests(spark, folder)
    else:
        found = small_table(spark, [], MANIFEST)
    joined = wanted.join(found, "file", "full_outer")
    outside = F.col("file").startswith("/") | F.array_contains(F.split("file", "/"), "..")
    problem = (
        F.when(F.col("_listed").isNull(), "extra")
        .when(F.col("file").isNull() | F.col("_torn"), "incomplete entry")
        .when(outside, "outside the folder")
        .when(F.col("_listed") > 1, "listed twice")
        .when(F.col("bytes").isNull(), "missing")
        .when(F.col("bytes") != F.col("_bytes"), "other size")
        .when(F.col("sha256") != F.col("_sha256"), "other hash")
    )
    return joined.select("file", problem.alias("problem"))


def manifest_table(spark: SparkSession, entries: Sequence[dict] | None) -> DataFrame | None:
    """The entries of a manifest document as a table; None if it is empty or malformed."""
    if not entries or not all(isinstance(entry, dict) for entry in entries):
        return None
    if not all({"file", "bytes", "sha256"} <= set(entry) for entry in entries):
        return None
    rows = [(str(entry["file"]), int(entry["bytes"]), str(entry["sha256"])) for entry in entries]
    return small_table(spark, rows, MANIFEST)


def snapshot_is_valid(
    spark: SparkSession, manifest: DataFrame | Sequence[dict] | None, folder: str
) -> bool:
    """Every manifest file lies in the folder with the same size and hash; further files do not matter.

    An empty or malformed manifest is not valid. A long one is best given as a table.
    """
    if not isinstance(manifest, DataFrame):
        manifest = manifest_table(spark, manifest)
    if manifest is None:
        return False
    wrong = F.count_if(F.col("problem").isNotNull() & (F.col("problem") != "extra"))
    kept = F.count_if(F.col("problem").isNull())
    counts = snapshot_report(manifest, folder).agg(wrong.alias("wrong"), kept.alias("kept")).first()
    return counts["wrong"] == 0 and counts["kept"] > 0


def preparation_counts(vendors: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row of counts. Here null keys count as duplicates of one another."""
    keys = transactions.groupBy("contract_transaction_unique_key").agg(
        F.count(F.lit(1)).alias("n")
    )
    duplicates = keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("transaction_rows"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias(
            "duplicate_transaction_keys"
        ),
    )
    used = transactions.groupBy("vendor_id").agg(F.count(F.lit(1)).alias("n"))
    present = vendors.select("vendor_id").distinct().withColumn("_found", F.lit(True))
    unmatched = F.col("vendor_id").isNotNull() & F.col("_found").isNull()
    links = used.join(present, "vendor_id", "left").agg(
        F.coalesce(F.sum(F.when(F.col("vendor_id").isNull(), F.col("n"))), F.lit(0)).alias(
            "missing_vendor_keys"
        ),
        F.coalesce(F.sum(F.when(unmatched, F.col("n"))), F.lit(0)).alias("unmatched_vendor_keys"),
    )
    size = vendors.agg(F.count(F.lit(1)).alias("vendor_rows"))
    # one row each
    return (
        duplicates.join(F.broadcast(size), F.lit(True))
        .join(F.broadcast(links), F.lit(True))
        .select(
            "transaction_rows",
            "vendor_rows",
            "duplicate_transaction_keys",
            "missing_vendor_keys",
            "unmatched_vendor_keys",
        )
    )
