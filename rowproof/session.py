"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_AT_ONCE = 8  # steps whose jobs run side by side
_T = TypeVar("_T")


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rowproof")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Compare dates in UTC and make sure that checkpoints have a shared home."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    shared_folder(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the cluster's, or a scratch one in local mode only."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="rowproof-checkpoints-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """Write ``frame`` as a table in the shared folder and continue from there.

    Used where a later step must see exactly the rows an earlier one counted, also
    when an executor is lost in between. Parquet rather than ``checkpoint()``: later
    reads prune columns, and the files are compressed.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """The rows of a scan on as many tasks as there are cores, if its files give fewer.

    A file of one row group is one task, and so is all that follows without a shuffle. Only for plans without one:
    to count the tasks of others is to run them.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    if frame._jdf.rdd().getNumPartitions() >= cores:
        return frame
    return frame.repartition(cores, *keys)


def side_by_side(steps: Sequence[Callable[[], _T]]) -> list[_T]:
    """The results of independent steps, whose jobs run at the same time: many small jobs leave cores idle."""
    if len(steps) < 2:
        return [step() for step in steps]
    with ThreadPoolExecutor(max_workers=min(_AT_ONCE, len(steps))) as pool:
        return list(pool.map(lambda step: step(), steps))


def small_table(spark: SparkSession, rows: Sequence[tuple], layout: str) -> DataFrame:
    """A table from a bounded number of driver rows, as a local relation: no tasks to scan."""
    schema = T.StructType.fromDDL(layout)
    columns = list(zip(*rows)) or [[] for _ in schema]
    arrow = to_arrow_schema(schema)
    arrays = [pa.array(values, field.type) for values, field in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow))
