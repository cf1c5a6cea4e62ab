"""Side-by-side run of the registered queries and their SQL, for development and tests."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.9g}" if value else "0"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(item) for item in value) + "]"
    if value is None:
        return "null"
    return f"{type(value).__name__}:{value}"


def differences(spark: SparkSession, folder: str, query, sql: str) -> list[str]:
    """What differs between the two results, ignoring row and column order."""
    frame = query(spark, folder)
    names = sorted(frame.columns)
    ours = sorted(tuple(_plain(v) for v in row) for row in frame.select(*names).collect())
    answer = duck(folder).execute(sql)
    theirs_names = [entry[0] for entry in answer.description]
    if sorted(theirs_names) != names:
        return [f"columns {names} vs {sorted(theirs_names)}"]
    places = [theirs_names.index(name) for name in names]
    theirs = sorted(tuple(_plain(row[i]) for i in places) for row in answer.fetchall())
    problems = []
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} vs {len(theirs)}")
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        problems.append(f"{len(wrong)} rows differ, first: {wrong[0]}")
    return problems
