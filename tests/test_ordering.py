import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowproof.operators.lookup import lookup
from rowproof.operators.ordering import (
    exact_quantiles,
    higher_quantile,
    number_copies,
    number_rows,
    running_sums,
    share_at_or_below,
)


def test_positions_follow_the_order(spark):
    values = [(i, f"k{i % 7}") for i in range(1000)]
    random.Random(1).shuffle(values)
    frame = spark.createDataFrame(values, "id long, key string").repartition(13)
    rows = number_rows(frame, ["key", F.desc("id")]).collect()
    expected = sorted(values, key=lambda v: (v[1], -v[0]))
    assert [(r["id"], r["key"]) for r in sorted(rows, key=lambda r: r["position"])] == expected
    assert sorted(r["position"] for r in rows) == list(range(1000))


@pytest.mark.parametrize("at_once", [7, 100_000])
def test_copies_get_positions_of_their_own(spark, at_once):
    values = [("b", 1)] * 100 + [("a", i) for i in range(50)] + [("b", 0), (None, 2)]
    frame = spark.createDataFrame(values, "key string, n int").repartition(5)
    rows = number_copies(frame, ["key"], "position", at_once).collect()
    expected = sorted(values, key=lambda v: (v[0] or "", v[1]))
    assert [(r["key"], r["n"]) for r in sorted(rows, key=lambda r: r["position"])] == expected
    assert sorted(r["position"] for r in rows) == list(range(len(values)))


def test_copies_of_one_row_are_written_out_by_several_tasks(spark):
    frame = spark.range(50_000).select(F.lit("same").alias("key"))
    rows = number_copies(frame, ["key"], "position", 1000)
    tasks = rows.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 50_000 and max(r["count"] for r in tasks) < 25_000


def test_positions_of_nothing(spark):
    assert number_rows(spark.createDataFrame([], "id long"), ["id"]).count() == 0


def test_running_sums_per_group(spark):
    rows = [("a", i, i) for i in range(100)] + [("b", i, 1) for i in range(5)]
    frame = spark.createDataFrame(rows, "g string, at long, n long").repartition(9)
    got = {(r["g"], r["at"]): r["n_running"] for r in running_sums(frame, ["g"], ["at"], ["n"]).collect()}
    assert got == {(g, at): sum(x[2] for x in rows if x[0] == g and x[1] <= at) for g, at, _ in rows}


def test_quantiles_equal_numpy_also_with_a_hot_value(spark):
    rng = np.random.default_rng(3)
    values = {"x": rng.normal(size=501), "y": np.r_[np.zeros(400), rng.normal(size=200)]}
    frame = spark.createDataFrame(
        [(g, float(v)) for g, vs in values.items() for v in vs] + [("x", None)], "g string, v double"
    )
    ps = (0.0, 0.25, 0.5, 0.75, 0.99, 1.0)
    for row in exact_quantiles(frame, "g", "v", ps).collect():
        expected = np.quantile(values[row["g"]], ps)
        assert [row[f"q{i}"] for i in range(len(ps))] == pytest.approx(list(expected), abs=1e-12)


def test_higher_quantile_rounds_up(spark):
    frame = spark.createDataFrame([(float(i),) for i in range(20)], "s double")
    assert higher_quantile(frame, "s", 0.9) == np.quantile(np.arange(20.0), 0.9, method="higher")


def test_share_at_or_below_is_a_right_sided_search(spark):
    training = [1.0, 2.0, 2.0, 5.0]
    asked = [0.0, 1.0, 2.0, 3.0, 9.0, 2.0]
    got = share_at_or_below(
        spark.createDataFrame(list(enumerate(asked)), "id long, s double"),
        spark.createDataFrame([(v,) for v in training], "s double"),
        "s",
        "id",
        "share",
    )
    expected = np.searchsorted(training, asked, side="right") / len(training)
    assert [r["share"] for r in got.orderBy("id").collect()] == list(expected)


@pytest.mark.parametrize("limit", [None, 0])
def test_lookup_keeps_every_row_with_a_hot_key_and_nulls(spark, limit):
    keys = ["hot"] * 300 + [None] * 200 + [f"k{i % 50}" for i in range(400)]
    frame = spark.createDataFrame(list(enumerate(keys)), "id long, key string").repartition(6)
    table = frame.where("key is not null and key <> 'k7'").groupBy("key").agg(
        F.count("*").alias("n"), F.lit("found").alias("what")
    )
    out = lookup(frame, table, "key", weight="n", spread="id", broadcast_bytes=limit)
    got = {r["id"]: (r["key"], r["what"]) for r in out.collect()}
    assert out.count() == len(keys)
    assert got == {
        i: (k, None if k in (None, "k7") else "found") for i, k in enumerate(keys)
    }
    plan = out._jdf.queryExecution().toString()
    assert ("_salt" in plan) == (limit == 0)
