"""Cases that an earlier version got wrong."""

import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.operators import contract, lof, neighbours, ordering, profile
from rowproof.operators import lookup as lookups
from rowproof.plans.queries import scratch
from rowproof.session import cut
from rowproof.sources import sinks, snapshots
from rowproof.streaming import score as streaming


def findings(spark):
    return spark.createDataFrame(
        [("vendor", "v1", "missing_name", "low", 1, "x", 30)],
        "target_table string, record_id string, issue_type string, severity string, severity_rank int, "
        "evidence string, risk_score int",
    )


def test_run_ids_stay_text(spark):
    path = scratch(spark)
    for run in ("007", "7", "run-1"):
        sinks.save_run(
            findings(spark), path, run_id=run, fiscal_year=2024, vendor_records=1, transaction_records=0,
            schema_version="1", model_version="1",
        )
    for run in ("007", "7", "run-1"):
        assert [r.run_id for r in sinks.list_findings(spark, path, run).collect()] == [run]
        assert [r.run_id for r in sinks.get_run(spark, path, run).collect()] == [run]
    assert sinks.get_run(spark, path, "07").count() == 0


def test_large_integers_are_exact(spark):
    frame = spark.createDataFrame([("9007199254740993",), (" -9007199254740993 ",), ("1.0",), ("x",), (None,)], "n string")
    got = [r[0] for r in frame.select(contract.coerced("n", "integer", T.StringType())).collect()]
    assert got == [9007199254740993, -9007199254740993, 1, None, None]


@pytest.mark.parametrize("exact", [True, False])
def test_nan_is_missing_and_zero_is_one_value(spark, exact):
    frame = spark.createDataFrame([(1.0,), (float("nan"),), (0.0,), (-0.0,)], "x double")
    row = profile.profile_table(frame, exact=exact).first()
    assert (row.missing_count, row.unique_count) == (1, 2)


def test_quantiles_leave_nan_out(spark):
    frame = spark.createDataFrame([("g", float(x)) for x in (1, 2, 3, "nan")], "g string, x double")
    assert ordering.exact_quantiles(frame, "g", "x", [0.5, 1.0]).first()[1:] == (2.0, 3.0)


def test_snapshots_of_missing_and_oddly_named_folders(spark, tmp_path):
    folder = tmp_path / "a(1" / "fy24"
    (folder / "fy24").mkdir(parents=True)
    for place, text in (("p.csv", b"one"), ("fy24/p.csv", b"two" * 1_000_000)):
        (folder / place).write_bytes(text)
    manifest = [
        {"file": place, "bytes": len(text), "sha256": hashlib.sha256(text).hexdigest()}
        for place, text in (("p.csv", b"one"), ("fy24/p.csv", b"two" * 1_000_000))
    ]
    assert {r.file for r in snapshots.file_digests(spark, str(folder)).collect()} == {"p.csv", "fy24/p.csv"}
    assert snapshots.snapshot_is_valid(spark, manifest, str(folder))
    assert not snapshots.snapshot_is_valid(spark, [manifest[0] | {"bytes": 4}], str(folder))
    assert not snapshots.snapshot_is_valid(spark, manifest, str(tmp_path / "nowhere"))


def test_query_vectors_are_sent_once_per_range(spark):
    rows = spark.range(2000).select(
        F.col("id").cast("string").alias("id"),
        F.array(*[(F.xxhash64("id", F.lit(d)) % 1000 / 1000).cast("double") for d in range(12)]).alias("vector"),
    )
    groups = cut(lof.distinct_vectors(rows))
    index = neighbours.build_index(groups, 64)
    blocks = len(index.cells)
    asked = groups.select(F.col("ref").alias("query"), "vector", F.lit(float("inf")).alias("reach"))
    sent = neighbours._visits(asked, index, 5, first=False)
    assert blocks > 30
    assert sent.count() <= 2000 * -(-blocks // neighbours.RANGE_BLOCKS)
    near = neighbours.nearest_neighbours(asked.select("query", "vector"), index, 3)
    best = near.where("query <> ref").groupBy("query").agg(F.min("distance").alias("d"))
    pairs = groups.alias("a").join(groups.alias("b"), F.col("a.ref") != F.col("b.ref")).where("a.ref < '15'")
    squares = F.aggregate(F.zip_with("a.vector", "b.vector", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    brute = pairs.select(F.col("a.ref").alias("query"), F.sqrt(squares).alias("e")).groupBy("query").agg(F.min("e").alias("e"))
    assert brute.join(best, "query", "left").where("d is null or abs(d - e) > 1e-9").count() == 0


def test_streams_refuse_invalid_records(spark):
    frame = spark.createDataFrame([("a", "3"), ("", "3"), ("b", "-1"), ("c", "x")], "vendor_id string, n string")
    table = contract.TableContract(
        business_key="vendor_id",
        columns=(
            contract.ColumnRule("vendor_id", "string", nullable=False),
            contract.ColumnRule("n", "integer", nullable=False),
        ),
    )
    good, bad = streaming.validated(frame, "vendor", table, 2024)
    assert [(r.vendor_id, r.n) for r in good.collect()] == [("a", 3)]
    assert sorted(r.problems[0] for r in bad.collect()) == ["n", "n", "vendor_id"]
    with pytest.raises(ValueError, match="unknown fields"):
        streaming.validated(frame.withColumn("extra", F.lit(1)), "vendor", table, 2024)


def test_keys_with_one_percent_each_are_split(spark):
    portion = lookups.rows_per_task(10**11)
    assert 10**9 / portion > 40  # one percent of 10^11 rows
    assert lookups.rows_per_task(640) == 10 and lookups.rows_per_task(0) == 1
    frame = spark.range(4000).select("id", F.when(F.col("id") % 10 < 7, F.col("id") % 10).alias("key"))
    table = frame.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    out = lookups.lookup(frame, table, "key", weight="n", spread="id", broadcast_bytes=0)
    assert out.count() == 4000 and out.where("key is not null and n <> 400").count() == 0
    assert out.where("key is null and n is not null").count() == 0
