"""CSV records over split edges, sketches of quantiles, refused records and manifests."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from rowproof.operators import contract as C
from rowproof.operators import ordering
from rowproof.operators import rules as R
from rowproof.plans.catalogue import Issue
from rowproof.sources import records, sinks, snapshots
from rowproof.streaming import score as S

FIELDS = ["plain", 'with "quote"', "two\nlines", "a,b", '" at start', 'end "', 'x\n\ny,"z"\n', '5" pipe', ""]


@pytest.mark.parametrize("broadcast_bytes", [records.BROADCAST_BYTES, 0])
def test_records_over_split_edges(spark, tmp_path, broadcast_bytes):
    pick, want = random.Random(2), []
    for number in range(3):
        header = ["a", "b", "c"] if number < 2 else ["c", "x", "a"]
        rows = [[f"{number}-{i}", pick.choice(FIELDS), "k" * pick.randrange(1, 60)] for i in range(60)]
        if number == 1:
            rows.append(["big", "line\n" * 900, "z"])  # over several splits
        want += [tuple(dict(zip(header, row)).get(name) or None for name in ("a", "b", "c", "x")) for row in rows]
        with open(tmp_path / f"part-{number}.csv", "w", newline="") as file:
            csv.writer(file, lineterminator="\n").writerows([header, *rows])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = records.read_csv_records(spark, str(tmp_path), "part-*.csv", ["a", "b", "c", "x"], broadcast_bytes)
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_file_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        records.read_csv_records(spark, str(tmp_path), "*.csv")


@pytest.mark.parametrize(("line", "closed", "opened"), [("a,b", False, True), ('"a', True, False), ('a,"b', True, False), ('a"b', False, False), ('""', False, True), ('x""', False, True)])
def test_end_states(line, closed, opened):
    assert records.ends_open(line, False) == closed and records.ends_open(line, True) == opened


def test_sketched_quantiles_keep_their_rank_error(spark):
    values = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("one")).otherwise(F.lit("many")).alias("g"),
        F.when(F.col("id") % 3 == 0, F.lit(1.5)).otherwise((F.col("id") * 7919 % 20_011).cast("double")).alias("v"),
    )
    values = values.unionByName(spark.createDataFrame([("one", None), ("many", float("nan")), ("none", None)], "g string, v double"))
    probabilities = (0.0, 0.1, 0.5, 0.99, 1.0)
    found = ordering.approximate_quantiles(values, "g", "v", probabilities, 0.01)
    assert {r["g"] for r in found.collect()} == {"one", "many"}
    errors = ordering.rank_errors(values, found, "g", "v", probabilities).collect()
    assert len(errors) == 10 and all(r["rank_error"] <= 0.01 for r in errors)
    wrong = found.withColumn("q2", F.lit(-5.0))
    assert ordering.rank_errors(values, wrong, "g", "v", probabilities).agg(F.max("rank_error")).first()[0] == 0.5


def test_refused_records_go_to_their_own_sink(spark, tmp_path):
    rows = [("a", "1"), (None, "2"), ("b", "x"), (" ", None), ("c", "-3")]
    spark.createDataFrame(rows, "k string, n string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, n string").parquet(str(tmp_path / "in"))
    rule = R.negative(Issue("low", "record", "low"), "n")
    path = str(tmp_path / "out")
    named = C.TableContract("_record_id", (C.ColumnRule("_record_id", "string", nullable=False), C.ColumnRule("n", "integer", nullable=False)))
    S.write_runs(
        stream.withColumnRenamed("k", "_record_id"), [rule], {"low": 10}, "record", path,
        str(tmp_path / "c"), fiscal_year=2024, contract=named,
    ).awaitTermination()
    refused = spark.read.parquet(f"{path}/refused")
    assert sorted(",".join(r["problems"]) for r in refused.collect()) == ["_record_id", "_record_id,n", "n"]
    assert [r["record_id"] for r in sinks.read_findings(spark, path).collect()] == ["c"]
    assert sinks.committed_runs(spark, path).first()["transaction_records"] + refused.count() == len(rows)


def test_snapshot_report_names_every_file(spark, tmp_path):
    folder = tmp_path / "snap"
    folder.mkdir()
    for name in ("a", "b", "c"):
        (folder / name).write_text(name)
    good = snapshots.file_digests(spark, str(folder))
    assert snapshots.snapshot_report(good, str(folder)).where("problem is not null").count() == 0
    odd = spark.createDataFrame(
        [("../a", 1, "x"), ("d", 1, "x"), (None, 1, "x"), ("b", None, "x"), ("/c", 1, "y")], snapshots.MANIFEST)
    manifest = good.where("file <> 'b'").unionByName(good.where("file = 'a'")).unionByName(odd)
    found = {r["file"]: r["problem"] for r in snapshots.snapshot_report(manifest, str(folder)).collect()}
    assert found == {
        "a": "listed twice", "b": "incomplete entry", "c": None, "../a": "outside the folder", "/c": "outside the folder",
        "d": "missing", None: "incomplete entry"}
    assert snapshots.snapshot_is_valid(spark, good.where("file <> 'b'"), str(folder))  # further files do not matter
    assert not snapshots.snapshot_is_valid(spark, good.limit(0), str(folder))
