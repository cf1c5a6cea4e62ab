import pytest
from pyspark.sql import functions as F

from rowproof.functions import text as X
from rowproof.operators import contract as C
from rowproof.operators import normalize as N
from rowproof.plans.baseline import prepare_period
from rowproof.sources import extracts, snapshots


def test_keys_prefer_the_first_identifier(spark):
    rows = [(" UEI123 ", "DUNS1"), (None, " 123456789 "), (None, None), ("  ", "")]
    frame = spark.createDataFrame(rows, "u string, d string")
    got = [r[0] for r in frame.select(N.stable_key(F.col("u"), F.col("d"))).collect()]
    assert got == ["UEI:UEI123", "DUNS:123456789", None, None]


def test_text_helpers(spark):
    def one(column, value):
        return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]

    for value in (" x ", "\tx\n", " x　", "\x1cx\x1f", " x\u0085"):
        assert one(X.strip, value) == value.strip() == "x"
    assert one(X.clean, " \n") is None
    assert one(X.missing_tokens_to_null, "NA") is None
    assert one(X.missing_tokens_to_null, "na") == "na"
    assert one(X.to_number, "NaN") is None and one(X.to_number, "1e3") == 1000.0
    assert one(X.to_number, "x") is None
    shown = lambda c: F.date_format(X.to_utc(c), "yyyy-MM-dd HH:mm:ss")
    assert one(shown, "03/01/2024") == "2024-03-01 00:00:00"
    assert one(shown, "2024-03-01T05:06:07+02:00") == "2024-03-01 03:06:07"
    assert one(shown, "20240301") == "2024-03-01 00:00:00"
    for bad in ("2024", "soon", "2024-13-01", "2024-02-30", ""):
        assert one(shown, bad) is None
    assert one(X.digest_long, "a" * 65).startswith("sha256:")


def test_transactions_are_typed_and_keep_leading_zeros(spark):
    raw = spark.createDataFrame(
        [(" T1 ", " ABC ", "001234567", "2024-02-03", "125.5", "n/k")],
        "contract_transaction_unique_key string, recipient_uei string, recipient_duns string, "
        "action_date string, federal_action_obligation string, number_of_offers_received string",
    )
    row = N.prepare_transactions(raw, "2024").first()
    assert row["vendor_id"] == "UEI:ABC" and row["recipient_duns"] == "001234567"
    assert row["fiscal_year"] == 2024 and row["federal_action_obligation"] == 125.5
    assert row["number_of_offers_received"] is None
    assert row["action_date"].strftime("%Y-%m-%d") == "2024-02-03"


VENDOR_ROW = {name: None for name in N.VENDOR_COLUMNS}


def vendor_rows(spark, rows):
    names = [*N.VENDOR_COLUMNS, "contract_transaction_unique_key", "last_modified_date", "action_date"]
    frame = spark.createDataFrame(
        [tuple({**VENDOR_ROW, **row}.get(name) for name in names) for row in rows],
        ", ".join(f"{name} string" for name in names),
    )
    return frame.withColumns(
        {n: F.col(n).cast("timestamp") for n in ("last_modified_date", "action_date")}
    )


def test_latest_vendor_row_wins_and_variants_are_counted(spark):
    base = {"vendor_id": "UEI:A", "recipient_uei": "A"}
    rows = [
        {**base, "recipient_name": "Old Name", "recipient_address_line_1": "1 Old St",
         "contract_transaction_unique_key": "T1", "last_modified_date": "2024-01-01"},
        {**base, "recipient_name": "Current Name", "recipient_address_line_1": "2 New St",
         "contract_transaction_unique_key": "T2", "last_modified_date": "2024-02-01"},
        {"vendor_id": None, "contract_transaction_unique_key": "T3"},
    ]
    got = N.build_vendors(vendor_rows(spark, rows)).collect()
    assert len(got) == 1 and got[0]["recipient_name"] == "Current Name"
    assert got[0]["source_transaction_count"] == 2
    assert got[0]["recipient_name_variant_count"] == got[0]["address_variant_count"] == 2
    assert len(got[0]) == 22


def test_missing_dates_lose_and_ties_go_to_the_smaller_key(spark):
    base = {"vendor_id": "V"}
    rows = [
        {**base, "recipient_name": "undated", "contract_transaction_unique_key": "A"},
        {**base, "recipient_name": "second", "contract_transaction_unique_key": "C",
         "last_modified_date": "2024-01-01", "action_date": "2024-01-01"},
        {**base, "recipient_name": "first", "contract_transaction_unique_key": "B",
         "last_modified_date": "2024-01-01", "action_date": "2024-01-01"},
        {**base, "recipient_name": None, "contract_transaction_unique_key": "A",
         "last_modified_date": "2024-01-01"},
    ]
    got = N.build_vendors(vendor_rows(spark, rows).repartition(4)).first()
    assert got["recipient_name"] == "first" and got["recipient_name_variant_count"] == 3
    empty = N.build_vendors(vendor_rows(spark, rows).where("false"))
    assert empty.count() == 0 and len(empty.columns) == 22


def test_record_ids_do_not_depend_on_business_keys(spark):
    frame = spark.createDataFrame([("same", 2), ("same", 1)], "vendor_id string, n int")
    got = N.add_record_ids(frame, "vendor", ["vendor_id", "n"]).orderBy("n").collect()
    assert [r["_record_id"] for r in got] == ["vendor:00000000", "vendor:00000001"]
    assert "_record_id" not in frame.columns


def test_feature_frames_keep_given_ids(spark):
    frame = spark.createDataFrame([("controlled:1", "k", 1.0)], "_record_id string, k string, x double")
    assert N.feature_frame(frame, "vendor", "k", ["x"]).first()["_record_id"] == "controlled:1"
    with pytest.raises(ValueError, match="missing columns: \\['y'\\]"):
        N.feature_frame(frame, "vendor", "k", ["y"])


def write_part(folder, name, lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_raw_parts_to_prepared_tables_and_manifest(spark, tmp_path):
    raw = tmp_path / "raw"
    extra = [n for n in N.VENDOR_COLUMNS if n not in ("vendor_id", "recipient_uei", "recipient_name")]
    header = ["contract_transaction_unique_key", "recipient_uei", "recipient_name", *extra,
              "action_date", "last_modified_date"]
    tail = ["" for _ in extra]
    write_part(raw / "fy2024", "All_PrimeTransactions_2.csv",
               [",".join(header), ",".join(["T2", "A", '"New, ""Inc"""', *tail, "2024-02-01", "2024-02-01"])])
    write_part(raw / "fy2024", "All_PrimeTransactions_1.csv",
               [",".join([*header, "surplus"]),
                ",".join(["T1", "A", "NA", *tail, "2024-01-01", "2024-01-01", "x"])])
    write_part(raw / "fy2024", "Other.csv", ["a", "1"])
    frame = extracts.read_raw_transactions(spark, str(raw), 2024)
    assert frame.count() == 2 and "surplus" in frame.columns
    manifest = prepare_period(spark, str(raw), str(tmp_path / "prepared"), 2024)
    assert manifest["transaction_rows"] == 2 and manifest["vendor_rows"] == 1
    assert manifest["duplicate_transaction_keys"] == manifest["unmatched_vendor_keys"] == 0
    vendors, transactions = extracts.read_period(spark, str(tmp_path / "prepared"), 2024)
    assert vendors.first()["recipient_name"] == 'New, "Inc"'
    assert extracts.read_period(spark, str(tmp_path / "prepared"), 2025)[0].count() == 0
    plan = transactions._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fiscal_year" in plan
    with pytest.raises(FileNotFoundError, match="FY2031"):
        extracts.read_raw_transactions(spark, str(raw), 2031)


def test_raw_parts_keep_records_with_quoted_line_breaks(spark, tmp_path):
    folder, header = tmp_path / "fy2024", "key,name,note"
    write_part(folder, "1_PrimeTransactions.csv", [header, 'a,"x, ""y""",1', 'b,"",2', 'c,"""q""","3"'])
    write_part(folder, "2_PrimeTransactions.csv", [header, 'd,"first\nsecond, ""third""\n",4', "e,plain,5"])
    # an even number of quotes on both lines of the record
    write_part(folder, "3_PrimeTransactions.csv", [header, 'f"g,"one\ntwo",h"i'])
    # the same with another header
    write_part(folder, "4_PrimeTransactions.csv", ["key,more", 'j,"\n"'])
    frame = extracts.read_raw_transactions(spark, str(tmp_path), 2024)
    assert sorted(tuple(row) for row in frame.select("key", "name", "note", "more").collect()) == [
        ("a", 'x, "y"', "1", None), ("b", None, "2", None), ("c", '"q"', "3", None),
        ("d", 'first\nsecond, "third"\n', "4", None), ("e", "plain", "5", None),
        ('f"g', "one\ntwo", 'h"i', None), ("j", None, None, "\n"),
    ]


def test_null_keys_count_as_duplicates_in_the_manifest_only(spark):
    vendors = spark.createDataFrame([("v",)], "vendor_id string")
    rows = [(None, "v"), (None, None), ("k", "w")]
    frame = spark.createDataFrame(rows, "contract_transaction_unique_key string, vendor_id string")
    row = snapshots.preparation_counts(vendors, frame).first()
    assert row["duplicate_transaction_keys"] == 2 and row["missing_vendor_keys"] == 1
    assert row["unmatched_vendor_keys"] == 1


def test_snapshots(spark, tmp_path):
    write_part(tmp_path / "snap", "a.csv", ["x"])
    good = [r.asDict() for r in snapshots.file_digests(spark, str(tmp_path / "snap")).collect()]
    check = lambda manifest: snapshots.snapshot_is_valid(spark, manifest, str(tmp_path / "snap"))
    assert check(good)
    assert not check([]) and not check(None) and not check([{"file": "a.csv"}])
    assert not check([{**good[0], "bytes": 1}]) and not check([{**good[0], "file": "../a.csv"}])
    (tmp_path / "snap" / "a.csv").write_text("y\n")
    assert not check(good)


def upload(spark, table, **values):
    columns = getattr(C.PROCUREMENT, table).columns
    row = {column.name: {"string": "x", "integer": "1", "number": "1.5",
                         "datetime": "2024-01-02"}[column.kind] for column in columns}
    row.update(values)
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} string" for n in row))


def test_valid_pair_is_coerced(spark):
    vendors, transactions = C.validate_pair(
        upload(spark, "vendor", vendor_id=" V "), upload(spark, "transaction", vendor_id="V", extra="e")
    )
    assert vendors.first()["vendor_id"] == "V" and "extra" in transactions.columns
    kinds = dict(transactions.dtypes)
    assert kinds["number_of_offers_received"] == "bigint" and kinds["action_date"] == "timestamp"
    assert kinds["federal_action_obligation"] == "double"


@pytest.mark.parametrize(
    ("table", "values", "message"),
    [
        ("transaction", {"number_of_offers_received": "1.5"}, "must contain integers"),
        ("transaction", {"number_of_offers_received": "many"}, r"invalid integer values: \['many'\]"),
        ("transaction", {"action_date": "soon"}, "invalid datetime values"),
        ("transaction", {"action_date": None}, "cannot contain missing values"),
        ("vendor", {"vendor_id": "  "}, "vendor.vendor_id cannot contain missing values"),
    ],
)
def test_broken_values_are_named(spark, table, values, message):
    with pytest.raises(ValueError, match=message):
        C.validate_table(upload(spark, table, **values), getattr(C.PROCUREMENT, table), table)


def test_broken_shapes_are_named(spark):
    contract = C.PROCUREMENT.transaction
    with pytest.raises(ValueError, match=r"missing required columns: \['action_date'\]"):
        C.validate_table(upload(spark, "transaction").drop("action_date"), contract, "transaction")
    with pytest.raises(ValueError, match="at least one record"):
        C.validate_table(upload(spark, "transaction").where("false"), contract, "transaction")
    with pytest.raises(ValueError, match="references 1 undeclared vendor keys|reference 1 undeclared"):
        C.validate_pair(upload(spark, "vendor", vendor_id="V"), upload(spark, "transaction", vendor_id="UNKNOWN"))
    twice = upload(spark, "vendor").select("*", F.lit("y").alias("vendor_id"))
    with pytest.raises(ValueError, match="must be unique"):
        C.validate_table(twice, C.PROCUREMENT.vendor, "vendor")


def test_contracts_check_themselves():
    rule = C.ColumnRule("a", "string")
    with pytest.raises(ValueError, match="names must be unique"):
        C.TableContract("a", (rule, rule))
    with pytest.raises(ValueError, match="business key"):
        C.TableContract("b", (rule,))
    table = C.TableContract("a", (rule,))
    with pytest.raises(ValueError, match="undeclared columns"):
        C.Contract(table, table, C.Relationship("r", "z", "a"))
    with pytest.raises(ValueError, match="Unknown table"):
        C.PROCUREMENT.table("other")


def test_single_records_are_split(spark):
    rows = [("V", 1, 1), ("", 1, 1), ("W", -1, 1), (None, 1, None)]
    frame = spark.createDataFrame(
        rows, "vendor_id string, source_transaction_count long, address_variant_count long"
    )
    for column in C.PROCUREMENT.vendor.columns:
        if column.name not in frame.columns:
            frame = frame.withColumn(column.name, F.lit(None).cast("string"))
    good, bad = C.split_records(frame, "vendor", C.PROCUREMENT.vendor, F.lit(2024))
    assert [r["vendor_id"] for r in good.collect()] == ["V"]
    assert {r["vendor_id"]: r["problems"] for r in bad.collect()} == {
        "": ["vendor_id"],
        "W": ["source_transaction_count"],
        None: ["vendor_id", "address_variant_count"],
    }
    assert C.split_records(frame, "vendor", C.PROCUREMENT.vendor, F.lit(1999))[0].count() == 0
    with pytest.raises(ValueError, match="unknown fields"):
        C.split_records(frame.withColumn("z", F.lit(1)), "vendor", C.PROCUREMENT.vendor, F.lit(2024))
