import numpy as np
import pytest
from pyspark.sql import functions as F

from rowproof.operators import features as X
from rowproof.operators import profile as P
from rowproof.operators.normalize import feature_frame


def by(frame, key):
    return {row[key]: row for row in frame.collect()}


def test_profile_types_and_missing_share(spark):
    frame = spark.createDataFrame(
        [("a", 1.0, "x"), ("b", None, "x")], "vendor_id string, amount double, category string"
    )
    for exact in (True, False):
        rows = by(P.profile_table(frame, exact), "field")
        assert rows["amount"]["missing_percent"] == 50.0 and rows["amount"]["unique_count"] == 1
        assert rows["vendor_id"]["semantic_type"] == "identifier"
        assert rows["amount"]["semantic_type"] == "numeric"
    assert [r["field"] for r in P.profile_table(frame).collect()] == ["amount", "category", "vendor_id"]


def test_semantic_types_by_name_type_and_ratio(spark):
    frame = spark.range(100).select(
        F.lit("v").alias("Kind"),
        F.col("id").cast("string").alias("note"),
        F.lit("2024").alias("START_DATE"),
        F.current_timestamp().alias("moment"),
        F.lit(1).alias("zip_code"),
    )
    kinds = {name: row["semantic_type"] for name, row in by(P.profile_table(frame), "field").items()}
    assert kinds == {"Kind": "categorical", "note": "text", "START_DATE": "date",
                     "moment": "date", "zip_code": "identifier"}


def test_duplicates(spark):
    rows = [("A", 1), ("A", 1), (None, 2)]
    frame = spark.createDataFrame(rows, "transaction_key string, value long")
    row = P.duplicate_summary(frame, "transaction_key").first().asDict()
    assert row == {"rows": 3, "exact_duplicate_rows": 1, "duplicate_key_rows": 2,
                   "duplicate_key_values": 1, "missing_key_rows": 1}


def test_join_quality(spark):
    parent = spark.createDataFrame([("A",)], "vendor_id string")
    child = spark.createDataFrame([("A",), ("B",), (None,)], "vendor_id string")
    row = P.join_quality(parent, child).first()
    assert row["matched_transaction_rows"] == row["unmatched_vendor_key_rows"] == 1
    assert row["missing_vendor_key_rows"] == 1 and row["match_rate_percent"] == 33.333


def test_histogram_of_equal_values_and_bounds(spark):
    frame = spark.createDataFrame([(-5.0,), (0.0,), (None,), (5.0,)], "x double")
    assert {r["bin"]: r["rows"] for r in P.log_histogram(frame, "x").collect()} == {0: 1, 40: 1, 79: 1}
    same = frame.select(F.lit(3.0).alias("x"))
    assert [tuple(r) for r in P.log_histogram(same, "x").collect()] == [(0, 4)]


SCHEMA = X.FeatureSchema(
    "vendor",
    (X.NumericFeature("source_transaction_count", "transaction_count", "signed_log1p"),),
    (X.CategoricalFeature("recipient_state_code", "state"),),
)
LAYOUT = "_record_id string, source_transaction_count double, recipient_state_code string"


@pytest.fixture(scope="module")
def training(spark):
    rows = [("V1", 1.0, "VA"), ("V2", 3.0, " VA"), ("V3", 10.0, "MD"), ("V4", None, " ")]
    return spark.createDataFrame(rows, LAYOUT)


def test_outputs_are_finite_in_the_declared_order(training):
    fit = X.fit_features(training, SCHEMA)
    rows = X.transform_features(training, SCHEMA, fit).orderBy("_record_id").collect()
    assert rows[0].__fields__ == ["_record_id", *SCHEMA.outputs]
    assert SCHEMA.outputs == ["transaction_count__scaled", "transaction_count__missing",
                              "state__frequency", "state__missing"]
    assert [r["state__frequency"] for r in rows] == [0.5, 0.5, 0.25, 0.25]
    assert [r["state__missing"] for r in rows] == [0.0, 0.0, 0.0, 1.0]
    assert [r["transaction_count__missing"] for r in rows] == [0.0, 0.0, 0.0, 1.0]
    logs = np.log1p([1, 3, 10])
    scale = np.quantile(logs, 0.75) - np.quantile(logs, 0.25)
    assert rows[2][1] == pytest.approx((logs[2] - np.median(logs)) / scale)


def test_unseen_values_count_zero(spark, training):
    fit = X.fit_features(training, SCHEMA)
    frame = spark.createDataFrame([("S1", 3.0, "VA"), ("S2", None, "ZZ")], LAYOUT)
    rows = X.transform_features(frame, SCHEMA, fit).orderBy("_record_id").collect()
    assert [r["state__frequency"] for r in rows] == [0.5, 0.0]
    assert [r["transaction_count__scaled"] for r in rows] == pytest.approx([0.0, 0.0])


def test_bad_training_frames_are_refused(spark, training):
    with pytest.raises(ValueError, match="empty"):
        X.fit_features(training.where("false"), SCHEMA)
    with pytest.raises(ValueError, match="recipient_state_code"):
        X.fit_features(training.drop("recipient_state_code"), SCHEMA)
    text = training.withColumn("source_transaction_count", F.lit("not-a-number"))
    with pytest.raises(ValueError, match="non-numeric"):
        X.fit_features(text, SCHEMA)
    endless = training.withColumn("source_transaction_count", F.lit(float("inf")))
    with pytest.raises(ValueError, match="finite"):
        X.fit_features(endless, SCHEMA)
    none = training.withColumn("source_transaction_count", F.lit(None).cast("double"))
    with pytest.raises(ValueError, match="no non-missing"):
        X.fit_features(none, SCHEMA)
    with pytest.raises(ValueError, match="missing values"):
        X.fit_features(training.withColumn("_record_id", F.lit(" ")), SCHEMA)
    with pytest.raises(ValueError, match="unique"):
        X.fit_features(training.withColumn("_record_id", F.lit("V")), SCHEMA)
    with pytest.raises(ValueError, match="development period"):
        X.fit_features(training, SCHEMA, "temporal_holdout")


def test_schemas_check_themselves():
    feature = X.NumericFeature("a", "a")
    for numeric, version, message in (((), 1, "at least one"), ((feature, feature), 1, "unique"),
                                      ((feature,), 0, "positive")):
        with pytest.raises(ValueError, match=message):
            X.FeatureSchema("vendor", numeric, version=version)
    assert len(X.VENDOR_FEATURES.outputs) == 10 and len(X.TRANSACTION_FEATURES.outputs) == 22
    assert not set(X.VENDOR_FEATURES.outputs) & set(X.TRANSACTION_FEATURES.outputs)


def test_duplicate_business_keys_are_fine_for_features(spark):
    rows = [("UEI:A", 2, 1, "USA", "VA", "S"), ("UEI:A", 3, 2, "USA", "MD", "O")]
    names = ["vendor_id", *X.VENDOR_FEATURES.sources]
    frame = feature_frame(
        spark.createDataFrame(rows, names), "vendor", "vendor_id", X.VENDOR_FEATURES.sources
    )
    fit = X.fit_features(frame, X.VENDOR_FEATURES)
    found = X.transform_features(frame, X.VENDOR_FEATURES, fit)
    assert found.count() == 2 and len(found.columns) == 11


def test_fits_round_trip_and_tampering_is_noticed(spark, training, tmp_path):
    fit = X.fit_features(training, SCHEMA)
    path = str(tmp_path / "fit")
    X.save_fit(fit, SCHEMA, path)
    loaded, schema = X.load_fit(spark, path)
    assert schema == SCHEMA
    first = X.transform_features(training, SCHEMA, fit)
    assert first.exceptAll(X.transform_features(training, schema, loaded)).count() == 0
    wrong = fit.categorical.withColumn("frequency", F.lit(0.9))
    wrong.write.mode("overwrite").parquet(f"{path}/categorical")
    with pytest.raises(ValueError, match="cannot sum"):
        X.load_fit(spark, path)
    fit.numeric.withColumn("scale", F.lit(0.0)).write.mode("overwrite").parquet(f"{path}/numeric")
    with pytest.raises(ValueError, match="scale must be positive"):
        X.load_fit(spark, path)
