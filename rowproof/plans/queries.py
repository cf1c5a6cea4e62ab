"""The registered queries: each runs one operator over whole tables of a folder.

Every query takes (spark, folder). Doubles are rounded to six decimals and times shown as
text, so that the results can be compared with SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.functions import text as X
from rowproof.operators import anomaly, contract, defects, evaluate, features, iforest, lof
from rowproof.operators import neighbours, normalize, ordering, profile, projections, rerank, review
from rowproof.operators import rules as R
from rowproof.plans import baseline, batch, experiment, views
from rowproof.plans.catalogue import DEFECTS_PER_TYPE, WEIGHTS, Issue
from rowproof.session import cut, prepare, shared_folder, side_by_side, small_table, spread
from rowproof.sources import extracts, sinks, snapshots
from rowproof.streaming import score as streaming

SEED = 20240622
PER_TYPE = DEFECTS_PER_TYPE  # four vendor steps need 160 vendors: the smallest folder has too few
K = 50
MIDDLE = "1998-04-17"  # splits the orders into two periods

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(function: Callable[[SparkSession, str], DataFrame]):
    @wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(prepare(spark), folder)

    QUERIES[function.__name__] = run
    return run


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    return frame.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in frame.schema
        ]
    )


def timed(frame: DataFrame) -> DataFrame:
    return frame.select(
        *[
            F.date_format(f.name, "yyyy-MM-dd HH:mm:ss").alias(f.name)
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
            else F.col(f"`{f.name}`")
            for f in frame.schema
        ]
    )


# --- rules -------------------------------------------------------------------------------


def _one_rule(name: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        data = views.pair(spark, folder)
        rule = next(r for r in R.procurement_rules(data.fiscal_year) if r.issue.name == name)
        frame = data.vendors if rule.issue.table == "vendor" else data.transactions
        return R.find_issues(frame, [rule], WEIGHTS, data.vendors)

    return run


RULE_QUERIES = {
    "rule_blank": "missing_vendor_name",
    "rule_regex": "invalid_vendor_uei",
    "rule_domain": "invalid_domestic_state",
    "rule_duplicate_parent": "duplicate_vendor_id",
    "rule_orphan": "orphan_vendor_reference",
    "rule_duplicate_key": "duplicate_transaction_key",
    "rule_date_order": "invalid_performance_date_order",
    "rule_negative": "negative_offer_count",
    "rule_fiscal_year": "action_date_outside_fiscal_year",
}
for _name, _issue in RULE_QUERIES.items():
    _query = _one_rule(_issue)
    _query.__name__ = _name
    register(_query)


@register
def findings_ranked(spark: SparkSession, folder: str) -> DataFrame:
    data = views.pair(spark, folder)
    return R.run_rules(
        data.vendors, data.transactions, R.procurement_rules(data.fiscal_year), WEIGHTS
    )


@register
def findings_single_table(spark: SparkSession, folder: str) -> DataFrame:
    """Rule selection: transactions only, without relationship rules."""
    data = views.pair(spark, folder)
    return R.run_rules(
        data.vendors,
        data.transactions,
        R.procurement_rules(data.fiscal_year),
        WEIGHTS,
        targets=("transaction",),
        relationships=False,
    )


LINE_WEIGHTS = {"order_missing": 100, "line_repeated": 90, "flag_unknown": 40, "ship_late": 60}


def _line_rules() -> list[R.Rule]:
    low = datetime(1995, 6, 1, tzinfo=timezone.utc)
    high = datetime(2000, 6, 1, tzinfo=timezone.utc)
    return [
        R.orphan(Issue("order_missing", "line", "critical"), "order_key", "order_key", "order"),
        R.duplicated(Issue("line_repeated", "line", "critical"), "line_key"),
        R.not_matching(Issue("flag_unknown", "line", "low"), "flag", "[AN]", "is not A or N"),
        R.outside_window(Issue("ship_late", "line", "medium"), "shipped", low, high, "the window"),
    ]


@register
def findings_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """The same rule kinds on another pair: all lines, and orders whose key is another if pending."""
    orders = views.table(spark, folder, "orders")
    lines = views.table(spark, folder, "lineitem")
    # numbered rows are a written table already
    child = normalize.add_record_ids(
        lines.select(
            F.col("l_orderkey").alias("order_key"),
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_key"),
            F.col("l_returnflag").alias("flag"),
            F.col("l_shipdate").cast("timestamp").alias("shipped"),
        ),
        "line",
        ["line_key", "flag", "shipped"],
        narrow=True,
    )
    key = F.col("o_orderkey")
    parent = orders.select(F.when(F.col("o_orderstatus") == "P", -1 - key).otherwise(key).alias("order_key"))
    return R.run_rules(parent, child, _line_rules(), LINE_WEIGHTS, names=("order", "line"))


@register
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    data = views.pair(spark, folder)
    return R.run_summary(data.vendors, data.transactions, findings_ranked(spark, folder))


@register
def finding_keys(spark: SparkSession, folder: str) -> DataFrame:
    return R.finding_keys(findings_ranked(spark, folder))


@register
def record_keys(spark: SparkSession, folder: str) -> DataFrame:
    return R.record_keys(findings_ranked(spark, folder))


def _as_text(frame: DataFrame) -> DataFrame:
    """What an upload of the view looks like: every column a string, no record ids."""
    return frame.drop("_record_id").select(
        *[F.col(name).cast("string").alias(name) for name in frame.columns if name != "_record_id"]
    )


def _valid_pair(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The pair with unknown vendors of orders replaced by the first one, as an upload has to be."""
    data = views.pair(spark, folder)
    known = data.vendors.select("vendor_id", F.col("vendor_id").alias("_known")).distinct()
    first = data.vendors.agg(F.min("vendor_id").alias("_first"))  # one row
    orders = data.transactions.join(known, "vendor_id", "left").join(F.broadcast(first), F.lit(True))
    orders = orders.withColumn("vendor_id", F.coalesce("_known", "_first"))
    return data.vendors, orders.select(*data.transactions.columns)


@register
def score_batch(spark: SparkSession, folder: str) -> DataFrame:
    vendors, transactions = _valid_pair(spark, folder)
    order = "contract_transaction_unique_key"
    scored = batch.score_batch(
        _as_text(vendors),
        _as_text(transactions),
        views.FISCAL_YEAR,
        vendor_order=["vendor_id", "recipient_uei"],
        transaction_order=[order, "action_date", "federal_action_obligation"],
    )
    return scored.findings


@register
def score_records(spark: SparkSession, folder: str) -> DataFrame:
    return batch.score_records(
        _as_text(views.vendors(spark, folder)),
        "vendor",
        views.FISCAL_YEAR,
        order=["vendor_id", "recipient_uei"],
    )


# --- normalisation and contract ----------------------------------------------------------


@register
def clean_strings(spark: SparkSession, folder: str) -> DataFrame:
    padded = views.table(spark, folder, "documents").select(
        "doc_id",
        "text",
        F.concat(F.lit(" \t"), "lang", F.lit("\n ")).alias("lang"),
        F.when(F.col("lang") == "en", F.lit(" \n ")).otherwise(F.col("source")).alias("source"),
    )
    return normalize.clean_strings(padded)


@register
def stable_key(spark: SparkSession, folder: str) -> DataFrame:
    customer = views.table(spark, folder, "customer")
    uei = F.when(F.col("c_acctbal") < 0, F.lit("  ")).when(
        F.col("c_nationkey") != 3, F.concat(F.lit(" "), "c_name", F.lit(" "))
    )
    duns = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_custkey").cast("string"))
    return customer.select("c_custkey", normalize.stable_key(uei, duns).alias("vendor_id"))


def _raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a raw extract: padded strings, several date layouts, unusable numbers."""
    orders = views.table(spark, folder, "orders")
    status, day = F.col("o_orderstatus"), F.col("o_orderdate")
    return orders.select(
        F.format_string(" T%d ", "o_orderkey").alias("contract_transaction_unique_key"),
        F.when(status != "P", F.format_string("%d ", "o_custkey")).alias("recipient_uei"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.format_string("%09d", "o_custkey")).alias(
            "recipient_duns"
        ),
        F.when(status == "F", F.date_format(day, "MM/dd/yyyy"))
        .when(status == "O", F.date_format(day, "yyyy-MM-dd"))
        .otherwise(F.lit("unknown"))
        .alias("action_date"),
        F.when(status == "P", F.concat(F.lit("$"), "o_totalprice"))
        .otherwise(F.col("o_totalprice").cast("string"))
        .alias("federal_action_obligation"),
        F.concat(F.lit("  "), "o_orderpriority").alias("recipient_name"),
    )


@register
def prepare_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return timed(normalize.prepare_transactions(_raw_orders(spark, folder), views.FISCAL_YEAR))


@register
def coerce_types(spark: SparkSession, folder: str) -> DataFrame:
    events = views.table(spark, folder, "events")
    raw = F.get_json_object("props", "$.k")
    mixed = F.when(F.col("event_type") == "error", F.concat(raw, F.lit("x"))).otherwise(raw)
    day = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    stamp = F.when(F.col("event_type") == "click", F.lit("soon")).otherwise(day)
    return timed(
        events.select(
            "event_id", X.to_number(mixed).alias("k"), X.to_utc(stamp).alias("at")
        )
    )


@register
def record_ids(spark: SparkSession, folder: str) -> DataFrame:
    customer = views.table(spark, folder, "customer")
    order = ["c_nationkey", "c_custkey"]
    numbered = normalize.add_record_ids(customer, "vendor", order, unique=True)
    return numbered.select("c_custkey", "_record_id")


@register
def latest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    orders = views.table(spark, folder, "orders")
    return timed(
        normalize.latest_per_key(
            orders,
            "o_custkey",
            ["o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"],
            ["o_orderdate"],
            ["o_orderkey"],
            {"o_orderstatus": "status_variants", "o_orderpriority": "priority_variants"},
            "order_count",
        )
    )


@register
def contract_check(spark: SparkSession, folder: str) -> DataFrame:
    """Violations per check of an upload with fractions, unusable dates and blanks."""
    upload = _as_text(views.transactions(spark, folder))
    status = F.col("award_type_code")
    broken = upload.withColumn(
        "number_of_offers_received",
        F.when(status == "F", F.lit("1.5"))
        .when(status == "P", F.lit("many"))
        .otherwise(F.col("number_of_offers_received")),
    ).withColumn("action_date", F.when(status == "P", F.lit("soon")).otherwise(F.col("action_date")))
    return contract.violation_counts(broken, contract.PROCUREMENT.transaction)


@register
def contract_coerce(spark: SparkSession, folder: str) -> DataFrame:
    upload = _as_text(views.transactions(spark, folder))
    return timed(contract.coerce_table(upload, contract.PROCUREMENT.transaction))


@register
def fk_check(spark: SparkSession, folder: str) -> DataFrame:
    data = views.pair(spark, folder)
    return contract.unknown_keys(data.vendors, data.transactions, "vendor_id", "vendor_id")


@register
def record_constraints(spark: SparkSession, folder: str) -> DataFrame:
    """Why single records are refused, counted."""
    records = views.vendors(spark, folder).drop("_record_id")
    changed = records.withColumn(
        "source_transaction_count",
        F.when(F.col("recipient_name").isNull(), -1).otherwise(F.col("source_transaction_count")),
    ).withColumn("vendor_id", F.when(F.col("recipient_state_code").isNotNull(), F.col("vendor_id")))
    _, refused = contract.split_records(
        changed, "vendor", contract.PROCUREMENT.vendor, F.lit(2024)
    )
    return (
        refused.select(F.explode("problems").alias("problem"))
        .groupBy("problem")
        .agg(F.count(F.lit(1)).alias("records"))
    )


@register
def feature_projection(spark: SparkSession, folder: str) -> DataFrame:
    schema = features.VENDOR_FEATURES
    frame = views.vendors(spark, folder)
    return normalize.feature_frame(frame, "vendor", "vendor_id", schema.sources)


@register
def preparation_counts(spark: SparkSession, folder: str) -> DataFrame:
    data = views.pair(spark, folder)
    return snapshots.preparation_counts(data.vendors, data.transactions)


# --- profiling ---------------------------------------------------------------------------


@register
def profile_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return profile.profile_table(views.transactions(spark, folder)).drop("dtype")


@register
def profile_documents(spark: SparkSession, folder: str) -> DataFrame:
    return profile.profile_table(views.table(spark, folder, "documents")).drop("dtype")


@register
def profile_approximate(spark: SparkSession, folder: str) -> DataFrame:
    return profile.profile_table(views.table(spark, folder, "lineitem"), exact=False)


@register
def duplicate_summary(spark: SparkSession, folder: str) -> DataFrame:
    return profile.duplicate_summary(views.table(spark, folder, "lineitem"), "l_orderkey")


@register
def duplicate_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = views.table(spark, folder, "documents").select("lang", "text")
    return profile.duplicate_summary(documents, "text")


@register
def join_quality(spark: SparkSession, folder: str) -> DataFrame:
    data = views.pair(spark, folder)
    return profile.join_quality(data.vendors, data.transactions)


@register
def shape_comparison(spark: SparkSession, folder: str) -> DataFrame:
    year = F.year("action_date").alias("fiscal_year")
    transactions = views.transactions(spark, folder).select("*", year)
    return profile.shape_comparison({"transactions": transactions})


def _two_periods(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    transactions = views.transactions(spark, folder)
    early = F.col("action_date") < F.lit(MIDDLE).cast("timestamp")
    return transactions.where(early), transactions.where(~early)


@register
def missing_top(spark: SparkSession, folder: str) -> DataFrame:
    early, late = _two_periods(spark, folder)
    return profile.missingness_comparison(
        profile.profile_table(early), profile.profile_table(late), ("early", "late"), 12
    )


@register
def distribution(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["federal_action_obligation", "total_dollars_obligated", "number_of_offers_received"]
    return rounded(
        profile.distribution_summary(
            views.transactions(spark, folder), columns, (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
        ),
        4,
    )


@register
def distribution_approx(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the sketched percentiles of line prices and taxes keep the stated rank error."""
    columns, percentiles, most = ["price", "tax"], (0.01, 0.25, 0.5, 0.75, 0.99), 0.005
    lines = views.table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").cast("double").alias("price"), F.col("l_tax").cast("double").alias("tax")
    )
    summary = profile.distribution_summary(lines, columns, percentiles, approx=True, relative_error=most)
    names = [f"p{100 * p:g}" for p in percentiles]
    sketched = summary.select("field", "count", *[F.col(name).alias(f"q{i}") for i, name in enumerate(names)])
    values = ordering.stack_columns(lines, {name: F.col(name) for name in columns}, "field", "value")
    found = ordering.rank_errors(values, sketched, "field", "value", percentiles)
    return found.select("field", "probability", "n", (F.col("rank_error") <= most).alias("within"))


@register
def log_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return profile.log_histogram(views.transactions(spark, folder), "total_dollars_obligated")


@register
def group_counts(spark: SparkSession, folder: str) -> DataFrame:
    transactions = views.transactions(spark, folder)
    return profile.group_counts(transactions, ["extent_competed_code", "solicitation_procedures_code"])


@register
def monthly_volume(spark: SparkSession, folder: str) -> DataFrame:
    return profile.monthly_volume(views.table(spark, folder, "events"), "ts")


def _volumes(spark: SparkSession, folder: str) -> DataFrame:
    return (
        views.transactions(spark, folder)
        .groupBy("vendor_id")
        .agg(F.count(F.lit(1)).alias("transactions"))
    )


@register
def concentration(spark: SparkSession, folder: str) -> DataFrame:
    return profile.concentration_ranks(_volumes(spark, folder), "vendor_id", "transactions")


@register
def concentration_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.concentration_quantiles(_volumes(spark, folder), "transactions"))


# --- defects and their evaluation --------------------------------------------------------


def _injected(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    data = views.pair(spark, folder)
    return defects.inject_defects(
        data.vendors,
        data.transactions,
        defects.procurement_defects(data.fiscal_year),
        fiscal_year=data.fiscal_year,
        seed=SEED,
        per_type=PER_TYPE,
    )


@register
def inject_vendors(spark: SparkSession, folder: str) -> DataFrame:
    return _injected(spark, folder)[0]


@register
def inject_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return timed(_injected(spark, folder)[1])


@register
def defect_labels(spark: SparkSession, folder: str) -> DataFrame:
    return _injected(spark, folder)[2]


@register
def baseline_metrics(spark: SparkSession, folder: str) -> DataFrame:
    data = views.pair(spark, folder)
    _, _, metrics = baseline.measured_period(
        data.vendors, data.transactions, data.fiscal_year, WEIGHTS, SEED, PER_TYPE, K
    )
    return rounded(metrics)


def _document_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents as defects: low quality (high) and toxic (critical)."""
    labels = views.table(spark, folder, "labels")
    documents = views.table(spark, folder, "documents").select("doc_id", "lang")
    kinds = F.array_compact(
        F.array(
            F.when(
                F.col("quality") == 0,
                F.struct(F.lit("low_quality").alias("issue_type"), F.lit("high").alias("severity")),
            ),
            F.when(
                F.col("toxic") == 1,
                F.struct(F.lit("toxic").alias("issue_type"), F.lit("critical").alias("severity")),
            ),
        )
    )
    return labels.join(documents, "doc_id").select(
        F.col("lang").alias("target_table"),
        F.col("doc_id").cast("string").alias("record_id"),
        F.explode(kinds).alias("_kind"),
    ).select("target_table", "record_id", "_kind.*")


def _document_findings(spark: SparkSession, folder: str) -> DataFrame:
    documents = views.table(spark, folder, "documents")
    kinds = F.array_compact(
        F.array(
            F.when(
                F.col("n_chars") < 600,
                F.struct(
                    F.lit("low_quality").alias("issue_type"),
                    F.lit("high").alias("severity"),
                    F.lit(3).alias("severity_rank"),
                    F.lit(75).alias("risk_score"),
                ),
            ),
            F.when(
                F.contains("text", F.lit("!")),
                F.struct(
                    F.lit("toxic").alias("issue_type"),
                    F.lit("critical").alias("severity"),
                    F.lit(4).alias("severity_rank"),
                    F.lit(100).alias("risk_score"),
                ),
            ),
        )
    )
    return documents.select(
        F.col("lang").alias("target_table"),
        F.col("doc_id").cast("string").alias("record_id"),
        F.explode(kinds).alias("_kind"),
    ).select("target_table", "record_id", "_kind.*")


def _document_ranking(spark: SparkSession, folder: str, longest_first: bool = True) -> DataFrame:
    """Documents ranked by length, as a stand-in for a model's scores."""
    length = F.least(F.lit(1.0), F.col("n_chars") / 8000)
    percentile = length if longest_first else 1 - length
    return views.table(spark, folder, "documents").select(
        F.col("lang").alias("target_table"),
        F.col("doc_id").cast("string").alias("record_id"),
        F.lit("long" if longest_first else "short").alias("model_name"),
        percentile.alias("rank_percentile"),
        (percentile * 100).alias("priority_score"),
        (percentile >= 0.6).alias("predicted"),
    )


def _document_counts(spark: SparkSession, folder: str) -> dict[str, int]:
    """Four languages."""
    counted = views.table(spark, folder, "documents").groupBy("lang").count().collect()
    return {row["lang"]: row["count"] for row in counted}


@register
def eval_issue(spark: SparkSession, folder: str) -> DataFrame:
    records = sum(_document_counts(spark, folder).values())
    return rounded(
        evaluate.evaluate_issues(
            _document_labels(spark, folder), _document_findings(spark, folder), records, K
        )
    )


@register
def eval_record(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        evaluate.evaluate_ranking(
            _document_labels(spark, folder),
            _document_ranking(spark, folder),
            _document_counts(spark, folder),
            K,
        )
    )


@register
def eval_per_table(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        evaluate.per_table_metrics(
            _document_labels(spark, folder),
            _document_ranking(spark, folder),
            _document_counts(spark, folder),
            K,
        ).drop("severe", "severe_found")
    )


@register
def calibration(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        evaluate.rank_calibration(_document_labels(spark, folder), _document_ranking(spark, folder))
    )


def _winners(spark: SparkSession, folder: str) -> DataFrame:
    counts, labels = _document_counts(spark, folder), _document_labels(spark, folder)
    tables = [
        evaluate.per_table_metrics(
            labels, _document_ranking(spark, folder, longest), counts, K
        ).withColumn("model_name", F.lit("long" if longest else "short"))
        for longest in (True, False)
    ]
    return evaluate.winners(tables[0].unionByName(tables[1]), K)


@register
def winners(spark: SparkSession, folder: str) -> DataFrame:
    return _winners(spark, folder)


@register
def combined_scores(spark: SparkSession, folder: str) -> DataFrame:
    both = _document_ranking(spark, folder).unionByName(_document_ranking(spark, folder, False))
    return rounded(evaluate.combine(both, _winners(spark, folder)))


@register
def gates(spark: SparkSession, folder: str) -> DataFrame:
    counts, labels = _document_counts(spark, folder), _document_labels(spark, folder)
    long, short = (
        evaluate.evaluate_ranking(labels, _document_ranking(spark, folder, first), counts, K)
        for first in (True, False)
    )
    return evaluate.promotion_gates(
        long, short, long, evaluate.PromotionCriteria(), "development", K
    )


@register
def metrics_comparison(spark: SparkSession, folder: str) -> DataFrame:
    counts, labels = _document_counts(spark, folder), _document_labels(spark, folder)
    parts = {
        ("development", name): evaluate.evaluate_ranking(
            labels, _document_ranking(spark, folder, name == "long"), counts, K
        )
        for name in ("long", "short")
    }
    return rounded(evaluate.comparison(evaluate.metrics_long(parts), K))


# --- features and models -----------------------------------------------------------------


@register
def features_fit_numeric(spark: SparkSession, folder: str) -> DataFrame:
    frame = views.transactions(spark, folder)
    return rounded(features.fit_numeric(frame, features.TRANSACTION_FEATURES))


@register
def features_fit_approx(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the sketched quartiles of every feature keep the stated rank error, by exact ranks."""
    frame, schema, most = views.transactions(spark, folder), features.TRANSACTION_FEATURES, 0.01
    values = features.numeric_values(frame, schema)
    sketched = ordering.approximate_quantiles(values, "feature", "value", features.QUARTILES, most)
    fit = features.fit_numeric(frame, schema, approx=True, relative_error=most)
    found = ordering.rank_errors(values, sketched, "feature", "value", features.QUARTILES)
    return found.join(fit.select("feature", F.lit(True).alias("fitted")), "feature").select(
        "feature", "probability", "n", (F.col("rank_error") <= most).alias("within"), "fitted"
    )


@register
def features_fit_categorical(spark: SparkSession, folder: str) -> DataFrame:
    frame = views.transactions(spark, folder)
    return rounded(features.fit_categorical(frame, features.TRANSACTION_FEATURES))


def _features(spark: SparkSession, folder: str, table: str) -> DataFrame:
    schema = experiment.SCHEMAS[table]
    frame = getattr(views.pair(spark, folder), f"{table}s")
    fit = features.fit_features(frame, schema)
    return features.transform_features(frame, schema, fit)


@register
def features_check(spark: SparkSession, folder: str) -> DataFrame:
    """Checks of a feature input with missing and repeated ids, words for numbers, and infinite numbers."""
    orders, key = views.table(spark, folder, "orders"), F.col("o_orderkey")
    number = F.when(key % 11 == 0, F.lit("n/a")).when(key % 13 == 0, F.lit("Infinity")).otherwise(F.col("o_totalprice").cast("string"))
    schema = features.FeatureSchema(
        "order",
        (features.NumericFeature("price", "price", "identity"), features.NumericFeature("o_custkey", "customer", "identity")),
        (),
    )
    rows = orders.select(
        F.when(key % 17 == 0, F.lit(" ")).otherwise(F.floor(key / 2).cast("string")).alias("_record_id"),
        number.alias("price"),
        "o_custkey",
    )
    return features.feature_problems(rows, schema)


@register
def features_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Vendor features from a fit that was saved and loaded."""
    schema, path = experiment.SCHEMAS["vendor"], scratch(spark)
    vendors = views.vendors(spark, folder)
    features.save_fit(features.fit_features(vendors, schema), schema, f"{path}/fit")
    fit, loaded = features.load_fit(spark, f"{path}/fit")
    return rounded(features.transform_features(vendors, loaded, fit))


@register
def features_vendor(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_features(spark, folder, "vendor"))


@register
def features_transaction(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_features(spark, folder, "transaction"))


def _prices(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(all orders, training orders): the order price as a raw score."""
    orders = views.table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.round(F.col("o_totalprice") / 100).alias("raw"),
        "o_orderstatus",
    )
    training = orders.where("o_orderstatus = 'F'").select("raw")
    return orders.drop("o_orderstatus"), training


@register
def threshold(spark: SparkSession, folder: str) -> DataFrame:
    scores, _ = _prices(spark, folder)
    value = anomaly.review_threshold(scores, 0.025)
    return scores.where(F.col("raw") >= value).agg(
        F.min("raw").alias("threshold"), F.count(F.lit(1)).alias("reviewed")
    )


@register
def rank_percentile(spark: SparkSession, folder: str) -> DataFrame:
    scores, training = _prices(spark, folder)
    value = anomaly.review_threshold(training, 0.025)
    return rounded(anomaly.rank_scores(scores, training, value, "id"))


@register
def reference_stats(spark: SparkSession, folder: str) -> DataFrame:
    frame = views.transactions(spark, folder).withColumn("constant", F.lit(2.0))
    names = ["federal_action_obligation", "number_of_offers_received", "constant"]
    return rounded(anomaly.reference_stats(frame, names), 4)


@register
def evidence_topk(spark: SparkSession, folder: str) -> DataFrame:
    orders = views.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.floor(F.col("o_totalprice") / 10) / 100).alias("price"),
        F.col("o_custkey").cast("double").alias("customer"),
        F.month("o_orderdate").cast("double").alias("month"),
        F.dayofmonth("o_orderdate").cast("double").alias("day"),
    )
    text = anomaly.evidence(
        ["price", "customer", "month", "day"],
        {"price": 250.0, "customer": 512.0, "month": 6.0, "day": 16.0},
        {"price": 128.0, "customer": 256.0, "month": 4.0, "day": 8.0},
        F.col("price") / 8,
        F.col("price") / 1024,
    )
    return orders.select("id", text.alias("evidence"))


def _embeddings(spark: SparkSession, folder: str) -> DataFrame:
    table = views.table(spark, folder, "embeddings")
    return table.select(
        F.format_string("%08d", "vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )


@register
def lof_scores(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _embeddings(spark, folder)
    return rounded(lof.score_lof(vectors, lof.fit_lof(vectors, 35)))


@register
def lof_scores_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The same scores with reference vectors in many blocks."""
    vectors = _embeddings(spark, folder)
    return rounded(lof.score_lof(vectors, lof.fit_lof(vectors, 35, block_rows=64)))


@register
def lof_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Whether approximate neighbours hold at least 0.9 of the 35 exact ones, and how many pairs were looked for."""
    # ids and numbers as they are stored: half as wide, and the same distances
    vectors = views.table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    groups = cut(neighbours.distinct_vectors(vectors))
    asked = groups.select(F.col("ref").alias("query"), "vector")
    found = projections.approximate_neighbours(asked, groups, 35, slice_rows=512)
    exact = neighbours.nearest_neighbours(asked, neighbours.build_index(groups), 35, known=found)
    return projections.recall(found, exact).select(
        F.col("pairs").alias("exact_pairs"), (F.col("recall") >= 0.9).alias("recall_reached")
    )


@register
def iforest_scores(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _embeddings(spark, folder)
    nodes, size = iforest.fit_iforest(vectors, 200, 42)
    scores = iforest.score_iforest(vectors, nodes, size)
    return ordering.share_at_or_below(scores, scores, "raw", "id", "rank_percentile")


# a fixed forest over (price in thousands, customer, month): tree, node, feature, threshold, left, right, depth, size
FOREST = (
    (0, 0, 0, 100.0, 1, 2, 0, 16), (0, 1, 2, 6.0, 3, 4, 1, 9), (0, 2, -1, 0.0, -1, -1, 1, 7),
    (0, 3, -1, 0.0, -1, -1, 2, 1), (0, 4, -1, 0.0, -1, -1, 2, 8),
    (1, 0, 1, 700.0, 1, 2, 0, 16), (1, 1, 0, 250.0, 3, 4, 1, 14), (1, 2, -1, 0.0, -1, -1, 1, 2),
    (1, 3, 2, 3.0, 5, 6, 2, 10), (1, 4, -1, 0.0, -1, -1, 2, 4), (1, 5, -1, 0.0, -1, -1, 3, 3),
    (1, 6, -1, 0.0, -1, -1, 3, 7), (2, 0, -1, 0.0, -1, -1, 0, 16),
)


@register
def iforest_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Path lengths and scores of all orders in a given forest, by expressions alone."""
    orders = views.table(spark, folder, "orders")
    vector = F.array(
        F.floor(F.col("o_totalprice") / 1000).cast("double"),
        F.col("o_custkey").cast("double"),
        F.month("o_orderdate").cast("double"),
    )
    rows = orders.select(F.col("o_orderkey").alias("id"), vector.alias("vector"))
    nodes = small_table(spark, FOREST, iforest.NODES)
    paths = iforest.path_lengths(rows, nodes)
    scores = iforest.score_by_expressions(rows, nodes, 16)
    return rounded(paths.join(scores, "id").select("id", "path", "raw"))


@register
def iforest_samples(spark: SparkSession, folder: str) -> DataFrame:
    """A certificate of every tree of a grown forest, and whether both ways of scoring agree on all rows."""
    vectors = _embeddings(spark, folder)
    nodes, size = iforest.fit_iforest(vectors, 50, 42)
    sampled = cut(iforest.sample_rows(vectors, 50, 42)[0])
    one = iforest.score_iforest(vectors, nodes, size)
    other = iforest.score_by_expressions(vectors, nodes, size).withColumnRenamed("raw", "other")
    agreed = one.join(other, "id").agg(
        F.count_if(F.abs(F.col("raw") - F.col("other")) < 1e-9).alias("agreed")
    )
    return iforest.certificate(sampled, nodes, size).join(F.broadcast(agreed), F.lit(True))


@register
def anomaly_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Isolation forests of both tables, trained and applied on all records."""
    data = views.pair(spark, folder)
    frames = {"vendor": data.vendors, "transaction": data.transactions}
    specs = anomaly.default_specs()[anomaly.ISOLATION_FOREST]
    models = {
        table: anomaly.train(
            frame, experiment.SCHEMAS[table], specs[table], data.fiscal_year, "development"
        )
        for table, frame in frames.items()
    }
    return anomaly.score_tables(frames, models)


@register
def anomaly_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Per table: all records scored once, percentiles and scores in range and in step, enough reviewed, evidence bounded."""
    found = cut(anomaly_scores(spark, folder))
    percentile = F.col("rank_percentile")
    right = (
        percentile.between(0, 1)
        & (F.abs(F.col("anomaly_score") - 100 * percentile) < 1e-9)
        & (F.col("priority_score") == F.col("anomaly_score"))
        & (F.length("evidence") <= 1000)
    )
    specs = anomaly.default_specs()[anomaly.ISOLATION_FOREST]
    fraction = F.when(F.col("target_table") == "vendor", specs["vendor"].review_fraction).otherwise(
        specs["transaction"].review_fraction
    )
    size = F.count(F.lit(1))
    # the threshold is the score at place ceil((n - 1) * (1 - fraction)); it and all above are reviewed
    least = size - F.ceil((size - 1) * (1 - F.first(fraction)))
    return found.groupBy("target_table", "model_name").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("record_id").alias("ids"),
        F.count_if(right).alias("right"),
        (F.count_if("predicted") >= least).alias("reviewed_enough"),
        (F.max("rank_percentile") == 1).alias("reaches_one"),
    )


@register
def model_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Vendors scored by a model and by the same model saved and loaded."""
    vendors = views.vendors(spark, folder)
    spec = anomaly.default_specs()[anomaly.ISOLATION_FOREST]["vendor"]
    model = anomaly.train(vendors, experiment.SCHEMAS["vendor"], spec, views.FISCAL_YEAR, "development")
    path = scratch(spark)
    anomaly.save_model(model, f"{path}/model")
    loaded = anomaly.load_model(spark, f"{path}/model")
    direct = cut(anomaly.score(vendors, model))
    again = cut(anomaly.score(vendors, loaded))
    names = ["record_id", "rank_percentile", "predicted", "evidence"]
    same = direct.select(*names).intersect(again.select(*names)).groupBy("record_id").count()
    return direct.join(same, "record_id", "left").agg(
        F.count(F.lit(1)).alias("records"), F.count("count").alias("same")
    )


@register
def experiment_gates(spark: SparkSession, folder: str) -> DataFrame:
    """The comparison per period and approach: measures in range, and no critical finding lost by the queue."""
    found = cut(experiment_comparison(spark, folder))
    measures = [n for n in ("precision", "recall", "macro_f1", "high_critical_recall") if n in found.columns]
    in_range = [F.coalesce(F.col(n).between(0, 1), F.lit(False)) for n in measures]
    guarded = F.col("approach") == "guarded_review_queue"
    return found.select(
        "period",
        "approach",
        F.forall(F.array(*in_range), lambda ok: ok).alias("in_range"),
        F.when(guarded, F.col("high_critical_recall") == 1.0).alias("critical_kept"),
    )


@register
def experiment_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Both model families on the earlier half, evaluated on both halves of the orders."""
    # read a dozen times: the columns are made once, and all tasks take part from here on
    early, late, vendors = side_by_side(
        [
            partial(cut, spread(frame, "_record_id"))
            for frame in (*_two_periods(spark, folder), views.vendors(spark, folder))
        ]
    )
    prepared, *periods = side_by_side(
        [
            partial(
                experiment.prepare_tables, {"vendor": vendors, "transaction": early}, 1997, "development"
            ),
            *[
                partial(experiment.make_period, vendors, frame, year, role, per_type=PER_TYPE)
                for frame, year, role in (
                    (early, 1997, "development"),
                    (late, 1998, "temporal_holdout"),
                )
            ],
        ]
    )
    return experiment.run_experiment(*periods, prepared=prepared).comparison


# --- review queues -----------------------------------------------------------------------


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    """Model scores of all orders: the price as percentile."""
    # cut off, not rounded: engines disagree on decimal halves
    steps = F.floor(F.col("federal_action_obligation") / 50)
    percentile = F.least(F.lit(1.0), steps / 10000)
    return views.transactions(spark, folder).select(
        F.lit("transaction").alias("target_table"),
        F.col("_record_id").alias("record_id"),
        F.lit("price").alias("model_name"),
        (percentile * 100).alias("anomaly_score"),
        percentile.alias("rank_percentile"),
        (percentile >= 0.9).alias("predicted"),
        (percentile * 100).alias("priority_score"),
        F.concat(F.lit("vendor "), "vendor_id").alias("evidence"),
    )


@register
def record_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return review.record_ranking(findings_ranked(spark, folder))


@register
def guarded_queue(spark: SparkSession, folder: str) -> DataFrame:
    findings = cut(findings_ranked(spark, folder))
    return rounded(review.guarded_queue(_scores(spark, folder), findings))


@register
def suppressed_critical(spark: SparkSession, folder: str) -> DataFrame:
    """The invariant's check, against a queue that lost its vendor records."""
    findings = cut(findings_ranked(spark, folder))
    queue = review.record_ranking(findings).where("target_table = 'transaction'")
    return review.suppressed_critical(queue, findings)


@register
def severity_filter(spark: SparkSession, folder: str) -> DataFrame:
    return review.by_severity(findings_ranked(spark, folder), ["critical", "medium"])


def _identified(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of a run with ids, a confidence and a priority."""
    found = review.with_finding_ids(findings_ranked(spark, folder), "run-1")
    digits = F.conv(F.substring(F.col("finding_id"), 1, 4), 16, 10).cast("double")
    confidence = F.when(F.col("severity") != "medium", F.round(digits / 65536, 4))
    priority = F.col("risk_score") * 1000 + F.coalesce(confidence, F.lit(0.0))
    return found.withColumn("model_confidence", confidence).withColumn("review_priority", priority)


@register
def mixed_queue(spark: SparkSession, folder: str) -> DataFrame:
    """All findings with their position in the fixed shuffle."""
    found = ordering.number_rows(_identified(spark, folder), review.mixed_order())
    return rounded(found.select("position", "finding_id", "record_id", "issue_type", "risk_score"))


@register
def confidence_queue(spark: SparkSession, folder: str) -> DataFrame:
    """All findings with their position by confidence."""
    found = ordering.number_rows(_identified(spark, folder), review.confidence_order())
    return rounded(found.select("position", "finding_id", "record_id", "issue_type", "model_confidence"))


@register
def review_table(spark: SparkSession, folder: str) -> DataFrame:
    data = views.pair(spark, folder)
    keys = data.vendors.select(
        F.col("_record_id").alias("record_id"), F.col("vendor_id").alias("source_key")
    ).unionByName(
        data.transactions.select(
            F.col("_record_id").alias("record_id"),
            F.col("contract_transaction_unique_key").alias("source_key"),
        )
    )
    return rounded(
        review.review_table(
            _identified(spark, folder), K, keys, [F.desc("model_confidence"), F.asc("finding_id")]
        )
    )


@register
def top_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(review.top_evidence(_scores(spark, folder), K))


# --- feedback ----------------------------------------------------------------------------


def _feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Events as verdicts: one finding per user and day."""
    events = views.table(spark, folder, "events")
    day = F.dayofmonth("ts")
    verdict = (
        F.when(F.col("event_type") == "view", "correct_flag")
        .when(F.col("event_type") == "click", "false_alarm")
        .when(F.col("event_type") == "signup", "wrong_issue_type")
        .when(F.col("event_type") == "purchase", "missed_issue")
        .otherwise("unsure")
    )
    return events.select(
        F.concat_ws(":", F.lit("F"), "user_id", day).alias("finding_id"),
        F.col("event_id").alias("feedback_id"),
        verdict.alias("verdict"),
        F.col("ts").cast("timestamp").alias("feedback_created_at"),
        F.when(day < 12, "vendor").otherwise("transaction").alias("target_table"),
        F.when(day < 6, "missing_vendor_name")
        .when(day < 12, "invalid_vendor_uei")
        .when(day < 20, "negative_offer_count")
        .otherwise("orphan_vendor_reference")
        .alias("issue_type"),
        F.when(day < 6, "high").when(day < 12, "critical").when(day < 20, "medium")
        .otherwise("critical").alias("severity"),
        F.when(day < 6, 75.0).when(day < 20, 50.0).otherwise(100.0).alias("risk_score"),
    )


@register
def feedback_latest(spark: SparkSession, folder: str) -> DataFrame:
    found = rerank.decisive(_feedback(spark, folder))
    return found.select("finding_id", "feedback_id", "verdict", "label", "risk_score")


@register
def feedback_sufficiency(spark: SparkSession, folder: str) -> DataFrame:
    return rerank.sufficiency(rerank.decisive(_feedback(spark, folder)))


@register
def feedback_split(spark: SparkSession, folder: str) -> DataFrame:
    found = rerank.split(rerank.decisive(_feedback(spark, folder)), 0.3, 42)
    return found.select("finding_id", "label", "is_validation")


def _ranked_feedback(spark: SparkSession, folder: str) -> DataFrame:
    examples = rerank.decisive(_feedback(spark, folder))
    digits = F.conv(F.substring(F.md5("finding_id"), 1, 4), 16, 10).cast("double")
    return rerank.priorities(examples.withColumn("model_confidence", digits / 65536))


@register
def rerank_metrics(spark: SparkSession, folder: str) -> DataFrame:
    examples = _ranked_feedback(spark, folder)
    active = rerank.ranking_metrics(examples, "active_priority", K)
    candidate = rerank.ranking_metrics(examples, "candidate_priority", K)
    return rounded(
        active.withColumn("ranking", F.lit("active")).unionByName(
            candidate.withColumn("ranking", F.lit("candidate"))
        )
    )


@register
def rerank_gates(spark: SparkSession, folder: str) -> DataFrame:
    examples = _ranked_feedback(spark, folder)
    return rerank.reranker_gates(
        rerank.ranking_metrics(examples, "active_priority", K),
        rerank.ranking_metrics(examples, "candidate_priority", K),
        rerank.sufficiency(examples),
    )


@register
def rerank_model(spark: SparkSession, folder: str) -> DataFrame:
    """Learn from all verdicts and rank all findings of the rules with the model."""
    training = rerank.train_reranker(_feedback(spark, folder))
    findings = findings_ranked(spark, folder)
    return rerank.rerank(findings, training.model if training.promoted else None)


@register
def rerank_certificate(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the fitted reranker is the optimum of its loss over all decisive verdicts."""
    examples = rerank.decisive(_feedback(spark, folder))
    found = rerank.optimality(examples, rerank.fit_reranker(examples))
    return found.select("examples", "positives", "designs", (F.col("gradient_norm") < 1e-4).alias("optimal"))


@register
def rerank_inactive(spark: SparkSession, folder: str) -> DataFrame:
    return rerank.rerank(findings_ranked(spark, folder))


@register
def feedback_store(spark: SparkSession, folder: str) -> DataFrame:
    """Append a batch of verdicts on a saved run and join them with their findings."""
    path, run = scratch(spark), "run-1"
    _save(spark, folder, path, run)
    findings = sinks.read_findings(spark, path)
    verdict = F.when(F.col("severity") == "critical", "correct_flag").otherwise("false_alarm")
    batch_ = findings.select(
        "finding_id",
        verdict.alias("verdict"),
        F.lit(None).cast("string").alias("corrected_issue_type"),
        F.lit(None).cast("string").alias("notes"),
    )
    if not sinks.append_feedback(batch_, findings, f"{path}/feedback", run):
        raise RuntimeError("A finding of the batch is unknown")
    examples = sinks.feedback_examples(findings, spark.read.parquet(f"{path}/feedback"))
    return examples.drop("feedback_created_at", "feedback_id")


# --- sources, sinks and streams ----------------------------------------------------------


def _save(spark: SparkSession, folder: str, path: str, run: str) -> None:
    """Runs are stored in no order: their readers sort."""
    data = views.pair(spark, folder)
    sinks.save_run(
        R.run_rules(data.vendors, data.transactions, R.procurement_rules(data.fiscal_year), WEIGHTS, ordered=False),
        path,
        run_id=run,
        fiscal_year=data.fiscal_year,
        vendor_records=data.vendors.count(),
        transaction_records=data.transactions.count(),
        schema_version="1.0.0",
        model_version="deterministic-baseline-v1",
    )


@register
def run_findings(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark)
    _save(spark, folder, path, "run-1")
    return sinks.list_findings(spark, path, "run-1")


@register
def run_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Runs whose ids look like numbers or words live in one store and are told apart."""
    path, runs = scratch(spark), ("007", "run-1")
    for run in runs:
        _save(spark, folder, path, run)
    found = [sinks.list_findings(spark, path, run).groupBy("run_id").count() for run in runs]
    both = found[0].unionByName(found[1])
    records = [sinks.get_run(spark, path, run).select("run_id", "finding_count") for run in runs]
    return both.join(records[0].unionByName(records[1]), "run_id")


@register
def json_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark)
    nations = views.table(spark, folder, "nation").select("n_nationkey", "n_name")
    sinks.write_json(nations, f"{path}/nations")
    return spark.read.schema(nations.schema).json(f"{path}/nations")


@register
def snapshot_check(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of files with known content, one per nation."""
    path = scratch(spark)
    nations = views.table(spark, folder, "nation").select("n_nationkey", "n_name")
    nations.coalesce(1).write.partitionBy("n_nationkey").text(f"{path}/nations")
    found = snapshots.file_digests(spark, f"{path}/nations", "*.txt")
    key = F.regexp_extract("file", "^n_nationkey=([0-9]+)/", 1).cast("long")
    return found.select(key.alias("n_nationkey"), "bytes", "sha256")


@register
def integers_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Whole numbers beyond the 53 bits of a double, read from text."""
    orders = views.table(spark, folder, "orders")
    large = F.lit(9007199254740993) + F.col("o_orderkey")
    text = orders.select("o_orderkey", F.concat(F.lit(" "), large.cast("string")).alias("n"))
    return text.select("o_orderkey", contract.coerced("n", "integer", T.StringType()).alias("n"))


@register
def profile_floats(spark: SparkSession, folder: str) -> DataFrame:
    """NaN counts as missing, and both zeros are one value."""
    tax, discount = F.col("l_tax").cast("double"), F.col("l_discount").cast("double")
    value = F.when(tax == 0, F.lit(float("nan"))).when((discount == 0) & (tax > 0.04), F.lit(-0.0))
    lines = views.table(spark, folder, "lineitem").select(value.otherwise(discount).alias("discount"))
    return profile.profile_table(lines)


@register
def run_record(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark)
    _save(spark, folder, path, "run-1")
    found = sinks.get_run(spark, path, "run-1")
    return found.select(
        "run_id", "fiscal_year", "vendor_records", "transaction_records", "finding_count"
    )


@register
def findings_export(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark)
    _save(spark, folder, path, "run-1")
    sinks.export_findings(spark, path, "run-1", f"{path}/export")
    return extracts.read_strings(spark, f"{path}/export")


@register
def raw_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Raw CSV parts written from the orders, one column with quotes and line breaks, read back as strings."""
    path = scratch(spark)
    orders = views.table(spark, folder, "orders")
    note = F.concat(F.lit('said "'), "o_orderpriority", F.lit('",\n"'), F.col("o_custkey").cast("string"), F.lit("\n"))
    keyed = orders.select(
        F.format_string(" T%d ", "o_orderkey").alias("contract_transaction_unique_key"),
        F.when(F.col("o_orderkey") % 3 == 0, note).otherwise(F.col("o_orderpriority")).alias("note"),
    )
    raw = _raw_orders(spark, folder).join(keyed, "contract_transaction_unique_key")
    target = f"{path}/fy{views.FISCAL_YEAR}"
    raw.repartition(3).write.option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(target)
    return extracts.read_raw_transactions(spark, path, views.FISCAL_YEAR, "part-*.csv")


@register
def period_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Two periods written as partitions; the later one read back."""
    path = scratch(spark)
    vendors = views.vendors(spark, folder)
    for frame, year in zip(_two_periods(spark, folder), (1997, 1998)):
        sinks.write_period(vendors, frame, path, year)
    found = extracts.read_period(spark, path, 1998)[1]
    return timed(found.select("_record_id", "vendor_id", "action_date", "fiscal_year"))


@register
def upload_scan(spark: SparkSession, folder: str) -> DataFrame:
    """An uploaded pair as CSV; keys with leading zeros stay strings."""
    path = scratch(spark)
    customer = views.table(spark, folder, "customer")
    vendors = customer.select(
        F.format_string("%09d", "c_custkey").alias("vendor_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("N/A"))
        .otherwise(F.col("c_mktsegment"))
        .alias("recipient_name"),
    )
    orders = views.table(spark, folder, "orders").select(
        F.format_string("%09d", "o_custkey").alias("vendor_id"),
        F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.col("o_orderpriority")).alias("clerk"),
    )
    vendors.write.option("header", True).csv(f"{path}/vendors")
    orders.write.option("header", True).csv(f"{path}/transactions")
    parent, child = extracts.read_upload(spark, f"{path}/vendors", f"{path}/transactions")
    return parent.select(F.lit("vendor").alias("target_table"), "vendor_id", F.col("recipient_name").alias("value")).unionByName(
        child.select(F.lit("transaction").alias("target_table"), "vendor_id", F.col("clerk").alias("value"))
    )


@register
def file_integrity(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.file_digests(spark, folder, "*.parquet")


EVENT_WEIGHTS = {"type_unknown": 40, "value_low": 60, "time_outside": 75}


def _event_rules() -> list[R.Rule]:
    low = datetime(2024, 1, 5, tzinfo=timezone.utc)
    high = datetime(2024, 1, 25, tzinfo=timezone.utc)
    return [
        R.not_matching(Issue("type_unknown", "event", "low"), "event_type", "view|click", "is odd"),
        R.negative(Issue("value_low", "event", "medium"), "value_over_ten"),
        R.outside_window(Issue("time_outside", "event", "high"), "at", low, high, "the window"),
    ]


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = views.table(spark, folder, "events").schema
    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    )
    return stream.select(
        F.col("event_id").cast("string").alias("_record_id"),
        "event_type",
        (F.floor("value") - 10).alias("value_over_ten"),
        F.col("ts").cast("timestamp").alias("at"),
    )


@register
def stream_findings(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark)
    found = streaming.score_stream(
        _event_stream(spark, folder), _event_rules(), EVENT_WEIGHTS, "event"
    )
    streaming.write_findings(found, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/out")


EVENT = contract.TableContract(
    "_record_id",
    (
        contract.ColumnRule("_record_id", "string", nullable=False),
        contract.ColumnRule("event_type", "string"),
        contract.ColumnRule("value_over_ten", "integer", nullable=False),
        contract.ColumnRule("at", "datetime", nullable=False),
        contract.ColumnRule("user", "string", nullable=False),
    ),
)


def _raw_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events as they might arrive: numbers as text, some no numbers, some without a user."""
    schema = views.table(spark, folder, "events").schema
    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    )
    number = (F.floor("value") - 10).cast("string")
    return stream.select(
        F.col("event_id").cast("string").alias("_record_id"),
        "event_type",
        F.when(F.col("event_id") % 7 == 3, F.lit("n/a")).otherwise(number).alias("value_over_ten"),
        F.col("ts").cast("timestamp").alias("at"),
        F.when(F.col("user_id") % 5 != 0, F.col("user_id").cast("string")).otherwise(F.lit(" ")).alias("user"),
    )


def _stream_runs(spark: SparkSession, folder: str) -> str:
    path = scratch(spark)
    streaming.write_runs(
        _raw_events(spark, folder),
        _event_rules(),
        EVENT_WEIGHTS,
        "event",
        path,
        f"{path}/checkpoint",
        fiscal_year=2024,
        contract=EVENT,
    ).awaitTermination()
    return path


@register
def stream_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of the accepted events, of complete runs."""
    found = sinks.read_findings(spark, _stream_runs(spark, folder))
    return found.select("record_id", "issue_type", "risk_score", "review_priority")


@register
def stream_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """The refused events with their problems, and how many were accepted and read."""
    path = _stream_runs(spark, folder)
    refused = spark.read.parquet(f"{path}/refused")
    accepted = sinks.committed_runs(spark, path).agg(F.sum("transaction_records").alias("accepted"))
    counted = refused.agg(F.count(F.lit(1)).alias("refused"))
    # one row each
    totals = accepted.join(F.broadcast(counted), F.lit(True)).select(
        "accepted", (F.col("accepted") + F.col("refused")).alias("read")
    )
    return refused.join(F.broadcast(totals), F.lit(True)).select(
        F.col("_record_id").alias("record_id"), F.array_join("problems", ",").alias("problems"), "accepted", "read"
    )


@register
def torn_run(spark: SparkSession, folder: str) -> DataFrame:
    """A run whose commit record is missing is invisible; the other ones are whole."""
    path = scratch(spark)
    for run in ("a", "b"):
        _save(spark, folder, path, run)
    # what a writer leaves that was lost before its last step: findings of a third run, and a second attempt of a
    lost = spark.read.parquet(f"{path}/findings").where("run_id = 'b'").drop("run_id", "attempt").limit(7)
    lost = cut(lost)
    for place in ("run_id=c/attempt=x", "run_id=a/attempt=y"):
        lost.write.parquet(f"{path}/findings/{place}")
    found = sinks.read_findings(spark, path).groupBy("run_id").count()
    missing = sinks.list_findings(spark, path, "c").agg(F.count(F.lit(1)).alias("of_torn_run"))
    return found.join(F.broadcast(missing), F.lit(True)).select("run_id", "count", "of_torn_run")


@register
def snapshot_report(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest with one changed hash, one other size, one missing and one unlisted file, and whether it is valid."""
    path = scratch(spark)
    nations = views.table(spark, folder, "nation").select("n_nationkey", "n_name")
    nations.write.partitionBy("n_nationkey").text(f"{path}/nations")
    digests = snapshots.file_digests(spark, f"{path}/nations", "*.txt")
    key = F.regexp_extract("file", "^n_nationkey=([0-9]+)/", 1).cast("long")
    entries = cut(digests.withColumn("key", key))
    changed = entries.where("key != 4").select(
        F.when(F.col("key") == 3, F.lit("n_nationkey=3/gone.txt")).otherwise(F.col("file")).alias("file"),
        (F.col("bytes") + F.when(F.col("key") == 2, 1).otherwise(0)).alias("bytes"),
        F.when(F.col("key") == 1, F.sha2(F.col("sha256"), 256)).otherwise(F.col("sha256")).alias("sha256"),
    )
    sinks.write_table(changed, f"{path}/manifest")
    manifest = spark.read.parquet(f"{path}/manifest")
    found = snapshots.snapshot_report(manifest, f"{path}/nations")
    whole = snapshots.snapshot_is_valid(spark, entries.select("file", "bytes", "sha256"), f"{path}/nations")
    broken = snapshots.snapshot_is_valid(spark, manifest, f"{path}/nations")
    return found.groupBy(F.regexp_extract("file", "^n_nationkey=([0-9]+)/", 1).cast("long").alias("n_nationkey"), "problem").agg(
        F.count(F.lit(1)).alias("files"), F.lit(whole).alias("whole_valid"), F.lit(broken).alias("broken_valid")
    )
