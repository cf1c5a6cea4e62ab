"""The star schema in the roles of the procurement pair, as DataFrames and as SQL.

Customers play vendors and orders play transactions. The data has no natural defects, so
the mapping derives some from it: key collisions for negative balances, a null name for
one market segment, short identifiers, unknown states, repeated order months.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FISCAL_YEAR = 1998
# a state for every nation position; ZZ and XX are not codes
STATES = ("CA", "ZZ", "NY", "TX", "XX", "WA", "VA", "MD")


@dataclass(frozen=True)
class Pair:
    vendors: DataFrame
    transactions: DataFrame
    fiscal_year: int = FISCAL_YEAR


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vendors(spark: SparkSession, folder: str) -> DataFrame:
    """``_record_id`` comes from the surrogate key, which is the position: no shuffle."""
    customer = table(spark, folder, "customer")
    collides = F.col("c_acctbal") < 0
    state = F.element_at(
        F.array(*[F.lit(code) for code in STATES]), F.col("c_nationkey") % len(STATES) + 1
    )
    return customer.select(
        F.format_string("vendor:%08d", "c_custkey").alias("_record_id"),
        F.concat(F.lit("C:"), F.col("c_custkey") - collides.cast("long")).alias("vendor_id"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("recipient_name"),
        F.when(collides, F.col("c_name"))
        .otherwise(F.upper(F.substring(F.md5("c_name"), 1, 12)))
        .alias("recipient_uei"),
        F.when(F.col("c_nationkey") < 15, F.lit("USA"))
        .when(F.col("c_nationkey") < 22, F.lit("CAN"))
        .alias("recipient_country_code"),
        F.when(F.col("c_nationkey") != 7, state).alias("recipient_state_code"),
        F.floor(F.abs("c_acctbal")).alias("source_transaction_count"),
        F.col("c_nationkey").cast("long").alias("address_variant_count"),
        F.substring("c_mktsegment", 1, 1).alias(
            "contracting_officers_determination_of_business_size_code"
        ),
    )


VENDORS_SQL = """
SELECT printf('vendor:%08d', c_custkey) AS _record_id,
       'C:' || CAST(c_custkey - CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS VARCHAR) AS vendor_id,
       nullif(c_mktsegment, 'BUILDING') AS recipient_name,
       CASE WHEN c_acctbal < 0 THEN c_name
            ELSE upper(substr(md5(c_name), 1, 12)) END AS recipient_uei,
       CASE WHEN c_nationkey < 15 THEN 'USA' WHEN c_nationkey < 22 THEN 'CAN' END
           AS recipient_country_code,
       CASE WHEN c_nationkey <> 7
            THEN (['CA','ZZ','NY','TX','XX','WA','VA','MD'])[c_nationkey % 8 + 1] END
           AS recipient_state_code,
       CAST(floor(abs(c_acctbal)) AS BIGINT) AS source_transaction_count,
       CAST(c_nationkey AS BIGINT) AS address_variant_count,
       substr(c_mktsegment, 1, 1) AS contracting_officers_determination_of_business_size_code
FROM customer
"""


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    placed = F.col("o_orderdate").cast("timestamp")
    urgency = F.substring("o_orderpriority", 1, 1)
    price = F.col("o_totalprice")
    return orders.select(
        F.format_string("transaction:%08d", "o_orderkey").alias("_record_id"),
        F.concat(
            F.lit("T:"), "o_custkey", F.lit(":"), F.date_format("o_orderdate", "yyyyMM")
        ).alias("contract_transaction_unique_key"),
        F.concat(F.lit("C:"), "o_custkey").alias("vendor_id"),
        price.alias("federal_action_obligation"),
        F.when(F.col("o_orderstatus") != "P", price - 250000).alias("total_dollars_obligated"),
        F.when(urgency != "3", F.floor(price / 100000) - 1).alias("number_of_offers_received"),
        placed.alias("action_date"),
        placed.alias("period_of_performance_start_date"),
        F.when(
            urgency != "4",
            F.timestamp_add("DAY", urgency.cast("int") - 2, placed),
        ).alias("period_of_performance_current_end_date"),
        F.col("o_orderstatus").alias("award_type_code"),
        urgency.alias("type_of_contract_pricing_code"),
        F.date_format("o_orderdate", "MM").alias("action_type_code"),
        F.date_format("o_orderdate", "yyyyMM").alias("product_or_service_code"),
        F.floor(price / 10000).cast("string").alias("naics_code"),
        F.date_format("o_orderdate", "yyyy").alias("extent_competed_code"),
        F.nullif("o_orderstatus", F.lit("F")).alias("solicitation_procedures_code"),
        F.when(price >= 100000, F.date_format("o_orderdate", "dd")).alias("type_of_set_aside_code"),
    )


TRANSACTIONS_SQL = """
SELECT printf('transaction:%08d', o_orderkey) AS _record_id,
       'T:' || CAST(o_custkey AS VARCHAR) || ':' || strftime(o_orderdate, '%Y%m')
           AS contract_transaction_unique_key,
       'C:' || CAST(o_custkey AS VARCHAR) AS vendor_id,
       o_totalprice AS federal_action_obligation,
       CASE WHEN o_orderstatus <> 'P' THEN o_totalprice - 250000 END AS total_dollars_obligated,
       CASE WHEN o_orderpriority[1] <> '3' THEN CAST(floor(o_totalprice / 100000) AS BIGINT) - 1 END
           AS number_of_offers_received,
       o_orderdate AS action_date,
       o_orderdate AS period_of_performance_start_date,
       CASE WHEN o_orderpriority[1] <> '4'
            THEN o_orderdate + to_days(CAST(o_orderpriority[1] AS INTEGER) - 2) END
           AS period_of_performance_current_end_date,
       o_orderstatus AS award_type_code,
       o_orderpriority[1] AS type_of_contract_pricing_code,
       strftime(o_orderdate, '%m') AS action_type_code,
       strftime(o_orderdate, '%Y%m') AS product_or_service_code,
       CAST(CAST(floor(o_totalprice / 10000) AS BIGINT) AS VARCHAR) AS naics_code,
       strftime(o_orderdate, '%Y') AS extent_competed_code,
       nullif(o_orderstatus, 'F') AS solicitation_procedures_code,
       CASE WHEN o_totalprice >= 100000 THEN strftime(o_orderdate, '%d') END
           AS type_of_set_aside_code
FROM orders
"""


def pair(spark: SparkSession, folder: str) -> Pair:
    return Pair(vendors(spark, folder), transactions(spark, folder))


PAIR_SQL = f"vendors AS ({VENDORS_SQL}), transactions AS ({TRANSACTIONS_SQL})"
