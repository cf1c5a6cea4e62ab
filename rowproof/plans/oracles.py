"""The same results in SQL that DuckDB runs on the same files, one text per query."""

from __future__ import annotations

from rowproof.operators.anomaly import INTERPRETATION
from rowproof.operators.features import QUARTILES, TRANSACTION_FEATURES, VENDOR_FEATURES, FeatureSchema
from rowproof.operators.normalize import DATE_COLUMNS
from rowproof.plans.catalogue import ISSUES, STATE_CODES, WEIGHTS
from rowproof.plans.queries import FOREST, K, MIDDLE, PER_TYPE, RULE_QUERIES, SEED
from rowproof.plans.views import FISCAL_YEAR, TRANSACTIONS_SQL, VENDORS_SQL

VIEWS = f"vendors AS ({VENDORS_SQL}), transactions AS ({TRANSACTIONS_SQL})"
KEY = "contract_transaction_unique_key"
START, END = "period_of_performance_start_date", "period_of_performance_current_end_date"
_STATES = ", ".join(f"'{code}'" for code in STATE_CODES)

# issue -> (condition, evidence); {v} and {t} are the tables
_RULES = {
    "missing_vendor_name": (
        "recipient_name IS NULL OR trim(recipient_name) = ''",
        "'recipient_name is missing'",
    ),
    "invalid_vendor_uei": (
        "recipient_uei IS NOT NULL AND NOT regexp_full_match(recipient_uei, '[A-Z0-9]{{12}}')",
        "'recipient_uei=' || recipient_uei || ' is not 12 alphanumeric characters'",
    ),
    "invalid_domestic_state": (
        "recipient_country_code = 'USA' AND "
        f"(recipient_state_code IS NULL OR recipient_state_code NOT IN ({_STATES}))",
        "'recipient_state_code=' || coalesce(recipient_state_code, '<NA>') || ' is invalid for USA'",
    ),
    "duplicate_vendor_id": (
        "vendor_id IN (SELECT vendor_id FROM {v} GROUP BY vendor_id HAVING count(*) > 1)",
        "'vendor_id=' || vendor_id || ' appears more than once'",
    ),
    "orphan_vendor_reference": (
        "vendor_id IS NULL OR vendor_id NOT IN (SELECT vendor_id FROM {v} WHERE vendor_id IS NOT NULL)",
        "'vendor_id=' || coalesce(vendor_id, '<NA>') || ' does not identify a vendor record'",
    ),
    "duplicate_transaction_key": (
        f"{KEY} IN (SELECT {KEY} FROM {{t}} GROUP BY {KEY} HAVING count(*) > 1)",
        f"'{KEY}=' || {KEY} || ' appears more than once'",
    ),
    "invalid_performance_date_order": (f"{END} < {START}", f"'{END} is before {START}'"),
    "negative_offer_count": (
        "number_of_offers_received < 0",
        "'number_of_offers_received=' || CAST(number_of_offers_received AS VARCHAR) || ' is negative'",
    ),
    "action_date_outside_fiscal_year": (
        f"action_date IS NULL OR action_date < TIMESTAMP '{FISCAL_YEAR - 1}-10-01' "
        f"OR action_date > TIMESTAMP '{FISCAL_YEAR}-09-30'",
        "'action_date=' || coalesce(strftime(action_date, '%Y-%m-%d %H:%M:%S') || '+00:00', '<NA>')"
        f" || ' is outside FY{FISCAL_YEAR}'",
    ),
}


def findings(names=tuple(ISSUES), v: str = "vendors", t: str = "transactions") -> str:
    """SELECT of the findings of the named rules."""
    parts = []
    for name in names:
        issue = ISSUES[name]
        condition, evidence = (text.format(v=v, t=t) for text in _RULES[name])
        source = v if issue.table == "vendor" else t
        parts.append(
            f"SELECT '{issue.table}' AS target_table, _record_id AS record_id, "
            f"'{name}' AS issue_type, '{issue.severity}' AS severity, "
            f"{issue.rank} AS severity_rank, {evidence} AS evidence, {WEIGHTS[name]} AS weight "
            f"FROM {source} WHERE {condition}"
        )
    hits = "\nUNION ALL ".join(parts)
    return (
        "SELECT target_table, record_id, issue_type, severity, severity_rank, evidence, "
        "CAST(least(100, weight + 5 * (count(*) OVER (PARTITION BY target_table, record_id) - 1)) "
        f"AS INTEGER) AS risk_score FROM ({hits})"
    )


FOUND = f"{VIEWS}, findings AS ({findings()})"
_TRANSACTION_ISSUES = [name for name, issue in ISSUES.items() if issue.table == "transaction"]
_VENDOR_ISSUES = [name for name, issue in ISSUES.items() if issue.table == "vendor"]
_STAMP = "'%Y-%m-%d %H:%M:%S'"

SQL: dict[str, str] = {}

# --- rules -------------------------------------------------------------------------------

for _query, _issue in RULE_QUERIES.items():
    SQL[_query] = f"WITH {VIEWS} {findings([_issue])}"
SQL["findings_ranked"] = f"WITH {VIEWS} {findings()}"
SQL["findings_single_table"] = "WITH {} {}".format(
    VIEWS, findings([n for n in _TRANSACTION_ISSUES if n != "orphan_vendor_reference"])
)
SQL["findings_lineitem"] = """
WITH lines AS (
  SELECT l_orderkey AS order_key,
         CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS line_key,
         l_returnflag AS flag, l_shipdate AS shipped FROM lineitem
), child AS (
  SELECT printf('line:%08d', row_number() OVER (ORDER BY line_key, flag, shipped) - 1) AS record_id, *
  FROM lines
), hits AS (
  SELECT record_id, 'order_missing' AS issue_type, 'critical' AS severity, 4 AS severity_rank,
         'order_key=' || CAST(order_key AS VARCHAR) || ' does not identify a order record' AS evidence,
         100 AS weight
  FROM child WHERE order_key NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
  UNION ALL
  SELECT record_id, 'line_repeated', 'critical', 4,
         'line_key=' || line_key || ' appears more than once', 90
  FROM child WHERE line_key IN (SELECT line_key FROM child GROUP BY line_key HAVING count(*) > 1)
  UNION ALL
  SELECT record_id, 'flag_unknown', 'low', 1, 'flag=' || flag || ' is not A or N', 40
  FROM child WHERE NOT regexp_full_match(flag, '[AN]')
  UNION ALL
  SELECT record_id, 'ship_late', 'medium', 2,
         'shipped=' || strftime(shipped, '%Y-%m-%d %H:%M:%S') || '+00:00 is outside the window', 60
  FROM child WHERE shipped < TIMESTAMP '1995-06-01' OR shipped > TIMESTAMP '2000-06-01'
)
SELECT 'line' AS target_table, record_id, issue_type, severity, severity_rank, evidence,
       CAST(least(100, weight + 5 * (count(*) OVER (PARTITION BY record_id) - 1)) AS INTEGER)
           AS risk_score
FROM hits
"""
SQL["run_summary"] = f"""
WITH {FOUND}
SELECT 'vendor_records' AS metric, count(*) AS value FROM vendors
UNION ALL SELECT 'transaction_records', count(*) FROM transactions
UNION ALL SELECT 'finding_count', count(*) FROM findings
UNION ALL SELECT 'findings_by_severity.' || severity, count(*) FROM findings GROUP BY severity
"""
SQL["finding_keys"] = (
    f"WITH {FOUND} SELECT DISTINCT target_table, record_id, issue_type FROM findings"
)
SQL["record_keys"] = f"WITH {FOUND} SELECT DISTINCT target_table, record_id FROM findings"
SQL["score_batch"] = f"""
WITH {VIEWS}, v AS (
  SELECT * REPLACE (printf('vendor:%08d',
           row_number() OVER (ORDER BY vendor_id, recipient_uei) - 1) AS _record_id)
  FROM vendors
), t AS (
  SELECT * REPLACE (printf('transaction:%08d',
           row_number() OVER (ORDER BY {KEY}, action_date, federal_action_obligation) - 1)
           AS _record_id,
           CASE WHEN vendor_id IN (SELECT vendor_id FROM vendors) THEN vendor_id
                ELSE (SELECT min(vendor_id) FROM vendors) END AS vendor_id)
  FROM transactions
)
{findings(v="v", t="t")}
"""
SQL["score_records"] = f"""
WITH {VIEWS}, v AS (
  SELECT * REPLACE (printf('vendor:%08d',
           row_number() OVER (ORDER BY vendor_id, recipient_uei) - 1) AS _record_id)
  FROM vendors
)
{findings(_VENDOR_ISSUES, v="v")}
"""

# --- normalisation and contract ----------------------------------------------------------

_EDGE = r"[\s\x{000B}\x{0085}\x{00A0}\x{001C}-\x{001F}\p{Z}]+"


def _clean(text: str) -> str:
    return f"nullif(regexp_replace({text}, '^{_EDGE}|{_EDGE}$', '', 'g'), '')"


SQL["clean_strings"] = f"""
SELECT doc_id, {_clean("text")} AS text, lang,
       CASE WHEN lang <> 'en' THEN {_clean("source")} END AS source
FROM documents
"""
SQL["stable_key"] = """
SELECT c_custkey,
       coalesce('UEI:' || CASE WHEN c_acctbal >= 0 AND c_nationkey <> 3 THEN c_name END,
                'DUNS:' || CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(c_custkey AS VARCHAR) END)
           AS vendor_id
FROM customer
"""
SQL["prepare_transactions"] = f"""
WITH raw AS (
  SELECT 'T' || CAST(o_orderkey AS VARCHAR) AS {KEY},
         CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) END AS recipient_uei,
         CASE WHEN o_orderpriority <> '5-LOW' THEN printf('%09d', o_custkey) END AS recipient_duns,
         CASE WHEN o_orderstatus IN ('F', 'O') THEN strftime(o_orderdate, {_STAMP}) END
             AS action_date,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS federal_action_obligation,
         o_orderpriority AS recipient_name
  FROM orders
)
SELECT *, coalesce('UEI:' || recipient_uei, 'DUNS:' || recipient_duns) AS vendor_id,
       {FISCAL_YEAR} AS fiscal_year
FROM raw
"""
SQL["coerce_types"] = f"""
SELECT event_id,
       CASE WHEN event_type <> 'error'
            THEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k,
       CASE WHEN event_type <> 'click' THEN strftime(ts, {_STAMP}) END AS at
FROM events
"""
SQL["record_ids"] = """
SELECT c_custkey,
       printf('vendor:%08d', row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1) AS _record_id
FROM customer
"""
SQL["latest_per_key"] = f"""
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey)
           AS place,
         count(*) OVER (PARTITION BY o_custkey) AS order_count FROM orders
), variants AS (
  SELECT o_custkey, count(DISTINCT o_orderstatus) AS status_variants,
         count(DISTINCT o_orderpriority) AS priority_variants FROM orders GROUP BY o_custkey
)
SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, {_STAMP}) AS o_orderdate, order_count, status_variants,
       priority_variants
FROM ranked JOIN variants USING (o_custkey) WHERE place = 1
"""


def _check(check: str, field: str, condition: str) -> str:
    return (
        f"SELECT '{check}' AS \"check\", '{field}' AS field, "
        f"count(*) FILTER (WHERE {condition}) AS violations FROM transactions"
    )


_OFFERS = (
    "CASE WHEN award_type_code = 'F' THEN '1.5' WHEN award_type_code = 'P' THEN 'many' "
    "ELSE CAST(number_of_offers_received AS VARCHAR) END"
)
SQL["contract_check"] = f"WITH {VIEWS} " + " UNION ALL ".join(
    [
        _check("missing", KEY, f"{KEY} IS NULL"),
        _check("missing", "vendor_id", "vendor_id IS NULL"),
        _check("invalid", "federal_action_obligation", "false"),
        _check("invalid", "total_dollars_obligated", "false"),
        _check(
            "fraction", "number_of_offers_received", f"TRY_CAST({_OFFERS} AS DOUBLE) % 1 <> 0"
        ),
        _check(
            "invalid",
            "number_of_offers_received",
            f"{_OFFERS} IS NOT NULL AND TRY_CAST({_OFFERS} AS DOUBLE) IS NULL",
        ),
        _check("invalid", "action_date", "award_type_code = 'P'"),
        _check("missing", "action_date", "award_type_code = 'P'"),
        _check("invalid", START, "false"),
        _check("invalid", END, "false"),
        _check("blank_key", KEY, f"trim({KEY}) = ''"),
    ]
)
_TIMES = ", ".join(
    f"strftime({name}, {_STAMP}) AS {name}" for name in DATE_COLUMNS if name in TRANSACTIONS_SQL
)
_DATED = f"* REPLACE ({_TIMES})"
SQL["contract_coerce"] = (
    f"WITH {VIEWS} SELECT * EXCLUDE (_record_id) REPLACE ({_TIMES}) FROM transactions"
)
SQL["fk_check"] = f"""
WITH {VIEWS} SELECT DISTINCT vendor_id AS key FROM transactions
WHERE vendor_id NOT IN (SELECT vendor_id FROM vendors)
"""
SQL["record_constraints"] = f"""
WITH {VIEWS}
SELECT 'source_transaction_count' AS problem, count(*) AS records FROM vendors
WHERE recipient_name IS NULL HAVING count(*) > 0
UNION ALL SELECT 'vendor_id', count(*) FROM vendors
WHERE recipient_state_code IS NULL HAVING count(*) > 0
"""
SQL["feature_projection"] = f"""
WITH {VIEWS} SELECT _record_id, vendor_id, {", ".join(VENDOR_FEATURES.sources)} FROM vendors
"""
SQL["preparation_counts"] = f"""
WITH {VIEWS}
SELECT count(*) AS transaction_rows, (SELECT count(*) FROM vendors) AS vendor_rows,
       count(*) FILTER (WHERE n > 1) AS duplicate_transaction_keys,
       count(*) FILTER (WHERE vendor_id IS NULL) AS missing_vendor_keys,
       count(*) FILTER (WHERE vendor_id NOT IN (SELECT vendor_id FROM vendors))
           AS unmatched_vendor_keys
FROM (SELECT *, count(*) OVER (PARTITION BY {KEY}) AS n FROM transactions)
"""

# --- profiling ---------------------------------------------------------------------------


def profile(source: str, kinds: dict[str, str]) -> str:
    """``kinds``: column -> semantic type, or '' for text that may be categorical."""
    parts = []
    for name, kind in kinds.items():
        semantic = (
            f"'{kind}'"
            if kind
            else f"CASE WHEN count(DISTINCT {name}) / greatest(count(*), 1) < 0.05 "
            "THEN 'categorical' ELSE 'text' END"
        )
        parts.append(
            f"SELECT '{name}' AS field, {semantic} AS semantic_type, "
            f"count(*) - count({name}) AS missing_count, "
            f"round((count(*) - count({name})) / count(*) * 100, 3) AS missing_percent, "
            f"count(DISTINCT {name}) AS unique_count FROM {source}"
        )
    return " UNION ALL ".join(parts)


_TRANSACTION_KINDS = {
    "_record_id": "identifier",
    KEY: "identifier",
    "vendor_id": "identifier",
    "federal_action_obligation": "numeric",
    "total_dollars_obligated": "numeric",
    "number_of_offers_received": "numeric",
    "action_date": "date",
    START: "date",
    END: "date",
    "award_type_code": "identifier",
    "type_of_contract_pricing_code": "identifier",
    "action_type_code": "identifier",
    "product_or_service_code": "identifier",
    "naics_code": "identifier",
    "extent_competed_code": "identifier",
    "solicitation_procedures_code": "identifier",
    "type_of_set_aside_code": "identifier",
}
SQL["profile_transactions"] = f"WITH {VIEWS} " + profile("transactions", _TRANSACTION_KINDS)
SQL["profile_documents"] = profile(
    "documents",
    {"doc_id": "identifier", "text": "", "lang": "", "source": "", "n_chars": "numeric"},
)


def _duplicates(source: str, columns: str, key: str) -> str:
    return f"""
SELECT count(*) AS rows,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT {columns} FROM {source}))
           AS exact_duplicate_rows,
       count(*) FILTER (WHERE {key} IS NOT NULL AND n > 1) AS duplicate_key_rows,
       count(DISTINCT CASE WHEN n > 1 THEN {key} END) AS duplicate_key_values,
       count(*) FILTER (WHERE {key} IS NULL) AS missing_key_rows
FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM {source})
"""


SQL["duplicate_summary"] = _duplicates("lineitem", "*", "l_orderkey")
SQL["duplicate_documents"] = _duplicates("documents", "lang, text", "text")
SQL["join_quality"] = f"""
WITH {VIEWS}
SELECT count(*) AS transaction_rows, (SELECT count(*) FROM vendors) AS vendor_rows,
       count(*) FILTER (WHERE vendor_id IS NULL) AS missing_vendor_key_rows,
       count(*) FILTER (WHERE vendor_id NOT IN (SELECT vendor_id FROM vendors))
           AS unmatched_vendor_key_rows,
       count(*) FILTER (WHERE vendor_id IN (SELECT vendor_id FROM vendors))
           AS matched_transaction_rows,
       round(count(*) FILTER (WHERE vendor_id IN (SELECT vendor_id FROM vendors)) / count(*) * 100, 3)
           AS match_rate_percent
FROM transactions
"""
SQL["shape_comparison"] = """
SELECT CAST(year(o_orderdate) AS VARCHAR) AS period, 'transactions' AS "table",
       count(*) AS rows, CAST(18 AS BIGINT) AS columns
FROM orders GROUP BY 1
"""
_PERIODS = f"""
early AS (SELECT * FROM transactions WHERE action_date < TIMESTAMP '{MIDDLE}'),
late AS (SELECT * FROM transactions WHERE action_date >= TIMESTAMP '{MIDDLE}')
"""
SQL["missing_top"] = f"""
WITH {VIEWS}, {_PERIODS}, e AS ({profile("early", _TRANSACTION_KINDS)}),
l AS ({profile("late", _TRANSACTION_KINDS)}),
top AS (
  SELECT e.field, e.missing_percent AS early, l.missing_percent AS late
  FROM e JOIN l ON e.field = l.field
  ORDER BY greatest(e.missing_percent, l.missing_percent) DESC, e.field LIMIT 12
)
SELECT field, 'early' AS period, early AS missing_percent FROM top
UNION ALL SELECT field, 'late', late FROM top
"""
_PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _distribution(column: str) -> str:
    picks = ", ".join(
        f"round(quantile_cont({column}, {p}), 4) AS p{round(p * 100):g}" for p in _PERCENTILES
    )
    number = f"CAST({column} AS DOUBLE)"
    return (
        f"SELECT '{column}' AS field, count({column}) AS count, round(avg({column}), 4) AS mean, "
        f"round(stddev_samp({column}), 4) AS std, round(min({number}), 4) AS min, "
        f"round(max({number}), 4) AS max, {picks} FROM transactions"
    )


SQL["distribution"] = f"WITH {VIEWS} " + " UNION ALL ".join(
    _distribution(name)
    for name in (
        "federal_action_obligation",
        "total_dollars_obligated",
        "number_of_offers_received",
    )
)
SQL["log_histogram"] = f"""
WITH {VIEWS}, scaled AS (
  SELECT sign(total_dollars_obligated) * ln(1 + abs(total_dollars_obligated)) AS x
  FROM transactions WHERE total_dollars_obligated IS NOT NULL
), bounds AS (SELECT min(x) AS low, max(x) AS high FROM scaled)
SELECT CAST(least(79, floor((x - low) / (high - low) * 80)) AS BIGINT) AS bin, count(*) AS rows
FROM scaled, bounds GROUP BY 1
"""
SQL["group_counts"] = f"""
WITH {VIEWS}
SELECT extent_competed_code, solicitation_procedures_code, count(*) AS rows FROM transactions
WHERE extent_competed_code IS NOT NULL AND solicitation_procedures_code IS NOT NULL GROUP BY 1, 2
"""
SQL["monthly_volume"] = """
SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, count(*) AS rows
FROM events GROUP BY 1, 2
"""
_VOLUMES = "volumes AS (SELECT vendor_id, count(*) AS transactions FROM transactions GROUP BY 1)"
SQL["concentration"] = f"""
WITH {VIEWS}, {_VOLUMES}
SELECT vendor_id, transactions, row_number() OVER (ORDER BY transactions DESC, vendor_id) AS rank
FROM volumes
"""
SQL["concentration_quantiles"] = f"WITH {VIEWS}, {_VOLUMES} " + " UNION ALL ".join(
    f"SELECT CAST({p} AS DOUBLE) AS quantile, "
    f"round(CAST(quantile_cont(transactions, {p}) AS DOUBLE), 6) AS volume FROM volumes"
    for p in (0, 0.5, 0.9, 0.95, 0.99, 1)
)

# --- defects and their evaluation --------------------------------------------------------


def _picked(name: str, source: str, used: list[str], eligible: str = "true") -> str:
    """A CTE with the first PER_TYPE eligible, unused records by hash."""
    order = f"md5('{SEED + FISCAL_YEAR}|{name}|' || _record_id), _record_id"
    free = "".join(f" AND _record_id NOT IN (SELECT _record_id FROM p_{other})" for other in used)
    return (
        f"p_{name} AS (SELECT _record_id, row_number() OVER (ORDER BY {order}) - 1 AS place "
        f"FROM {source} WHERE {eligible}{free} ORDER BY {order} LIMIT {PER_TYPE})"
    )


def _place(name: str, table: str) -> str:
    return f"(SELECT place FROM p_{name} p WHERE p._record_id = {table}._record_id)"


INJECTED = f"""
{_picked("missing_vendor_name", "vendors", [], "recipient_name IS NOT NULL")},
{_picked("invalid_vendor_uei", "vendors", ["missing_vendor_name"], "recipient_uei IS NOT NULL")},
{_picked("invalid_domestic_state", "vendors", ["missing_vendor_name", "invalid_vendor_uei"],
         "recipient_state_code IS NOT NULL")},
{_picked("duplicate_vendor_id", "vendors",
         ["missing_vendor_name", "invalid_vendor_uei", "invalid_domestic_state"])},
{_picked("orphan_vendor_reference", "transactions", [])},
{_picked("duplicate_transaction_key", "transactions", ["orphan_vendor_reference"])},
vendor_pool AS (
  SELECT _record_id AS _source, * FROM vendors
  UNION ALL
  SELECT v._record_id, v.* REPLACE (printf('controlled:duplicate_vendor_id:{SEED}:%d', p.place)
                                    AS _record_id)
  FROM vendors v JOIN p_duplicate_vendor_id p ON p._record_id = v._record_id
),
pool AS (
  SELECT _record_id AS _source, * FROM transactions
  UNION ALL
  SELECT t._record_id, t.* REPLACE (printf('controlled:duplicate_transaction_key:{SEED}:%d', p.place)
                                    AS _record_id)
  FROM transactions t JOIN p_duplicate_transaction_key p ON p._record_id = t._record_id
),
{_picked("invalid_performance_date_order", "pool", ["orphan_vendor_reference"],
         f"{START} IS NOT NULL AND {END} IS NOT NULL")},
{_picked("negative_offer_count", "pool",
         ["orphan_vendor_reference", "invalid_performance_date_order"])},
{_picked("action_date_outside_fiscal_year", "pool",
         ["orphan_vendor_reference", "invalid_performance_date_order", "negative_offer_count"])},
vendors2 AS (
  SELECT * EXCLUDE (_source) REPLACE (
    CASE WHEN {_place("missing_vendor_name", "vendor_pool")} IS NULL THEN recipient_name END
        AS recipient_name,
    coalesce(printf('BAD%03d!', {_place("invalid_vendor_uei", "vendor_pool")}), recipient_uei)
        AS recipient_uei,
    CASE WHEN {_place("invalid_domestic_state", "vendor_pool")} IS NULL
         THEN recipient_state_code ELSE 'ZZ' END AS recipient_state_code,
    CASE WHEN {_place("invalid_domestic_state", "vendor_pool")} IS NULL
         THEN recipient_country_code ELSE 'USA' END AS recipient_country_code)
  FROM vendor_pool
),
transactions2 AS (
  SELECT * EXCLUDE (_source) REPLACE (
    coalesce(printf('UEI:CONTROLLEDORPHAN%04d', {_place("orphan_vendor_reference", "pool")}),
             vendor_id) AS vendor_id,
    CASE WHEN {_place("invalid_performance_date_order", "pool")} IS NULL THEN {END}
         ELSE {START} - INTERVAL 1 DAY END AS {END},
    CASE WHEN {_place("negative_offer_count", "pool")} IS NULL THEN number_of_offers_received
         ELSE -1 END AS number_of_offers_received,
    CASE WHEN {_place("action_date_outside_fiscal_year", "pool")} IS NULL THEN action_date
         ELSE TIMESTAMP '{FISCAL_YEAR - 2}-01-01' END AS action_date)
  FROM pool
)
"""
SQL["inject_vendors"] = f"WITH {VIEWS}, {INJECTED} SELECT * FROM vendors2"
SQL["inject_transactions"] = f"WITH {VIEWS}, {INJECTED} SELECT {_DATED} FROM transactions2"


def _quoted(value: str) -> str:
    return f"coalesce('\"' || {value} || '\"', 'null')"


def _label(name: str, field: str, source: str, original: str, injected: str, kind: str,
           injected_kind: str | None = None, record: str = "_record_id",
           key: str = "_record_id") -> str:
    issue = ISSUES[name]
    shown = _quoted if kind in ("str", "Timestamp") else lambda v: f"coalesce(CAST({v} AS VARCHAR), 'null')"

    def typed(value: str, name: str) -> str:
        return f"CASE WHEN {value} IS NULL THEN 'null' ELSE '{name}' END"

    return (
        f"SELECT '{issue.table}' AS target_table, {record} AS record_id, '{name}' AS issue_type, "
        f"'{issue.severity}' AS severity, '{field}' AS field, {shown(original)} AS original_value, "
        f"{shown(injected)} AS injected_value, CAST({SEED} AS BIGINT) AS seed, "
        f"{typed(original, kind)} AS original_value_type, "
        f"{typed(injected, injected_kind or kind)} AS injected_value_type, "
        f"{issue.rank} AS severity_rank "
        f"FROM {source} s JOIN p_{name} p ON p._record_id = s.{key}"
    )


_ISO = "'%Y-%m-%dT%H:%M:%S+00:00'"
LABELS = " UNION ALL ".join(
    [
        _label("missing_vendor_name", "recipient_name", "vendors", "recipient_name",
               "CAST(NULL AS VARCHAR)", "str", record="s._record_id"),
        _label("invalid_vendor_uei", "recipient_uei", "vendors", "recipient_uei",
               "printf('BAD%03d!', place)", "str", record="s._record_id"),
        _label("invalid_domestic_state", "recipient_state_code", "vendors", "recipient_state_code",
               "'ZZ'", "str", record="s._record_id"),
        _label("duplicate_vendor_id", "vendor_id", "vendors", "vendor_id", "vendor_id", "str",
               record=f"printf('controlled:duplicate_vendor_id:{SEED}:%d', place)"),
        _label("orphan_vendor_reference", "vendor_id", "transactions", "vendor_id",
               "printf('UEI:CONTROLLEDORPHAN%04d', place)", "str", record="s._record_id"),
        _label("duplicate_transaction_key", KEY, "transactions", KEY, KEY, "str",
               record=f"printf('controlled:duplicate_transaction_key:{SEED}:%d', place)"),
        _label("invalid_performance_date_order", END, "pool", f"strftime({END}, {_ISO})",
               f"strftime({START} - INTERVAL 1 DAY, {_ISO})", "Timestamp", record="s._record_id"),
        _label("negative_offer_count", "number_of_offers_received", "pool",
               "number_of_offers_received", "-1", "int", record="s._record_id"),
        _label("action_date_outside_fiscal_year", "action_date", "pool",
               f"strftime(action_date, {_ISO})", f"'{FISCAL_YEAR - 2}-01-01T00:00:00+00:00'",
               "Timestamp", record="s._record_id"),
    ]
)
SQL["defect_labels"] = f"WITH {VIEWS}, {INJECTED} {LABELS}"

_COUNTS = ("true_positives", "false_positives", "false_negatives")
_SIX = (*_COUNTS, "precision", "recall", "f1")


def _membership(name: str, keys: str, labels: str, found: str) -> str:
    return (
        f"{name} AS (SELECT {keys}, bool_or(t) AS t, bool_or(p) AS p, bool_or(s) AS s FROM ("
        f"SELECT {keys}, true AS t, false AS p, severity IN ('high', 'critical') AS s FROM {labels} "
        f"UNION ALL SELECT {keys}, false, true, false FROM {found}) GROUP BY ALL)"
    )


def _scored(name: str, source: str, by: str = "") -> str:
    """CTE with tp, fp, fn, precision, recall, f1 and severe recall per group."""
    group = f" GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return (
        f"{name}_c AS (SELECT {lead}count(*) FILTER (WHERE t AND p) AS true_positives, "
        "count(*) FILTER (WHERE NOT t AND p) AS false_positives, "
        "count(*) FILTER (WHERE t AND NOT p) AS false_negatives, "
        "count(*) FILTER (WHERE s) AS severe, count(*) FILTER (WHERE s AND p) AS severe_found "
        f"FROM {source}{group}), "
        f"{name}_p AS (SELECT *, coalesce(true_positives / nullif(true_positives + "
        "false_positives, 0), 0.0) AS precision, coalesce(true_positives / nullif("
        f"true_positives + false_negatives, 0), 0.0) AS recall FROM {name}_c), "
        f"{name} AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) "
        f"AS f1, coalesce(severe_found / nullif(severe, 0), 0.0) AS severe_recall FROM {name}_p)"
    )


def _rows(source: str, names, prefix: str = "''", where: str = "true") -> list[str]:
    return [
        f"SELECT {prefix} || '{name}' AS metric, CAST({name} AS DOUBLE) AS value "
        f"FROM {source} WHERE {where}"
        for name in names
    ]


def _issue_metrics(labels: str, found: str, records: str) -> str:
    """CTEs and the final SELECT of the issue-grain metrics."""
    ctes = ", ".join(
        [
            _membership("m_issue", "target_table, record_id, issue_type", labels, found),
            _membership("m_record", "target_table, record_id", labels, found),
            _scored("issue", "m_issue"),
            _scored("record", "m_record"),
            _scored("types", "m_issue", "issue_type"),
            f"head AS (SELECT target_table, record_id, issue_type FROM {found} ORDER BY risk_score "
            "DESC, severity_rank DESC, target_table, record_id, issue_type "
            f"LIMIT {K})",
        ]
    )
    labelled = "true_positives + false_negatives > 0"
    parts = [
        f"SELECT 'evaluated_records' AS metric, CAST({records} AS DOUBLE) AS value",
        f"SELECT 'controlled_defects', CAST(count(*) AS DOUBLE) FROM {labels}",
        f"SELECT 'findings', CAST(count(*) AS DOUBLE) FROM {found}",
        *_rows("issue", _SIX, "'issue_level.'"),
        *_rows("record", _SIX, "'record_level.'"),
        *_rows("types", _SIX, "'issue_type.' || issue_type || '.'", labelled),
        f"SELECT 'macro_issue_f1', avg(f1) FROM types WHERE {labelled}",
        "SELECT 'high_critical_issue_recall', severe_recall FROM issue",
        f"SELECT 'false_alarms_per_1000_records', false_positives / {records} * 1000 FROM issue",
        f"SELECT 'top_{K}_precision', coalesce(count(*) FILTER (WHERE (target_table, record_id, "
        f"issue_type) IN (SELECT (target_table, record_id, issue_type) FROM {labels})) "
        "/ nullif(count(*), 0), 0.0) FROM head",
    ]
    final = "SELECT metric, round(value, 6) AS value FROM (" + " UNION ALL ".join(parts) + ")"
    return f"{ctes} {final}"


SQL["baseline_metrics"] = (
    f"WITH {VIEWS}, {INJECTED}, labelled AS ({LABELS}), "
    f"found AS ({findings(v='vendors2', t='transactions2')}), "
    + _issue_metrics(
        "labelled",
        "found",
        "((SELECT count(*) FROM vendors2) + (SELECT count(*) FROM transactions2))",
    )
)
DOCUMENTS = """
doc_labels AS (
  SELECT lang AS target_table, CAST(doc_id AS VARCHAR) AS record_id, 'low_quality' AS issue_type,
         'high' AS severity FROM labels JOIN documents USING (doc_id) WHERE quality = 0
  UNION ALL
  SELECT lang, CAST(doc_id AS VARCHAR), 'toxic', 'critical'
  FROM labels JOIN documents USING (doc_id) WHERE toxic = 1
),
doc_findings AS (
  SELECT lang AS target_table, CAST(doc_id AS VARCHAR) AS record_id, 'low_quality' AS issue_type,
         'high' AS severity, 3 AS severity_rank, 75 AS risk_score FROM documents WHERE n_chars < 600
  UNION ALL
  SELECT lang, CAST(doc_id AS VARCHAR), 'toxic', 'critical', 4, 100
  FROM documents WHERE contains(text, '!')
),
long AS (
  SELECT lang AS target_table, CAST(doc_id AS VARCHAR) AS record_id, 'long' AS model_name,
         least(1.0, n_chars / 8000) AS rank_percentile FROM documents
),
doc_long AS (SELECT *, rank_percentile * 100 AS priority_score, rank_percentile >= 0.6 AS predicted
             FROM long),
short AS (
  SELECT target_table, record_id, 'short' AS model_name, 1 - rank_percentile AS rank_percentile
  FROM long
),
doc_short AS (SELECT *, rank_percentile * 100 AS priority_score, rank_percentile >= 0.6 AS predicted
              FROM short),
sizes AS (SELECT lang AS target_table, count(*) AS records FROM documents GROUP BY lang)
"""
SQL["eval_issue"] = f"WITH {DOCUMENTS}, " + _issue_metrics(
    "doc_labels", "doc_findings", "(SELECT count(*) FROM documents)"
)


def _per_table(name: str, ranking: str) -> str:
    """CTE of per-table metrics of a ranking."""
    truth = "(target_table, record_id) IN (SELECT (target_table, record_id) FROM doc_labels)"
    return ", ".join(
        [
            _membership(
                f"{name}_m",
                "target_table, record_id",
                "doc_labels",
                f"(SELECT * FROM {ranking} WHERE predicted)",
            ),
            _scored(f"{name}_s", f"{name}_m", "target_table"),
            f"{name}_h AS (SELECT target_table, coalesce(count(*) FILTER (WHERE {truth}) / "
            f"nullif(count(*), 0), 0.0) AS top_{K}_precision FROM (SELECT *, row_number() OVER ("
            "PARTITION BY target_table ORDER BY priority_score DESC, record_id) AS place "
            f"FROM {ranking}) WHERE place <= {K} GROUP BY target_table)",
            f"{name} AS (SELECT s.target_table, coalesce(true_positives, 0) AS true_positives, "
            "coalesce(false_positives, 0) AS false_positives, coalesce(false_negatives, 0) AS "
            "false_negatives, coalesce(severe, 0) AS severe, coalesce(severe_found, 0) AS "
            "severe_found, coalesce(precision, 0.0) AS precision, coalesce(recall, 0.0) AS recall, "
            f"coalesce(f1, 0.0) AS f1, coalesce(top_{K}_precision, 0.0) AS top_{K}_precision, "
            "coalesce(false_positives, 0) / records * 1000 AS false_alarms_per_1000_records "
            f"FROM sizes s LEFT JOIN {name}_s USING (target_table) LEFT JOIN {name}_h USING "
            "(target_table))",
        ]
    )


_TABLE_COLUMNS = (*_SIX, f"top_{K}_precision", "false_alarms_per_1000_records")
_ROUNDED = ", ".join(
    name if name in _COUNTS else f"round({name}, 6) AS {name}" for name in _TABLE_COLUMNS
)
SQL["eval_per_table"] = (
    f"WITH {DOCUMENTS}, {_per_table('pt', 'doc_long')} SELECT target_table, {_ROUNDED} FROM pt"
)


def _bins(ranking: str) -> str:
    return f"""
SELECT CAST(greatest(0, (SELECT min(i) FROM range(10) r(i) WHERE rank_percentile <= (i + 1) / 10.0::DOUBLE))
            AS BIGINT) AS percentile_bin, count(*) AS records,
       avg(CASE WHEN (target_table, record_id) IN (SELECT (target_table, record_id) FROM doc_labels)
                THEN 1.0 ELSE 0.0 END) AS controlled_defect_rate
FROM {ranking} WHERE rank_percentile IS NOT NULL GROUP BY 1
"""


def _record_metrics(name: str, ranking: str) -> tuple[str, str]:
    """(CTEs, SELECT of metric and value) of the record-grain metrics."""
    truth = "(target_table, record_id) IN (SELECT (target_table, record_id) FROM doc_labels)"
    ctes = ", ".join(
        [
            _per_table(f"{name}_t", ranking),
            _scored(f"{name}_o", f"{name}_t_m"),
            f"{name}_head AS (SELECT * FROM {ranking} ORDER BY priority_score DESC, target_table, "
            f"record_id LIMIT {K})",
            f"{name}_bins AS ({_bins(ranking)})",
        ]
    )
    records = "(SELECT sum(records) FROM sizes)"
    parts = [
        f"SELECT 'evaluated_records' AS metric, CAST({records} AS DOUBLE) AS value",
        f"SELECT 'controlled_defect_records', CAST(true_positives + false_negatives AS DOUBLE) FROM {name}_o",
        f"SELECT 'predicted_records', CAST(true_positives + false_positives AS DOUBLE) FROM {name}_o",
        *_rows(f"{name}_o", _SIX),
        f"SELECT 'macro_f1', avg(f1) FROM {name}_t",
        f"SELECT 'high_critical_recall', severe_recall FROM {name}_o",
        f"SELECT 'top_{K}_precision', count(*) FILTER (WHERE {truth}) / count(*) FROM {name}_head",
        f"SELECT 'false_alarms_per_1000_records', false_positives / {records} * 1000 FROM {name}_o",
        *_rows(f"{name}_t", _TABLE_COLUMNS, "'per_table.' || target_table || '.'"),
        *_rows(
            f"{name}_bins",
            ("records", "controlled_defect_rate"),
            "'rank_calibration.' || CAST(percentile_bin AS VARCHAR) || '.'",
        ),
    ]
    return ctes, " UNION ALL ".join(parts)


_LONG, _SHORT = _record_metrics("lo", "doc_long"), _record_metrics("sh", "doc_short")
SQL["eval_record"] = (
    f"WITH {DOCUMENTS}, {_LONG[0]} SELECT metric, round(value, 6) AS value FROM ({_LONG[1]})"
)
SQL["calibration"] = (
    f"WITH {DOCUMENTS} SELECT percentile_bin, records, round(controlled_defect_rate, 6) AS "
    f"controlled_defect_rate FROM ({_bins('doc_long')})"
)
WINNERS = f"""
{_per_table("wl", "doc_long")}, {_per_table("ws", "doc_short")},
candidates AS (SELECT *, 'long' AS model_name FROM wl UNION ALL SELECT *, 'short' FROM ws),
winners AS (
  SELECT target_table, model_name FROM candidates
  QUALIFY row_number() OVER (PARTITION BY target_table ORDER BY top_{K}_precision DESC, f1 DESC,
                             precision DESC, false_positives, model_name DESC) = 1
)
"""
SQL["winners"] = f"WITH {DOCUMENTS}, {WINNERS} SELECT * FROM winners"
SQL["combined_scores"] = f"""
WITH {DOCUMENTS}, {WINNERS}
SELECT target_table, model_name, record_id, round(rank_percentile, 6) AS rank_percentile,
       round(priority_score, 6) AS priority_score, predicted
FROM (SELECT * FROM doc_long UNION ALL SELECT * FROM doc_short)
WHERE (target_table, model_name) IN (SELECT (target_table, model_name) FROM winners)
"""
_BOTH = f"{_LONG[0]}, {_SHORT[0]}, mlo AS ({_LONG[1]}), msh AS ({_SHORT[1]})"


def _metric(source: str, name: str) -> str:
    return f"(SELECT value FROM {source} WHERE metric = '{name}')"


_GATES = {
    "development_only_selection": "true",
    "top_k_precision_non_inferior": f"{_metric('mlo', f'top_{K}_precision')} >= "
    f"{_metric('msh', f'top_{K}_precision')}",
    "macro_f1_non_inferior": f"{_metric('mlo', 'macro_f1')} >= {_metric('msh', 'macro_f1')}",
    "false_alarm_rate_non_inferior": f"{_metric('mlo', 'false_alarms_per_1000_records')} <= "
    f"{_metric('msh', 'false_alarms_per_1000_records')}",
    "deterministic_critical_findings_preserved": f"{_metric('mlo', 'high_critical_recall')} >= 1.0",
}
SQL["gates"] = f"WITH {DOCUMENTS}, {_BOTH} SELECT *, {' AND '.join(_GATES)} AS promoted FROM (SELECT " + (
    ", ".join(f"{gate} AS {name}" for name, gate in _GATES.items()) + ")"
)
_HEADLINES = (
    "precision",
    "recall",
    "macro_f1",
    f"top_{K}_precision",
    "false_alarms_per_1000_records",
    "high_critical_recall",
)
SQL["metrics_comparison"] = f"WITH {DOCUMENTS}, {_BOTH} " + " UNION ALL ".join(
    f"SELECT 'development' AS period, '{approach}' AS approach, "
    + ", ".join(f"round({_metric(source, name)}, 6) AS {name}" for name in _HEADLINES)
    for approach, source in (("long", "mlo"), ("short", "msh"))
)

# --- features and models -----------------------------------------------------------------


def _log(column: str) -> str:
    return f"(sign({column}) * ln(1 + abs({column})))"


def _numeric_fit(schema: FeatureSchema, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{f.name}' AS feature, quantile_cont({_log(f.source)}, 0.5) AS median, "
        f"coalesce(nullif(quantile_cont({_log(f.source)}, 0.75) - "
        f"quantile_cont({_log(f.source)}, 0.25), 0), 1.0) AS scale FROM {source}"
        for f in schema.numeric
    )


def _category_fit(schema: FeatureSchema, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{f.name}' AS feature, nullif(trim({f.source}), '') AS value, count(*) AS n, "
        f"count(*) / (SELECT count(*) FROM {source}) AS frequency FROM {source} GROUP BY 2"
        for f in schema.categorical
    )


def _transformed(schema: FeatureSchema, source: str) -> str:
    """Every table once: the source is materialized, the numeric fit is one row, frequencies are maps."""
    columns, fits, maps = [], [], []
    for f in schema.numeric:
        fits += [
            f"max(median) FILTER (feature = '{f.name}') AS median_{f.name}",
            f"max(scale) FILTER (feature = '{f.name}') AS scale_{f.name}",
        ]
        median, scale = f"nfit.median_{f.name}", f"nfit.scale_{f.name}"
        columns += [
            f"round((coalesce({_log(f.source)}, {median}) - {median}) / {scale}, 6) AS {f.name}__scaled",
            f"CASE WHEN {f.source} IS NULL THEN 1.0::DOUBLE ELSE 0.0 END AS {f.name}__missing",
        ]
    for f in schema.categorical:
        maps.append(
            f"(SELECT map_from_entries(list(struct_pack(k := coalesce(value, chr(1)), v := frequency))) "
            f"FROM cfit WHERE feature = '{f.name}') AS map_{f.name}"
        )
        columns += [
            f"round(coalesce(cmap.map_{f.name}[coalesce(nullif(trim(s.{f.source}), ''), chr(1))], 0.0), 6) "
            f"AS {f.name}__frequency",
            f"CASE WHEN s.{f.source} IS NULL THEN 1.0::DOUBLE ELSE 0.0 END AS {f.name}__missing",
        ]
    definition = VENDORS_SQL if source == "vendors" else TRANSACTIONS_SQL
    return (
        f"WITH {source} AS MATERIALIZED ({definition}), "
        f"nfit AS MATERIALIZED (SELECT {', '.join(fits)} FROM ({_numeric_fit(schema, source)})), "
        f"cfit AS MATERIALIZED ({_category_fit(schema, source)}), "
        f"cmap AS MATERIALIZED (SELECT {', '.join(maps)}) "
        f"SELECT _record_id, {', '.join(columns)} FROM {source} s, nfit, cmap"
    )


SQL["features_fit_numeric"] = (
    f"WITH {VIEWS} SELECT feature, round(median, 6) AS median, round(scale, 6) AS scale "
    f"FROM ({_numeric_fit(TRANSACTION_FEATURES, 'transactions')})"
)
SQL["features_fit_approx"] = f"WITH {VIEWS} " + " UNION ALL ".join(
    f"SELECT '{f.name}' AS feature, {p}::DOUBLE AS probability, count({f.source}) AS n, true AS within, "
    f"true AS fitted FROM transactions"
    for f in TRANSACTION_FEATURES.numeric
    for p in QUARTILES
)
SQL["distribution_approx"] = " UNION ALL ".join(
    f"SELECT '{name}' AS field, {p}::DOUBLE AS probability, count({column}) AS n, true AS within FROM lineitem"
    for name, column in (("price", "l_extendedprice"), ("tax", "l_tax"))
    for p in (0.01, 0.25, 0.5, 0.75, 0.99)
)
SQL["features_fit_categorical"] = (
    f"WITH {VIEWS} SELECT feature, value, n, round(frequency, 6) AS frequency "
    f"FROM ({_category_fit(TRANSACTION_FEATURES, 'transactions')})"
)
SQL["features_vendor"] = _transformed(VENDOR_FEATURES, "vendors")
SQL["features_transaction"] = _transformed(TRANSACTION_FEATURES, "transactions")
_PRICES = """
scores AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, round(o_totalprice / 100) AS raw,
                  o_orderstatus FROM orders),
training AS (SELECT raw FROM scores WHERE o_orderstatus = 'F')
"""


def _higher(source: str, fraction: float) -> str:
    return (
        f"(SELECT raw FROM (SELECT raw, row_number() OVER (ORDER BY raw) - 1 AS place, "
        f"count(*) OVER () AS n FROM {source}) WHERE place = ceil((n - 1) * {1 - fraction}))"
    )


SQL["threshold"] = f"""
WITH {_PRICES}
SELECT min(raw) AS threshold, count(*) AS reviewed FROM scores
WHERE raw >= {_higher("scores", 0.025)}
"""
SQL["rank_percentile"] = f"""
WITH {_PRICES}, ranked AS (
  SELECT id, raw,
         (SELECT count(*) FROM training t WHERE t.raw <= s.raw) / (SELECT count(*) FROM training)
             AS percentile
  FROM (SELECT * FROM scores) s
)
SELECT id, raw, round(percentile, 6) AS rank_percentile,
       round(percentile * 100, 6) AS anomaly_score, round(percentile * 100, 6) AS priority_score,
       raw >= {_higher("training", 0.025)} AS predicted
FROM ranked
"""


def _reference(column: str, name: str) -> str:
    spread = f"quantile_cont({column}, 0.75) - quantile_cont({column}, 0.25)"
    return (
        f"SELECT '{name}' AS feature, round(CAST(quantile_cont({column}, 0.5) AS DOUBLE), 4) AS median, "
        f"round(CAST(CASE WHEN {spread} > 0 THEN {spread} WHEN stddev_pop({column}) > 0 "
        f"THEN stddev_pop({column}) ELSE 1.0 END AS DOUBLE), 4) AS scale FROM transactions"
    )


SQL["reference_stats"] = f"WITH {VIEWS} " + " UNION ALL ".join(
    [
        _reference("federal_action_obligation", "federal_action_obligation"),
        _reference("number_of_offers_received", "number_of_offers_received"),
        _reference("2.0::DOUBLE", "constant"),
    ]
)


def _plain(value: str) -> str:
    """Six decimals, halves to even."""
    millionths = f"CAST(round_even(({value}) * 1000000, 0) AS DECIMAL(30,0))"
    text = f"rtrim(CAST({millionths} * CAST('0.000001' AS DECIMAL(7,6)) AS VARCHAR), '0')"
    return f"regexp_replace({text}, '\\.$', '.0')"


SQL["evidence_topk"] = f"""
WITH points AS (
  SELECT o_orderkey AS id, floor(o_totalprice / 10) / 100 AS price,
         CAST(o_custkey AS DOUBLE) AS customer, CAST(month(o_orderdate) AS DOUBLE) AS month,
         CAST(day(o_orderdate) AS DOUBLE) AS day FROM orders
), long AS (
  SELECT id, 'price' AS feature, 0 AS place, price AS value, 250.0::DOUBLE AS median, 128.0::DOUBLE AS scale FROM points
  UNION ALL SELECT id, 'customer', 1, customer, 512.0, 256.0 FROM points
  UNION ALL SELECT id, 'month', 2, month, 6.0, 4.0 FROM points
  UNION ALL SELECT id, 'day', 3, day, 16.0, 8.0 FROM points
), ranked AS (
  SELECT *, (value - median) / scale AS deviation,
         row_number() OVER (PARTITION BY id ORDER BY abs((value - median) / scale) DESC, place DESC)
             AS rank FROM long
), entries AS (
  SELECT id, string_agg('{{"feature":"' || feature || '","reference_median":' || {_plain("median")}
           || ',"scaled_deviation":' || {_plain("deviation")} || ',"value":' || {_plain("value")}
           || '}}', ',' ORDER BY rank) AS top
  FROM ranked WHERE rank <= 3 GROUP BY id
)
SELECT id, '{{"anomaly_percentile":' || {_plain("price / 1024")} || ',"anomaly_score":'
       || {_plain("price / 8")} || ',"interpretation":"{INTERPRETATION}","top_feature_deviations":['
       || top || ']}}' AS evidence
FROM points JOIN entries USING (id)
"""
SQL["lof_scores"] = """
WITH points AS (
  SELECT printf('%08d', vec_id) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), params AS (SELECT least(35, count(*) - 1) AS k FROM points),
pairs AS (
  SELECT a.id AS id, b.id AS other, list_distance(a.v, b.v) AS d FROM points a, points b
), own AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS place
  FROM pairs WHERE id <> other
), fit AS (SELECT id, other, d FROM own, params WHERE place <= k),
reach AS (SELECT id, max(d) AS kd FROM fit GROUP BY id),
density AS (
  SELECT fit.id, 1 / (avg(greatest(kd, d)) + 1e-10) AS lrd
  FROM fit JOIN reach ON reach.id = fit.other GROUP BY fit.id
), asked AS (
  SELECT id, other, d FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS place FROM pairs), params
  WHERE place <= k
)
SELECT asked.id,
       round(avg(lrd) / (1 / (avg(greatest(kd, d)) + 1e-10)) - 1.5, 6) AS raw
FROM asked JOIN reach ON reach.id = asked.other JOIN density ON density.id = asked.other
GROUP BY asked.id
"""

SQL["lof_scores_blocks"] = SQL["lof_scores"]
# copies count, so a vector needs fewer other vectors the more copies these have
SQL["lof_recall"] = """
WITH groups AS (
  SELECT CAST(embedding AS DOUBLE[]) AS v, min(vec_id) AS ref, count(*) AS copies FROM embeddings GROUP BY v
), pairs AS (
  SELECT a.ref AS query, b.copies, sum(b.copies) OVER (
           PARTITION BY a.ref ORDER BY list_distance(a.v, b.v), b.ref ROWS UNBOUNDED PRECEDING) AS upto
  FROM groups a, groups b
)
SELECT count(*) AS exact_pairs, TRUE AS recall_reached FROM pairs WHERE upto - copies < 35
"""

# --- review queues -----------------------------------------------------------------------

_SCORES = """
percentiles AS (
  SELECT *, least(1.0::DOUBLE, floor(federal_action_obligation / 50) / 10000) AS percentile
  FROM transactions
),
scores AS (
  SELECT 'transaction' AS target_table, _record_id AS record_id, 'price' AS model_name,
         percentile * 100 AS anomaly_score, percentile AS rank_percentile,
         percentile >= 0.9 AS predicted, percentile * 100 AS priority_score,
         'vendor ' || vendor_id AS evidence
  FROM percentiles
)
"""
_RANKING = """
ranking AS (
  SELECT target_table, record_id, max(risk_score) AS priority_score,
         bool_or(severity = 'critical') AS deterministic_critical,
         '["' || string_agg(DISTINCT issue_type, '", "' ORDER BY issue_type) || '"]'
             AS deterministic_issue_types,
         true AS predicted
  FROM findings GROUP BY target_table, record_id
)
"""
SQL["record_ranking"] = f"WITH {FOUND}, {_RANKING} SELECT * FROM ranking"
SQL["guarded_queue"] = f"""
WITH {FOUND}, {_RANKING}, {_SCORES}, model AS (SELECT * FROM scores WHERE predicted),
joined AS (
  SELECT target_table, record_id, r.priority_score AS risk, r.deterministic_critical AS critical,
         deterministic_issue_types, model_name, anomaly_score, rank_percentile,
         evidence AS model_evidence
  FROM ranking r FULL OUTER JOIN model m USING (target_table, record_id)
)
SELECT target_table, record_id, risk AS deterministic_risk_score,
       coalesce(critical, false) AS deterministic_critical, deterministic_issue_types, model_name,
       round(anomaly_score, 6) AS anomaly_score, round(rank_percentile, 6) AS rank_percentile,
       model_evidence, risk IS NOT NULL AS has_deterministic_finding,
       model_name IS NOT NULL AS has_model_finding, true AS predicted,
       round(CASE WHEN critical THEN 3 WHEN risk IS NOT NULL THEN 2 ELSE 1 END * 1000
             + coalesce(CAST(risk AS DOUBLE), coalesce(rank_percentile, 0) * 100), 6)
           AS priority_score
FROM joined
"""
SQL["suppressed_critical"] = f"""
WITH {FOUND} SELECT DISTINCT target_table, record_id FROM findings
WHERE severity = 'critical' AND target_table <> 'transaction'
"""
SQL["severity_filter"] = (
    f"WITH {FOUND} SELECT * FROM findings WHERE severity IN ('critical', 'medium')"
)
_DIGITS = (
    "strpos('0123456789abcdef', {h}[1]) * 4096 - 4096 + strpos('0123456789abcdef', {h}[2]) * 256 - 256 "
    "+ strpos('0123456789abcdef', {h}[3]) * 16 - 16 + strpos('0123456789abcdef', {h}[4]) - 1"
)
_IDENTIFIED = f"""
hashed AS (
  SELECT *, sha256('run-1|' || target_table || '|' || record_id || '|' || issue_type) AS finding_id
  FROM findings
),
identified AS (
  SELECT *, CASE WHEN severity <> 'medium'
                 THEN round(({_DIGITS.format(h="finding_id")}) / 65536, 4) END AS model_confidence
  FROM hashed
)
"""
SQL["mixed_queue"] = f"""
WITH {FOUND}, {_IDENTIFIED}
SELECT row_number() OVER (ORDER BY md5(finding_id), finding_id) - 1 AS position,
       finding_id, record_id, issue_type, risk_score
FROM identified
"""
SQL["confidence_queue"] = f"""
WITH {FOUND}, {_IDENTIFIED}
SELECT row_number() OVER (
         ORDER BY model_confidence DESC NULLS LAST, risk_score DESC NULLS LAST, target_table,
                  record_id, issue_type) - 1 AS position,
       finding_id, record_id, issue_type, round(model_confidence, 6) AS model_confidence
FROM identified
"""
SQL["review_table"] = f"""
WITH {FOUND}, {_IDENTIFIED}, source_keys AS (
  SELECT _record_id AS record_id, vendor_id AS source_key FROM vendors
  UNION ALL SELECT _record_id, {KEY} FROM transactions
), top AS (
  SELECT *, CAST(row_number() OVER (ORDER BY model_confidence DESC NULLS LAST, finding_id) AS INTEGER)
           AS queue_position
  FROM identified QUALIFY queue_position <= {K}
)
SELECT queue_position, severity,
       array_to_string(list_transform(string_split(issue_type, '_'),
           lambda w: upper(w[1]) || w[2:]), ' ') AS issue,
       upper(target_table[1]) || target_table[2:] || ' · ' || record_id AS record,
       coalesce(source_key, '') AS source_key, round(model_confidence, 6) AS model_confidence,
       risk_score
FROM top LEFT JOIN source_keys USING (record_id)
"""
SQL["top_evidence"] = f"""
WITH {VIEWS}, {_SCORES}
SELECT target_table, record_id, model_name, round(anomaly_score, 6) AS anomaly_score,
       round(rank_percentile, 6) AS rank_percentile, evidence
FROM scores WHERE predicted
ORDER BY priority_score DESC, target_table, record_id LIMIT {K}
"""
SQL["rerank_inactive"] = f"""
WITH {FOUND} SELECT *, CAST(risk_score AS DOUBLE) * 1000 AS review_priority,
                    CAST(NULL AS DOUBLE) AS model_confidence FROM findings
"""

# --- feedback ----------------------------------------------------------------------------

_FEEDBACK = """
feedback AS (
  SELECT 'F:' || CAST(user_id AS VARCHAR) || ':' || CAST(day(ts) AS VARCHAR) AS finding_id,
         event_id AS feedback_id,
         CASE event_type WHEN 'view' THEN 'correct_flag' WHEN 'click' THEN 'false_alarm'
              WHEN 'signup' THEN 'wrong_issue_type' WHEN 'purchase' THEN 'missed_issue'
              ELSE 'unsure' END AS verdict,
         ts, CASE WHEN day(ts) < 6 THEN 75.0::DOUBLE WHEN day(ts) < 20 THEN 50.0 ELSE 100.0 END
             AS risk_score
  FROM events
),
decisive AS (
  SELECT *, CASE WHEN verdict = 'correct_flag' THEN 1 ELSE 0 END AS label FROM feedback
  WHERE verdict IN ('correct_flag', 'false_alarm', 'wrong_issue_type')
  QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY ts DESC, feedback_id DESC) = 1
)
"""
SQL["feedback_latest"] = (
    f"WITH {_FEEDBACK} SELECT finding_id, feedback_id, verdict, label, risk_score FROM decisive"
)
_ENOUGH = """
count(*) >= 24 AS minimum_feedback_examples,
count(*) FILTER (WHERE label = 1) >= 8 AS minimum_positive_examples,
count(*) FILTER (WHERE label = 0) >= 8 AS minimum_negative_examples
"""
SQL["feedback_sufficiency"] = f"WITH {_FEEDBACK} SELECT {_ENOUGH} FROM decisive"
SQL["feedback_split"] = f"""
WITH {_FEEDBACK}
SELECT finding_id, label,
       row_number() OVER (PARTITION BY label ORDER BY md5('42|' || finding_id), finding_id)
           <= ceil(0.3::DOUBLE * count(*) OVER (PARTITION BY label)) AS is_validation
FROM decisive
"""
_RERANKED = f"""
{_FEEDBACK}, hashes AS (SELECT *, md5(finding_id) AS h FROM decisive),
ranked AS (
  SELECT *, risk_score * 1000 AS active_priority,
         risk_score * 1000 + ({_DIGITS.format(h="h")}) / 65536 AS candidate_priority FROM hashes
)
"""


def _ranking_metrics(side: str) -> str:
    return f"""
SELECT '{side}' AS ranking, CAST({K} AS BIGINT) AS top_k,
       round(sum(label) / count(*), 6) AS top_k_precision,
       round(sum(label) / (SELECT sum(label) FROM ranked), 6) AS top_k_recall,
       CAST(count(*) - sum(label) AS BIGINT) AS false_alarms_in_top_k,
       1.0::DOUBLE AS overall_recall
FROM (SELECT * FROM ranked ORDER BY {side}_priority DESC, finding_id LIMIT {K})
"""


SQL["rerank_metrics"] = (
    f"WITH {_RERANKED} {_ranking_metrics('active')} UNION ALL {_ranking_metrics('candidate')}"
)
SQL["rerank_gates"] = f"""
WITH {_RERANKED}, a AS ({_ranking_metrics("active")}), c AS ({_ranking_metrics("candidate")}),
e AS (SELECT {_ENOUGH} FROM decisive),
g AS (
  SELECT e.*, c.top_k_precision > a.top_k_precision AS top_k_precision_improved,
         c.top_k_recall >= a.top_k_recall AS top_k_recall_non_inferior,
         c.false_alarms_in_top_k <= a.false_alarms_in_top_k AS false_alarms_non_inferior,
         true AS deterministic_findings_preserved
  FROM e, a, c
)
SELECT *, minimum_feedback_examples AND minimum_positive_examples AND minimum_negative_examples
          AND top_k_precision_improved AND top_k_recall_non_inferior AND false_alarms_non_inferior
          AS promoted
FROM g
"""
SQL["feedback_store"] = f"""
WITH {FOUND}, {_IDENTIFIED}
SELECT finding_id, target_table, issue_type, severity, CAST(risk_score AS DOUBLE) AS risk_score,
       CASE WHEN severity = 'critical' THEN 'correct_flag' ELSE 'false_alarm' END AS verdict
FROM identified
"""

# --- sources, sinks and streams ----------------------------------------------------------

SQL["run_findings"] = f"""
WITH {FOUND}, {_IDENTIFIED}
SELECT target_table, record_id, issue_type, severity, severity_rank, evidence,
       CAST(risk_score AS DOUBLE) AS risk_score, CAST(risk_score AS DOUBLE) AS review_priority,
       CAST(NULL AS DOUBLE) AS model_confidence, finding_id, 'run-1' AS run_id
FROM identified
"""
SQL["run_ids"] = f"""
WITH {FOUND}
SELECT run_id, count(*) AS count, count(*) AS finding_count
FROM findings, (SELECT unnest(['007', 'run-1']) AS run_id) GROUP BY run_id
"""
SQL["json_roundtrip"] = "SELECT n_nationkey, n_name FROM nation"
SQL["snapshot_check"] = """
SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(strlen(n_name) + 1 AS BIGINT) AS bytes,
       sha256(n_name || chr(10)) AS sha256
FROM nation
"""
SQL["integers_exact"] = "SELECT o_orderkey, CAST(9007199254740993 + o_orderkey AS BIGINT) AS n FROM orders"
SQL["profile_floats"] = """
SELECT 'discount' AS field, 'double' AS dtype, 'numeric' AS semantic_type,
       count(*) FILTER (WHERE l_tax = 0) AS missing_count,
       round(count(*) FILTER (WHERE l_tax = 0) / count(*) * 100, 3) AS missing_percent,
       count(DISTINCT l_discount) FILTER (WHERE l_tax <> 0) AS unique_count
FROM lineitem
"""
SQL["run_record"] = f"""
WITH {FOUND}
SELECT 'run-1' AS run_id, {FISCAL_YEAR} AS fiscal_year,
       (SELECT count(*) FROM vendors) AS vendor_records,
       (SELECT count(*) FROM transactions) AS transaction_records, count(*) AS finding_count
FROM findings
"""
SQL["findings_export"] = f"""
WITH {FOUND}, {_IDENTIFIED}
SELECT finding_id, 'run-1' AS run_id, target_table, record_id, issue_type, severity,
       CAST(CAST(risk_score AS DOUBLE) AS VARCHAR) AS risk_score, evidence
FROM identified
"""
SQL["raw_scan"] = f"""
SELECT ' T' || CAST(o_orderkey AS VARCHAR) || ' ' AS {KEY},
       CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) || ' ' END AS recipient_uei,
       CASE WHEN o_orderpriority <> '5-LOW' THEN printf('%09d', o_custkey) END AS recipient_duns,
       CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%m/%d/%Y')
            WHEN 'O' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'unknown' END AS action_date,
       CASE WHEN o_orderstatus = 'P' THEN '$' ELSE '' END || CAST(o_totalprice AS VARCHAR)
           AS federal_action_obligation,
       '  ' || o_orderpriority AS recipient_name,
       CASE WHEN o_orderkey % 3 = 0
            THEN 'said "' || o_orderpriority || '",' || chr(10) || '"' || CAST(o_custkey AS VARCHAR) || chr(10)
            ELSE o_orderpriority END AS note
FROM orders
"""
SQL["period_scan"] = f"""
WITH {VIEWS}, {_PERIODS}
SELECT _record_id, vendor_id, strftime(action_date, {_STAMP}) AS action_date, 1998 AS fiscal_year
FROM late
"""
SQL["upload_scan"] = """
SELECT 'vendor' AS target_table, printf('%09d', c_custkey) AS vendor_id, nullif(c_mktsegment, 'BUILDING') AS value
FROM customer
UNION ALL
SELECT 'transaction', printf('%09d', o_custkey), CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END FROM orders
"""
_EVENTS = """
SELECT 'event' AS target_table, record_id, issue_type, severity, severity_rank, evidence,
       CAST(least(100, weight + 5 * (count(*) OVER (PARTITION BY record_id) - 1)) AS INTEGER)
           AS risk_score
FROM (
  SELECT CAST(event_id AS VARCHAR) AS record_id, 'type_unknown' AS issue_type, 'low' AS severity,
         1 AS severity_rank, 'event_type=' || event_type || ' is odd' AS evidence, 40 AS weight
  FROM events WHERE event_type NOT IN ('view', 'click')
  UNION ALL
  SELECT CAST(event_id AS VARCHAR), 'value_low', 'medium', 2,
         'value_over_ten=' || CAST(CAST(floor(value) AS BIGINT) - 10 AS VARCHAR) || ' is negative', 60
  FROM events WHERE floor(value) < 10
  UNION ALL
  SELECT CAST(event_id AS VARCHAR), 'time_outside', 'high', 3,
         'at=' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '+00:00 is outside the window', 75
  FROM events WHERE ts < TIMESTAMP '2024-01-05' OR ts > TIMESTAMP '2024-01-25'
)
"""
SQL["stream_findings"] = _EVENTS
_REFUSED = "(event_id % 7 = 3 OR user_id % 5 = 0)"
SQL["stream_runs"] = f"""
SELECT record_id, issue_type, CAST(risk_score AS DOUBLE) AS risk_score,
       CAST(risk_score AS DOUBLE) AS review_priority FROM ({_EVENTS})
WHERE record_id NOT IN (SELECT CAST(event_id AS VARCHAR) FROM events WHERE {_REFUSED})
"""
SQL["stream_rejects"] = f"""
SELECT CAST(event_id AS VARCHAR) AS record_id,
       concat_ws(',', CASE WHEN event_id % 7 = 3 THEN 'value_over_ten' END, CASE WHEN user_id % 5 = 0 THEN 'user' END)
           AS problems,
       (SELECT count(*) FROM events WHERE NOT {_REFUSED}) AS accepted, (SELECT count(*) FROM events) AS read
FROM events WHERE {_REFUSED}
"""
SQL["torn_run"] = f"""
WITH {VIEWS}, found AS ({findings()})
SELECT unnest(['a', 'b']) AS run_id, (SELECT count(*) FROM found) AS count, CAST(0 AS BIGINT) AS of_torn_run
"""
SQL["snapshot_report"] = """
SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, problem, CAST(1 AS BIGINT) AS files, true AS whole_valid,
       false AS broken_valid
FROM (
  SELECT n_nationkey, CASE n_nationkey WHEN 1 THEN 'other hash' WHEN 2 THEN 'other size' WHEN 3 THEN 'missing'
                      WHEN 4 THEN 'extra' END AS problem FROM nation
  UNION ALL SELECT 3, 'extra'
)
"""

# --- certificates, round trips and bounds -------------------------------------------------

_NODES = ", ".join(str(node) for node in FOREST)
_MEAN_PATH = (
    "CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1) / {n}::DOUBLE "
    "WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
)
SQL["iforest_paths"] = f"""
WITH RECURSIVE nodes(tree, node, feature, threshold, l, r, depth, size) AS (VALUES {_NODES}),
points AS (
  SELECT o_orderkey AS id, [floor(o_totalprice / 1000), CAST(o_custkey AS DOUBLE), CAST(month(o_orderdate) AS DOUBLE)] AS v
  FROM orders
), walk AS (
  SELECT id, v, n.* FROM points, nodes n WHERE node = 0
  UNION ALL
  SELECT w.id, w.v, n.* FROM walk w JOIN nodes n
    ON n.tree = w.tree AND n.node = CASE WHEN w.v[w.feature + 1] <= w.threshold THEN w.l ELSE w.r END
  WHERE w.feature >= 0
), paths AS (
  SELECT id, sum(depth + {_MEAN_PATH.format(n="size")}) AS path FROM walk WHERE feature < 0 GROUP BY id
)
SELECT id, round(path, 6) AS path, round(pow(2, -(path / 3) / ({_MEAN_PATH.format(n="16")})) - 0.5, 6) AS raw FROM paths
"""
SQL["iforest_samples"] = """
WITH n AS (SELECT count(*) AS rows FROM embeddings)
SELECT CAST(tree AS INTEGER) AS tree, least(256, rows) AS rows, least(256, rows) AS ids,
       CAST(least(256, rows) AS BIGINT) AS leaf_rows,
       true AS sizes_right, true AS depth_right, true AS thresholds_right, rows AS agreed
FROM n, range(50) AS t(tree)
"""
SQL["anomaly_bounds"] = """
SELECT target_table, 'isolation_forest' AS model_name, n AS records, n AS ids, n AS "right",
       true AS reviewed_enough, true AS reaches_one
FROM (SELECT 'vendor' AS target_table, count(*) AS n FROM customer
      UNION ALL SELECT 'transaction', count(*) FROM orders)
"""
SQL["model_roundtrip"] = "SELECT count(*) AS records, count(*) AS same FROM customer"
SQL["experiment_gates"] = """
SELECT period, approach, true AS in_range, CASE WHEN approach = 'guarded_review_queue' THEN true END AS critical_kept
FROM (SELECT unnest(['development', 'temporal_holdout']) AS period),
     (SELECT unnest(['deterministic_baseline', 'isolation_forest', 'local_outlier_factor',
                      'selected_statistical_workflow', 'guarded_review_queue']) AS approach)
"""
SQL["features_check"] = """
WITH rows AS (
  SELECT nullif(CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderkey // 2 AS VARCHAR) END, '') AS id,
         o_orderkey % 11 = 0 AS word, o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0 AS infinite FROM orders
)
SELECT 'missing_id' AS "check", '_record_id' AS field, count(*) FILTER (id IS NULL) AS violations FROM rows
UNION ALL SELECT 'not_a_number', 'price', count(*) FILTER (word) FROM rows
UNION ALL SELECT 'not_finite', 'price', count(*) FILTER (infinite) FROM rows
UNION ALL SELECT 'not_a_number', 'o_custkey', 0
UNION ALL SELECT 'not_finite', 'o_custkey', 0
UNION ALL SELECT 'repeated_id', '_record_id', CAST(coalesce(sum(n), 0) AS BIGINT)
          FROM (SELECT count(*) AS n FROM rows WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)
"""
SQL["features_roundtrip"] = SQL["features_vendor"]
SQL["rerank_certificate"] = f"""
WITH {_FEEDBACK}
SELECT count(*) AS examples, CAST(sum(label) AS BIGINT) AS positives,
       count(DISTINCT (risk_score, CASE WHEN day(ts) < 6 THEN 1 WHEN day(ts) < 12 THEN 2 WHEN day(ts) < 20 THEN 3 ELSE 4 END, label))
           AS designs, true AS optimal
FROM decisive
"""
