"""Validate, number, check and rank one uploaded pair or a single table's records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from rowproof.operators.contract import PROCUREMENT, Contract, validate_pair, validated_copy
from rowproof.operators.normalize import record_id
from rowproof.operators.ordering import DIGEST, PLACE, place_positions
from rowproof.operators.rules import columns_read, procurement_rules, ranked, run_rules
from rowproof.session import cut


@dataclass(frozen=True)
class Scored:
    vendors: DataFrame
    transactions: DataFrame
    findings: DataFrame


def _numbered(placed: DataFrame, order: Sequence[str] | None, kept: Sequence[str] = ()) -> DataFrame:
    """(_place, ``kept``, _position) by the given order, else by all columns."""
    names = [name for name in placed.columns if name not in (PLACE, DIGEST)]
    return place_positions(placed, order or names, "_position", kept)


def _with_ids(placed: DataFrame, numbered: DataFrame, table: str) -> DataFrame:
    positions = numbered.select(PLACE, "_position")
    named = placed.join(positions.hint("shuffle_hash"), PLACE).withColumn("_record_id", record_id(table))
    return named.drop(PLACE, DIGEST, "_position")


def _named(numbered: DataFrame, table: str) -> DataFrame:
    """What the rules read, with the record ids: findings need not meet their rows again."""
    return numbered.withColumn("_record_id", record_id(table)).drop(PLACE, "_position")


def score_batch(
    vendors: DataFrame,
    transactions: DataFrame,
    fiscal_year: int,
    contract: Contract = PROCUREMENT,
    vendor_order: Sequence[str] | None = None,
    transaction_order: Sequence[str] | None = None,
) -> Scored:
    """Unknown vendor keys fail the validation, so the orphan rule finds nothing here.

    Each table is written once, typed. Positions are computed from the order columns; the few columns that
    the rules read move along, so that rules run on numbered rows.
    """
    parent, child = validate_pair(vendors, transactions, contract)
    rules = procurement_rules(fiscal_year)
    numbered = {
        "vendor": _numbered(parent, vendor_order, columns_read(rules, "vendor")),
        "transaction": _numbered(child, transaction_order, columns_read(rules, "transaction")),
    }
    found = run_rules(
        *[_named(rows, table) for table, rows in numbered.items()], rules, contract.weights, ordered=False
    )
    return Scored(
        _with_ids(parent, numbered["vendor"], "vendor"),
        _with_ids(child, numbered["transaction"], "transaction"),
        ranked(cut(found)),
    )


def score_records(
    records: DataFrame,
    table: str,
    fiscal_year: int,
    contract: Contract = PROCUREMENT,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Findings of one table without looking at the other one."""
    valid = validated_copy(records, contract.table(table), table)
    rules = procurement_rules(fiscal_year)
    rows = _named(_numbered(valid, order, columns_read(rules, table)), table)
    vendors, transactions = (rows, None) if table == "vendor" else (None, rows)
    found = run_rules(
        vendors,
        transactions,
        rules,
        contract.weights,
        targets=(table,),
        relationships=False,
        ordered=False,
    )
    return ranked(cut(found))
