"""Scoring records as they arrive. Row-local rules only, so no state is kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowproof.operators.contract import TableContract, coerced, mark_records
from rowproof.operators.rules import Rule, find_issues
from rowproof.sources.sinks import save_run


def row_local(rules: Sequence[Rule], table: str) -> list[Rule]:
    """Without the duplicate and orphan rules, which need other rows."""
    return [rule for rule in rules if rule.issue.table == table and rule.lookup_key is None]


def score_stream(
    stream: DataFrame,
    rules: Sequence[Rule],
    weights: dict[str, int],
    table: str,
    record_id: str = "_record_id",
) -> DataFrame:
    """Findings of a stream (or a batch) of records: the projection of the batch rules."""
    return find_issues(stream, row_local(rules, table), weights, record_id=record_id)


def checked(
    stream: DataFrame, table: str, contract: TableContract, fiscal_year: int
) -> DataFrame:
    """The records in declared types with their ``problems``, row by row before any scoring."""
    kinds = {field.name: field.dataType for field in stream.schema}
    known = [column for column in contract.columns if column.name in kinds]
    others = [name for name in stream.columns if name not in {column.name for column in known}]
    typed = stream.select(
        *[coerced(column.name, column.kind, kinds[column.name]).alias(column.name) for column in known],
        *[f"`{name}`" for name in others],
    )
    return mark_records(typed, table, contract, F.lit(fiscal_year))


def validated(
    stream: DataFrame, table: str, contract: TableContract, fiscal_year: int
) -> tuple[DataFrame, DataFrame]:
    """(accepted in declared types, refused with ``problems``)."""
    marked = checked(stream, table, contract, fiscal_year)
    return marked.where(F.size("problems") == 0).drop("problems"), marked.where(F.size("problems") > 0)


def write_findings(
    findings: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append to Parquet; without a ``trigger`` until everything available is read."""
    return (
        findings.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def write_runs(
    records: DataFrame,
    rules: Sequence[Rule],
    weights: dict[str, int],
    table: str,
    path: str,
    checkpoint: str,
    *,
    fiscal_year: int,
    name: str = "stream",
    schema_version: str = "1.0.0",
    model_version: str = "deterministic-baseline-v1",
    trigger: dict | None = None,
    contract: TableContract | None = None,
) -> StreamingQuery:
    """Save every micro-batch as a run whose id comes from the batch id: retries replace it.

    With a ``contract`` only accepted records are scored, in their declared types. Refused ones go to
    ``<path>/refused/run_id=...`` with their problems; the same write counts both kinds.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        run_id = f"{name}-{batch_id:08d}"
        if contract is None:
            marked = batch.withColumn("problems", F.array().cast("array<string>"))
        else:
            marked = checked(batch, table, contract, fiscal_year)
        marked.persist()  # written to two places
        try:
            refused, seen = F.size("problems") > 0, Observation()
            counted = marked.observe(
                seen, F.count(F.lit(1)).alias("records"), F.count_if(refused).alias("refused")
            )
            target = f"{path}/refused/run_id={run_id}"
            counted.where(refused).write.mode("overwrite").parquet(target)
            count = seen.get["records"] - seen.get["refused"]
            save_run(
                score_stream(marked.where(~refused).drop("problems"), rules, weights, table),
                path,
                run_id=run_id,
                fiscal_year=fiscal_year,
                vendor_records=count if table == "vendor" else 0,
                transaction_records=0 if table == "vendor" else count,
                schema_version=schema_version,
                model_version=model_version,
            )
        finally:
            marked.unpersist()

    return (
        records.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
