"""Learning from reviewer feedback which findings to show first, behind explicit gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.functions.text import md5_of
from rowproof.operators.ordering import number_rows
from rowproof.plans.catalogue import (
    MINIMUM_FEEDBACK,
    MINIMUM_PER_CLASS,
    MODEL_SEED,
    NEGATIVE_VERDICTS,
    POSITIVE_VERDICTS,
    TOP_K,
    VALIDATION_FRACTION,
)
from rowproof.session import cut

CATEGORIES = ("target_table", "issue_type", "severity")
RISK_WEIGHT = 1000  # risks are whole numbers, so a confidence only orders equal risks


@dataclass(frozen=True)
class RerankerConfig:
    minimum_examples: int = MINIMUM_FEEDBACK
    minimum_class_examples: int = MINIMUM_PER_CLASS
    validation_fraction: float = VALIDATION_FRACTION


def decisive(examples: DataFrame) -> DataFrame:
    """Decisive verdicts first, then the latest per finding; label 1 for a correct flag."""
    kept = examples.where(F.col("verdict").isin(*POSITIVE_VERDICTS, *NEGATIVE_VERDICTS))
    order = ["feedback_created_at"]
    order += ["feedback_id"] if "feedback_id" in examples.columns else ["verdict"]
    rest = [name for name in examples.columns if name != "finding_id"]
    latest = kept.groupBy("finding_id").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_l"))
    label = F.col("verdict").isin(*POSITIVE_VERDICTS).cast("int")
    return latest.select("finding_id", "_l.*").withColumn("label", label)


def sufficiency(examples: DataFrame, config: RerankerConfig = RerankerConfig()) -> DataFrame:
    """One row of booleans."""
    positive = F.count_if(F.col("label") == 1)
    negative = F.count_if(F.col("label") == 0)
    return examples.agg(
        (F.count(F.lit(1)) >= config.minimum_examples).alias("minimum_feedback_examples"),
        (positive >= config.minimum_class_examples).alias("minimum_positive_examples"),
        (negative >= config.minimum_class_examples).alias("minimum_negative_examples"),
    )


def split(
    examples: DataFrame, fraction: float = VALIDATION_FRACTION, seed: int = MODEL_SEED
) -> DataFrame:
    """Add ``is_validation``: the first ceil(fraction * n) of each class by hash."""
    hashed = examples.withColumn("_hash", md5_of(seed, F.col("finding_id")))
    placed = number_rows(hashed, ["label", "_hash", "finding_id"], "_place")
    # two classes: two rows
    classes = placed.groupBy("label").agg(
        F.min("_place").alias("_start"), F.count(F.lit(1)).alias("_size")
    )
    inside = F.col("_place") - F.col("_start") < F.ceil(F.lit(fraction) * F.col("_size"))
    return (
        placed.join(F.broadcast(classes), "label")
        .withColumn("is_validation", inside)
        .drop("_hash", "_place", "_start", "_size")
    )


def _balance(count: int, positive: int) -> Column:
    """Class weights that add up to the number of examples, half of it for each class."""
    return F.when(F.col("label") == 1, count / (2.0 * positive)).otherwise(
        count / (2.0 * (count - positive))
    )


def optimality(examples: DataFrame, model: PipelineModel) -> DataFrame:
    """One row that certifies a fit: examples, positives, designs and gradient_norm.

    The gradient of the penalised, weighted loss at the fitted weights, summed over the distinct design rows:
    zero at the one optimum of a strictly convex loss.
    """
    totals = examples.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positive")).first()
    fitted = model.stages[-1]
    designs = (
        model.transform(examples)
        .select(vector_to_array("features").alias("x"), "label")
        .groupBy("x", "label")
        .agg(F.count(F.lit(1)).alias("many"))
    )
    weights = [float(w) for w in fitted.coefficients]
    dot = F.aggregate(
        F.zip_with("x", F.array(*[F.lit(w) for w in weights]), lambda x, w: x * w),
        F.lit(float(fitted.intercept)),
        lambda total, part: total + part,
    )
    residual = 1 / (1 + F.exp(-dot)) - F.col("label")
    share = F.col("many") * _balance(totals["n"], totals["positive"]) / F.lit(float(totals["n"])) * residual
    whole = F.concat("x", F.array(F.lit(1.0)))  # the intercept has no penalty
    slopes = (
        designs.select(F.posexplode(whole).alias("place", "value"), share.alias("share"))
        .groupBy("place")
        .agg(F.sum(F.col("share") * F.col("value")).alias("slope"))
    )
    penalty = F.lit(float(fitted.getRegParam())) * F.get(F.array(*[F.lit(w) for w in [*weights, 0.0]]), F.col("place"))
    norm = slopes.agg(F.sqrt(F.sum(F.pow(F.col("slope") + penalty, 2))).alias("gradient_norm"))
    size = designs.agg(F.sum("many").alias("examples"), F.sum(F.col("many") * F.col("label")).alias("positives"), F.count(F.lit(1)).alias("designs"))
    # one row each
    return size.join(F.broadcast(norm), F.lit(True))


def fit_reranker(examples: DataFrame, iterations: int = 1000) -> PipelineModel:
    """One-hot categories and standardised risk into a balanced logistic regression.

    ``regParam`` is 1/n: the class weights add up to n, which makes the penalty that of an
    unscaled C=1. Unknown categories become zeros.
    """
    totals = examples.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("label").alias("positive"),
        F.avg("risk_score").alias("mean"),
        F.stddev_pop("risk_score").alias("deviation"),
    ).first()
    count, positive = totals["n"], totals["positive"] or 0
    if not 0 < positive < count:
        raise ValueError("Training needs both classes")
    weight = _balance(count, positive)
    scale = totals["deviation"] or 1.0
    indexed = [f"{name}_index" for name in CATEGORIES]
    encoded = [f"{name}_hot" for name in CATEGORIES]
    stages = [
        SQLTransformer(
            statement=f"SELECT *, (risk_score - {totals['mean']!r}D) / {scale!r}D AS risk_scaled "
            "FROM __THIS__"
        ),
        StringIndexer(
            inputCols=list(CATEGORIES),
            outputCols=indexed,
            handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        VectorAssembler(inputCols=[*encoded, "risk_scaled"], outputCol="features"),
        LogisticRegression(
            labelCol="label",
            weightCol="class_weight",
            regParam=1.0 / count,
            standardization=False,
            maxIter=iterations,
            tol=1e-6,
        ),
    ]
    return Pipeline(stages=stages).fit(examples.withColumn("class_weight", weight))


def confidence(findings: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``model_confidence``, the probability that the flag is correct."""
    scored = model.transform(findings)
    probability = vector_to_array("probability")[1]
    return scored.select(
        *[F.col(name) for name in findings.columns if name != "model_confidence"],
        probability.alias("model_confidence"),
    )


def priorities(examples: DataFrame) -> DataFrame:
    risk = F.col("risk_score").cast("double") * RISK_WEIGHT
    return examples.withColumn("active_priority", risk).withColumn(
        "candidate_priority", risk + F.col("model_confidence")
    )


def evaluation_size(validation: int, k: int = TOP_K) -> int:
    return min(k, max(1, validation // 2))


def ranking_metrics(examples: DataFrame, priority: str, k: int) -> DataFrame:
    """One row: precision and recall of the first k, and false alarms among them."""
    top = examples.orderBy(F.desc(priority), "finding_id").limit(k)
    head = top.agg(
        F.count(F.lit(1)).alias("_shown"), F.coalesce(F.sum("label"), F.lit(0)).alias("_hits")
    )
    whole = examples.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("_positives"))
    shown, hits, positives = F.col("_shown"), F.col("_hits"), F.col("_positives")
    # one row on each side
    return head.join(F.broadcast(whole), F.lit(True)).select(
        F.lit(k).cast("long").alias("top_k"),
        F.when(shown > 0, hits / shown).otherwise(F.lit(0.0)).alias("top_k_precision"),
        F.when(positives > 0, hits / positives).otherwise(F.lit(0.0)).alias("top_k_recall"),
        (shown - hits).alias("false_alarms_in_top_k"),
        F.lit(1.0).alias("overall_recall"),
    )


def reranker_gates(active: DataFrame, candidate: DataFrame, enough: DataFrame) -> DataFrame:
    """One row of booleans from three one-row tables."""
    names = ("top_k_precision", "top_k_recall", "false_alarms_in_top_k")

    def side(frame: DataFrame, prefix: str) -> DataFrame:
        return frame.select(*[F.col(name).alias(f"{prefix}_{name}") for name in names])

    rows = enough.join(F.broadcast(side(active, "a")), F.lit(True))
    rows = rows.join(F.broadcast(side(candidate, "c")), F.lit(True))
    gates: dict[str, Column] = {name: F.col(name) for name in enough.columns}
    gates["top_k_precision_improved"] = F.col("c_top_k_precision") > F.col("a_top_k_precision")
    gates["top_k_recall_non_inferior"] = F.col("c_top_k_recall") >= F.col("a_top_k_recall")
    gates["false_alarms_non_inferior"] = F.col("c_false_alarms_in_top_k") <= F.col(
        "a_false_alarms_in_top_k"
    )
    gates["deterministic_findings_preserved"] = F.lit(True)
    promoted = F.lit(True)
    for gate in gates.values():
        promoted = promoted & gate
    return rows.select(
        promoted.alias("promoted"), *[gate.alias(name) for name, gate in gates.items()]
    )


@dataclass(frozen=True)
class Training:
    model: PipelineModel | None
    gates: DataFrame
    active: DataFrame | None = None
    candidate: DataFrame | None = None
    training_examples: int = 0
    validation_examples: int = 0
    reason: str = ""

    @property
    def promoted(self) -> bool:
        return self.model is not None and self.gates.first()["promoted"]


def train_reranker(
    examples: DataFrame,
    config: RerankerConfig = RerankerConfig(),
    k: int = TOP_K,
    seed: int = MODEL_SEED,
) -> Training:
    """Fit on the training part, compare with the present order on the validation part."""
    prepared = cut(decisive(examples))
    enough = sufficiency(prepared, config)
    if not all(enough.first()):
        gates = enough.withColumn("promoted", F.lit(False))
        reason = "Too few decisive verdicts to learn from."
        return Training(None, gates, training_examples=prepared.count(), reason=reason)
    parts = split(prepared, config.validation_fraction, seed)
    training, validation = parts.where("not is_validation"), parts.where("is_validation")
    model = fit_reranker(training)
    ranked = cut(priorities(confidence(validation, model)))
    shown = evaluation_size(ranked.count(), k)
    active = ranking_metrics(ranked, "active_priority", shown)
    candidate = ranking_metrics(ranked, "candidate_priority", shown)
    gates = cut(reranker_gates(active, candidate, enough))
    reason = (
        "Every gate is open: the learnt ranking may be used."
        if gates.first()["promoted"]
        else "At least one gate is closed: the present ranking stays."
    )
    return Training(
        model, gates, active, candidate, training.count(), ranked.count(), reason
    )


def rerank(findings: DataFrame, model: PipelineModel | None = None) -> DataFrame:
    """Add ``review_priority`` and ``model_confidence``; without a model the order stays."""
    risk = F.col("risk_score").cast("double") * RISK_WEIGHT
    if model is None:
        return findings.withColumn("review_priority", risk).withColumn(
            "model_confidence", F.lit(None).cast("double")
        )
    scored = confidence(findings, model)
    return scored.withColumn("review_priority", risk + F.col("model_confidence")).orderBy(
        F.desc("review_priority"), "target_table", "record_id", "issue_type"
    )
