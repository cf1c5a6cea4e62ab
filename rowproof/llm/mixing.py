"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every source gets a target from its weight; a document is taken a whole number of times whose
expectation is target / source size. The fractional parts are rounded in pairs: words move between two
documents, in a random direction that keeps both expectations, until one of the two is taken or left for
certain. So the words of a source stay what they were; only the last document of all is left to chance.
Documents are dealt into nodes of about ``FAN`` by a hash; each node folds its documents in hash order and
hands one undecided document up, until a source has one node: a reduction tree whose depth is the logarithm
of the largest source. A source of any size is spread over many nodes. All choices come from hashes of the
rows, so reruns agree whatever the partitioning.

Defined cases: null and empty texts have size 0 and are taken 0 times; null is a source of its own, the last
one; rows equal in every used column form one unit with a count, and more than ``AT_ONCE`` copies of it are
written out by several tasks; an empty table gives an empty result; other columns are ignored (``mix``) or kept
(``mixed_documents``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.llm.common import text_of
from rowproof.operators.lookup import lookup
from rowproof.operators.ordering import COPIES_AT_ONCE, number_rows
from rowproof.session import cut

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"
FAN = 32
AT_ONCE = COPIES_AT_ONCE


def _targets(units: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """(_skey, source, source_size, _units, target) per source."""
    sources = cut(
        units.groupBy("_skey", "source").agg(
            F.sum(F.col("size") * F.col("_n")).alias("source_size"), F.count(F.lit(1)).alias("_units")
        )
    )
    numbered = number_rows(sources, [F.col("source").isNull(), "source"], "_place")
    pick = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int")
    )
    weighed = cut(numbered.withColumn("_weight", pick))
    limit = F.col("source_size") * F.lit(most)
    total, weight = weighed.agg(
        F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_weight"), F.lit(0.0))
    ).first()
    whole, level, held = share * total, 0.0, -1
    if weight:
        level = whole / weight
    # share the excess of full sources by weight until none is above its limit
    while weight:
        full = limit <= F.lit(level) * F.col("_weight")
        count, kept, rest = weighed.agg(
            F.count(F.when(full, 1)),
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0.0)),
        ).first()
        if count == held or not rest:
            break
        held, level = count, (whole - kept) / rest
    return weighed.select(
        "_skey", "source", "source_size", "_units", F.least(limit, F.lit(level) * F.col("_weight")).alias("target")
    )


def _uniform(*columns: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def _pivot(state: Column, other: Column) -> Column:
    """Round one of the undecided document and ``other``; the rest stays undecided."""
    mine = state["open"]
    a, p, b, q = mine["size"], mine["p"], other["size"], other["p"]
    ratio = b.cast("double") / a
    up, down = F.least(1 - p, q * ratio), F.least(p, (1 - q) * ratio)
    rise = _uniform(mine["k1"], mine["k2"], other["k1"], other["k2"], F.lit(5)) * (up + down) < down

    def decided(which: Column, taken: int, left: Column, p: Column) -> Column:
        bounded = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
        return F.struct(
            left.withField("p", bounded).alias("open"),
            F.concat(state["done"], F.array(F.struct(which.alias("unit"), F.lit(taken).alias("taken")))).alias("done"),
        )

    return (
        F.when(mine.isNull(), F.struct(other.alias("open"), state["done"].alias("done")))
        .when(rise & (1 - p <= q * ratio), decided(mine, 1, other, q - (1 - p) / ratio))
        .when(rise, decided(other, 0, mine, p + q * ratio))
        .when(p <= (1 - q) * ratio, decided(mine, 0, other, q + p / ratio))
        .otherwise(decided(other, 1, mine, p - (1 - q) * ratio))
    )


def _round(units: DataFrame) -> DataFrame:
    """(unit, taken 0 or 1) for units with a fraction p, through the reduction tree."""
    fields = ["k1", "k2", *[c for c in units.columns if c not in ("k1", "k2", "_nodes")]]
    kind = units.select(F.struct(*fields).alias("u")).schema["u"].dataType.simpleString()
    done = f"array<struct<unit:{kind},taken:int>>"
    start = F.struct(F.lit(None).cast(kind).alias("open"), F.array().cast(done).alias("done"))
    decisions, level = None, 0
    open_units = units
    while True:
        folded = cut(
            open_units.select(
                "_skey", "_nodes", F.struct(*fields).alias("u"),
                F.pmod(F.xxhash64("k1", "k2", F.lit(level)), F.col("_nodes")).alias("_node"),
            )
            .groupBy("_skey", "_nodes", "_node")
            .agg(F.array_sort(F.collect_list("u")).alias("us"))
            .select("_nodes", F.aggregate("us", start, _pivot).alias("s"))
        )
        found = folded.select(F.explode("s.done").alias("d")).select("d.unit", "d.taken")
        last = folded.where(F.col("_nodes") <= 1).select(
            F.col("s.open").alias("unit"),
            (_uniform(F.col("s.open.k1"), F.col("s.open.k2"), F.lit(9)) < F.col("s.open.p")).cast("int").alias("taken"),
        )
        found = found.unionByName(last)
        decisions = found if decisions is None else decisions.unionByName(found)
        rest = folded.where(F.col("_nodes") > 1)
        if rest.isEmpty():
            return decisions
        level += 1
        open_units = rest.select("s.open.*", F.ceil(F.col("_nodes") / FAN).alias("_nodes"))


def plan_mix(
    rows: DataFrame,
    columns: Sequence[str],
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """Groups of equal rows with their copies.

    ``rows`` has source, size, k1, k2 (128 bits of the row) and ``columns``, carried along. Adds
    source_size, target, _n (equal rows), _base and _more: ``_more`` of the rows are taken _base + 1 times.
    """
    units = cut(
        rows.groupBy("k1", "k2", "source", "size", *columns)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_skey", F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), "source")))
    )
    targets = _targets(units, weights, share, most)
    known = lookup(units, targets.drop("source"), "_skey", weight="_units", spread="k1")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most)))
    known = known.withColumn("_rate", F.coalesce(rate, F.lit(0.0)))
    parts = F.col("_n") * (F.col("_rate") - F.floor("_rate"))
    known = cut(
        known.withColumn("_base", F.when(F.col("size") > 0, F.floor("_rate")).otherwise(F.lit(0)))
        .withColumn("_parts", F.when(F.col("size") > 0, parts).otherwise(F.lit(0.0)))
        .withColumn("_more", F.floor("_parts"))
        .withColumn("p", F.col("_parts") - F.floor("_parts"))
        .withColumn("_nodes", F.ceil(F.col("_units") / FAN))
        .drop("_units", "_rate", "_parts")
    )
    kept = [c for c in known.columns if c not in ("p", "_nodes")]
    settled = known.where(F.col("p") == 0).select(*[f"`{c}`" for c in kept])
    rounded = _round(known.where(F.col("p") > 0)).select("unit.*", "taken")
    rounded = rounded.withColumn("_more", F.col("_more") + F.col("taken")).select(*[f"`{c}`" for c in kept])
    return settled.unionByName(rounded)


def _written_out(groups: DataFrame, count: str, rows: DataFrame | None = None) -> DataFrame:
    """``groups``, joined with ``rows`` by k1 and k2, as often as ``count`` says, with ``_copy`` from 1.

    A group of more than ``AT_ONCE`` copies is cut into chunks that are spread over the cluster.
    """

    def joined(some: DataFrame) -> DataFrame:
        return some if rows is None else rows.join(some, ["k1", "k2"])

    one = F.lit(1).cast("long")
    few = joined(groups.where(F.col(count) <= AT_ONCE)).select("*", F.explode(F.sequence(one, F.col(count))).alias("_copy"))
    large = groups.where(F.col(count) > AT_ONCE)
    if large.isEmpty():
        return few
    last = F.floor((F.col(count) - 1) / AT_ONCE)
    chunks = large.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    # the row joins its group before the chunks are spread: equal rows are one up to here. With a number, as
    # chunks are few bytes before they are written out and would be put together again
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = joined(chunks).repartition(tasks, "k1", "k2", "_chunk")
    start = F.col("_chunk") * AT_ONCE
    copy = F.explode(F.sequence(start + 1, F.least(start + AT_ONCE, F.col(count)))).alias("_copy")
    return few.unionByName(spread.select("*", copy).drop("_chunk"))


def mix(
    documents: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words, repeats counted)."""
    content = text_of(documents, text)
    rows = documents.select(
        F.col(f"`{id_column}`").alias("_id"),
        F.col(f"`{source}`").cast("string").alias("source"),
        F.regexp_count(content, F.lit(WORD)).cast("long").alias("size"),
    )
    rows = rows.withColumn("k1", F.xxhash64("_id", "source", "size")).withColumn(
        "k2", F.xxhash64(F.lit(3), "size", "_id", "source")
    )
    each = _written_out(cut(plan_mix(rows, ["_id"], weights, share, most)), "_n")
    times = F.col("_base") + (F.col("_copy") <= F.col("_more")).cast("long")
    return each.select(
        F.col("_id").alias(id_column),
        "size",
        "source_size",
        "target",
        (F.col("size") * times).cast("long").alias("taken"),
    )


def mixed_documents(
    documents: DataFrame,
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """``documents`` with every row as often as the mix takes it.

    Equal rows are merged before the shuffle, then written out as often as all of them are taken.
    """
    names = [f"`{name}`" for name in documents.columns]
    keyed = documents.select(
        F.xxhash64(*names).alias("k1"), F.xxhash64(F.lit(3), *names).alias("k2"), F.struct(*names).alias("_row")
    )
    rows = documents.select(
        F.xxhash64(*names).alias("k1"),
        F.xxhash64(F.lit(3), *names).alias("k2"),
        F.col(f"`{source}`").cast("string").alias("source"),
        F.regexp_count(text_of(documents, text), F.lit(WORD)).cast("long").alias("size"),
    )
    planned = plan_mix(rows, [], weights, share, most)
    copies = cut(planned.select("k1", "k2", (F.col("_base") * F.col("_n") + F.col("_more")).alias("_copies")))
    distinct = keyed.groupBy("k1", "k2").agg(F.first("_row").alias("_row"))
    return _written_out(copies.where("_copies > 0"), "_copies", distinct).select("_row.*")
