"""Mixing sources to target weights by capped water-filling.

A source's target is ``level * weight``, held down to ``max_epochs`` times its size. The level
rises in rounds: what clamped sources cannot take is shared among the others in proportion to
their weights, until no target is above its cap. A source then gives whole repetitions of
all its documents, and the fractional repetition is a seeded sample of them: the documents
first in hash order that fit, and one more whose size comes nearest to what is left.

Defined results: a null text has size 0 and is never repeated; a null source is a source
of its own; rows that agree in id, size and source are sampled together; an empty table
gives an empty mix; columns other than those named are passed through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aliasmith.llm.words import word_count
from aliasmith.session import stored

# Weights by rank of the source, repeating.
RANK_WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3.0
SEED = 42
# Hash order is looked at in buckets of its leading bits, and row by row in one bucket only.
BUCKET_BITS = 12
HASH_DIGITS = 15
_RANK = ["_hash", "_id", "_size"]


@dataclass(frozen=True)
class Mix:
    """``sized``: a narrow row per document; ``plan``: a row per source with its target and cuts."""

    sized: DataFrame
    plan: DataFrame


def seeded_order(key: Column, seed: int) -> Column:
    """60 bits of md5 over the key and the seed."""
    text = F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("null")), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("bigint")


def rank_weights(sources: DataFrame, weights: tuple[float, ...] = RANK_WEIGHTS) -> DataFrame:
    """``(_source, _weight)`` for a table of distinct sources: by code point, null last, repeating.

    The ranking sees one row per source, never the documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    return sources.withColumn("_weight", F.get(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights)))))


def fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Adds ``_target`` to ``(_source, _weight, _total)``: water-filling with caps.

    Only the level and two sums pass through the driver. The level never falls, so a clamped
    source stays clamped, and each round but the last clamps at least one more.
    """
    cap = F.col("_total") * F.lit(float(max_epochs))
    whole = sources.agg(F.sum("_total"), F.sum("_weight")).first()
    total, level = whole[0] or 0, 0.0
    if total and whole[1]:
        level, clamped = total / whole[1], -1
        while True:
            above = F.col("_weight") * F.lit(level) > cap
            row = sources.agg(
                F.count_if(above), F.sum(F.when(above, F.col("_total"))), F.sum(F.when(~above, F.col("_weight")))
            ).first()
            if row[0] == clamped:
                break
            clamped = row[0]
            if not row[2]:
                break
            level = (total - (row[1] or 0) * float(max_epochs)) / row[2]
    return sources.withColumn("_target", F.least(F.col("_weight") * F.lit(level), cap))


def plan_mix(
    docs: DataFrame,
    *,
    weights: DataFrame | tuple[float, ...] = RANK_WEIGHTS,
    max_epochs: float = MAX_EPOCHS,
    seed: int = SEED,
) -> Mix:
    """The mix of ``docs (doc_id, text, source)``; ``weights`` by rank or as a table (_source, _weight)."""
    sized = stored(
        docs.select(
            F.col("doc_id").alias("_id"),
            F.col("source").alias("_source"),
            word_count(F.col("text")).alias("_size"),
            seeded_order(F.col("doc_id"), seed).alias("_hash"),
        ),
        "mix-sizes",
    )
    totals = sized.groupBy("_source").agg(F.sum("_size").alias("_total"))
    if isinstance(weights, DataFrame):
        own = F.col("own._source").eqNullSafe(F.col("all._source"))
        weighted = totals.alias("all").join(weights.alias("own"), own, "left").select(
            "all._source", "_total", F.coalesce(F.col("_weight").cast("double"), F.lit(0.0)).alias("_weight")
        )
    else:
        weighted = rank_weights(totals, weights)
    sources = fill(stored(weighted, "mix-weights"), max_epochs)
    ratio = F.col("_target") / F.col("_total")
    whole = F.when(F.col("_total") > 0, F.floor(ratio)).otherwise(0).cast("bigint")
    sources = stored(
        sources.withColumn("_whole", whole).withColumn("_rest", F.col("_target") - F.col("_whole") * F.col("_total")),
        "mix-targets",
    )
    return Mix(sized, stored(_with_cuts(sized, sources), "mix-plan"))


def _with_cuts(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds to each source the first row in hash order that the fraction leaves, and the one to add."""
    asking = sources.where(F.col("_rest") > 0).select(F.col("_source").alias("_s"), "_rest")
    # Rows that agree in everything the order sees are one unit.
    units = sized.where(F.col("_size") > 0).groupBy("_source", *_RANK).agg(F.sum("_size").alias("_words"))
    units = units.join(asking, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    units = stored(
        units.withColumn("_bucket", F.shiftright("_hash", 4 * HASH_DIGITS - BUCKET_BITS)), "mix-units"
    )
    upto = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = units.groupBy("_source", "_rest", "_bucket").agg(F.sum("_words").alias("_in_bucket"))
    buckets = buckets.withColumn("_before", F.sum("_in_bucket").over(upto) - F.col("_in_bucket"))
    # The bucket in which the budget ends; a source's earlier buckets are taken whole.
    split = buckets.where((F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("_in_bucket") > F.col("_rest")))
    split = split.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), "_before")
    inside = units.join(split, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    rows = Window.partitionBy("_source").orderBy(*_RANK).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = inside.withColumn("_taken", F.col("_before") + F.sum("_words").over(rows))
    fits = F.col("_taken") <= F.col("_rest")
    cut = running.groupBy("_source").agg(
        F.min(F.when(~fits, F.struct(*_RANK))).alias("_next"),
        F.max(F.when(fits, F.col("_taken"))).alias("_sum"),
        F.first("_before").alias("_start"),
    )
    cut = cut.select(
        F.col("_source").alias("_s"), "_next", F.coalesce("_sum", "_start").alias("_sum")
    )
    open_units = units.join(cut, F.col("_source").eqNullSafe(F.col("_s")))
    left = F.col("_rest") - F.col("_sum")
    gap = F.abs(left - F.col("_words"))
    late = F.struct(*_RANK) >= F.col("_next")
    extra = open_units.where(late & (gap < left)).groupBy("_source").agg(
        F.min(F.struct(gap.alias("gap"), *_RANK)).alias("_near")
    )
    extra = extra.select(F.col("_source").alias("_e"), F.struct(*[F.col(f"_near.{c}") for c in _RANK]).alias("_extra"))
    cut = cut.select("_s", "_next")
    return (
        sources.join(cut, F.col("_source").eqNullSafe(F.col("_s")), "left")
        .join(extra, F.col("_source").eqNullSafe(F.col("_e")), "left")
        .drop("_s", "_e")
    )


def repeats(rest: Column, size: Column, rank: Column) -> Column:
    """How often a document is taken, given its source's row of the plan.

    Without a cut (``_next`` null) the fraction asks for all that the source has.
    """
    sampled = F.col("_next").isNull() | (rank < F.col("_next")) | rank.eqNullSafe(F.col("_extra"))
    more = (rest > 0) & sampled
    return F.when(size > 0, F.col("_whole") + more.cast("bigint")).otherwise(0)


def mix_counts(mix: Mix) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every document."""
    plan = mix.plan.withColumnRenamed("_source", "_s")
    joined = mix.sized.join(plan, F.col("_source").eqNullSafe(F.col("_s")))
    times = repeats(F.col("_rest"), F.col("_size"), F.struct(*_RANK))
    return joined.select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_total").alias("source_size"),
        F.col("_target").alias("target"),
        (times * F.col("_size")).cast("bigint").alias("taken"),
    )


def mixed_documents(docs: DataFrame, mix: Mix, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; texts are not shuffled.

    The plan has one row per source and is joined on the source, so the planner may broadcast it.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    ranked = docs.select(
        row,
        F.col("source").alias("_key"),
        F.col("doc_id").alias("_id"),
        word_count(F.col("text")).alias("_size"),
        seeded_order(F.col("doc_id"), seed).alias("_hash"),
    )
    joined = ranked.join(mix.plan, F.col("_key").eqNullSafe(F.col("_source")))
    times = repeats(F.col("_rest"), F.col("_size"), F.struct(*_RANK))
    taken = joined.select("row", F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("_n"))
    return taken.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
