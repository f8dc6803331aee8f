"""Joins and rankings that stay balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aliasmith.session import stored

# A table of heavy keys up to this size is broadcast; a larger one is joined by shuffle.
BROADCAST_KEYS = 100_000
ROWS_PER_PART = 250_000
# Pairs that a task of a join forms, up to so many tasks. The tables are small beside their pairs, and a
# planner that goes by their bytes would leave the pairs to a few tasks.
PAIRS_PER_TASK = 2_000_000
MOST_TASKS = 2_000


def key_pairs(many: DataFrame, few: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that both tables hold, with their rows in each: ``_many`` and ``_few``."""
    keys = list(keys)
    one = many.groupBy(*keys).agg(F.count("*").alias("_many"))
    two = few.groupBy(*keys).agg(F.count("*").alias("_few"))
    return one.join(two, keys)


def salted_join(
    many: DataFrame, few: DataFrame, keys: Sequence[str], pairs_per_split: int = 4_000_000
) -> DataFrame:
    """Inner equi join in which each key that forms many pairs is split over several tasks.

    What a key costs is the number of pairs it forms, so rows are counted on both sides.
    The rows of a heavy key in ``many`` are spread by hash over as many splits as its
    pairs ask for, and the matching rows of ``few`` are repeated once per split.
    """
    counted, pairs = stored(key_pairs(many, few, keys), "key-pairs"), F.col("_many") * F.col("_few")
    is_heavy = (F.col("_many") > 1) & (pairs > pairs_per_split)
    n_heavy, n_pairs = counted.agg(F.count_if(is_heavy), F.coalesce(F.sum(pairs), F.lit(0))).first()
    return spread_join(many, few, keys, counted.where(is_heavy), n_heavy, pairs_per_split, n_pairs)


def spread_join(
    many: DataFrame, few: DataFrame, keys: Sequence[str], heavy: DataFrame, n_heavy: int, pairs_per_split: int, n_pairs: int = 0
) -> DataFrame:
    """The join of ``salted_join`` with heavy keys that are known: rows of ``key_pairs``, ``n_heavy`` of them.

    ``n_pairs``, the pairs of all keys, gives the number of tasks; without it the planner does.
    """
    keys = list(keys)
    tasks = min(-(-n_pairs // PAIRS_PER_TASK), MOST_TASKS)

    def dealt(df: DataFrame, on: list[str]) -> DataFrame:
        return df.repartition(tasks, *on) if tasks > 1 else df

    if not n_heavy:
        return dealt(many, keys).join(dealt(few, keys), keys)
    splits = F.least(F.ceil(F.col("_many") * F.col("_few") / pairs_per_split), F.col("_many")).cast("int")
    heavy = heavy.select(*keys, splits.alias("_splits"))
    if n_heavy <= BROADCAST_KEYS:
        heavy = F.broadcast(heavy)
    n_splits = F.coalesce(F.col("_splits"), F.lit(1))
    spread = many.join(heavy, keys, "left").withColumn(
        "_split", F.pmod(F.xxhash64(*many.columns), n_splits).cast("int")
    )
    repeated = few.join(heavy, keys, "left").withColumn("_split", F.explode(F.sequence(F.lit(0), n_splits - 1)))
    on = [*keys, "_split"]
    joined = dealt(spread.drop("_splits"), on).join(dealt(repeated.drop("_splits"), on), on)
    return joined.drop("_split")


def top_n_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; a group is first thinned in parts of bounded size."""
    rows = stored(df, "ranked")
    parts = -(-rows.count() // ROWS_PER_PART) or 1
    thinned = (
        rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)))
        .withColumn("_rank", F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order)))
        .where(F.col("_rank") <= n)
        .drop("_part")
    )
    final = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return thinned.withColumn("_rank", final).where(F.col("_rank") <= n).drop("_rank")
