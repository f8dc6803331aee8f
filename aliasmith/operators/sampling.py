"""Seeded shuffles, samples, splits and class balancing, independent of partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aliasmith.functions.hashing import HASH_BITS, HASH_RANGE, seeded_hash
from aliasmith.session import cut_lineage

_BUCKET_BITS = 16


def seeded_shuffle(df: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """All rows in a random but repeatable order; a range-partitioned sort."""
    return df.withColumn("shuffle_key", seeded_hash(keys, seed)).orderBy("shuffle_key", *keys)


def seeded_sample(df: DataFrame, keys: list[str], n: int, seed: int, *, kept: bool = False) -> DataFrame:
    """``n`` rows drawn by hash order; ranked in parts, so that a large sample needs no single task.

    ``kept``: the rows are read from a stored table, so that they are not stored again with their hashes.
    """
    order = [seeded_hash(keys, seed), *[F.col(k) for k in keys]]
    return _first_rows(df, order, n, kept)


def _first_rows(df: DataFrame, order: list[Column], n: int, kept: bool = False) -> DataFrame:
    """The first ``n`` rows of an order whose first column is a hash.

    A histogram of hash prefixes finds the bucket in which the ``n``-th row lies; the buckets
    before it are taken whole, and only the rows of that bucket are ranked.
    """
    drawn = df.withColumn("_draw", order[0])
    drawn = drawn if kept else cut_lineage(drawn)
    bucket = F.shiftright("_draw", HASH_BITS - _BUCKET_BITS)
    histogram = drawn.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_bucket"))
    edge = histogram.withColumn("_upto", upto).where((F.col("_upto") >= n) & (F.col("_upto") - F.col("_n") < n)).first()
    if edge is None:
        return drawn.drop("_draw") if n > 0 else drawn.drop("_draw").limit(0)
    left = n - (edge["_upto"] - edge["_n"])
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_draw", *order[1:]))
    last = drawn.withColumn("_b", bucket).where(F.col("_b") == edge["_bucket"]).withColumn("_rank", rank)
    whole = drawn.where(bucket < edge["_bucket"])
    return whole.select(*df.columns).unionByName(last.where(F.col("_rank") <= left).select(*df.columns))


def hash_split(df: DataFrame, keys: list[str], weights: Sequence[float], seed: int) -> DataFrame:
    """Adds ``split``, the index of the part a key falls in; a key never changes sides."""
    total = sum(weights)
    draw = seeded_hash(keys, seed, "split")
    split = F.lit(len(weights) - 1)
    bound = total
    for index in range(len(weights) - 2, -1, -1):
        bound -= weights[index + 1]
        split = F.when(draw < int(bound / total * HASH_RANGE), F.lit(index)).otherwise(split)
    return df.withColumn("split", split)


def train_test_split(
    df: DataFrame, keys: list[str], weights: Sequence[float], seed: int
) -> tuple[DataFrame, DataFrame]:
    parts = hash_split(df, keys, weights, seed)
    return parts.where("split = 0").drop("split"), parts.where("split = 1").drop("split")


def hash_folds(df: DataFrame, keys: list[str], n_folds: int, seed: int) -> DataFrame:
    """Adds ``fold``, from 0 to ``n_folds - 1``."""
    return df.withColumn("fold", (seeded_hash(keys, seed, "fold") % n_folds).cast("int"))


def union_labelled(true_pairs: DataFrame, false_pairs: DataFrame) -> DataFrame:
    """Both classes in one table, labelled 1.0 and 0.0."""
    return true_pairs.withColumn("label", F.lit(1.0)).unionByName(false_pairs.withColumn("label", F.lit(0.0)))


def balance_classes(df: DataFrame, label: str, keys: list[str], seed: int) -> DataFrame:
    """All rows of the smallest class and equally many, drawn by hash, of every other.

    Rows without a label belong to no class and are left out. Rows are unique by ``keys``
    within a class. The draw is exact without ranking a
    whole class in one task: a histogram of hash prefixes (2**16 buckets per class) finds
    the bucket in which each class reaches its quota, the buckets before it are kept
    whole, and only the rows of that one bucket are ranked.
    """
    prefix = F.shiftright(F.col("_draw"), HASH_BITS - _BUCKET_BITS)
    drawn = cut_lineage(
        df.where(F.col(label).isNotNull()).withColumn("_draw", seeded_hash(keys, seed, "balance")).withColumn("_bucket", prefix.cast("int"))
    )
    histogram = drawn.groupBy(label, "_bucket").agg(F.count("*").alias("_n"))
    by_class = Window.partitionBy(label).orderBy("_bucket")
    quota = drawn.groupBy(label).agg(F.count("*").alias("_size")).agg(F.min("_size")).first()[0] or 0
    edges = (
        histogram.withColumn("_upto", F.sum("_n").over(by_class))
        .where((F.col("_upto") >= quota) & (F.col("_upto") - F.col("_n") < quota))
        .select(label, F.col("_bucket").alias("_edge"), (quota - (F.col("_upto") - F.col("_n"))).alias("_left"))
    )
    placed = drawn.join(F.broadcast(edges), label)  # one row per class
    order = Window.partitionBy(label).orderBy("_draw", *keys)
    whole = placed.where(F.col("_bucket") < F.col("_edge"))
    partial = (
        placed.where(F.col("_bucket") == F.col("_edge"))
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= F.col("_left"))
    )
    return whole.select(*df.columns).unionByName(partial.select(*df.columns))
