"""Running totals and order statistics without sorting a table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aliasmith.session import cut_lineage, stored

ROWS_PER_RANGE = 1_000_000


def running_totals(
    df: DataFrame, order: str, totals: Sequence[str], rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Adds ``<total>_upto``: each total summed over all rows up to this one by ``order``.

    ``df`` has one row per value of ``order``. Rows are dealt into ranges of the order, as
    many as their number asks for; each range is summed on its own, and the sums of the ranges
    before it, one row per range, are added. Infinite values and NaN, the greatest, are
    ordinary values here.
    """
    n_ranges = max(df.count() // rows_per_range, 8)
    dealt = stored(df.repartitionByRange(n_ranges, order).withColumn("_range", F.spark_partition_id()), "ranges")
    per_range = dealt.groupBy("_range").agg(*[F.sum(t).alias(t) for t in totals])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = per_range.select(
        "_range", *[F.coalesce(F.sum(t).over(earlier), F.lit(0)).alias(f"_{t}_before") for t in totals]
    )
    inside = Window.partitionBy("_range").orderBy(order)
    return dealt.join(before, "_range").select(
        *df.columns, *[(F.sum(t).over(inside) + F.col(f"_{t}_before")).alias(f"{t}_upto") for t in totals]
    )


def row_numbers(df: DataFrame, order: str, n_rows: int, name: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """The rows with their numbers from 0 by ``order``, of which ``df`` has one row per value; stored.

    Rows are dealt into ranges of the order and numbered where they are sorted, so that they are
    shuffled and stored once; the rows of the ranges before are added when they are read.
    """
    n_ranges = max(n_rows // rows_per_range, 8)
    inside = df.repartitionByRange(n_ranges, order).sortWithinPartitions(order).withColumn("_place", F.monotonically_increasing_id())
    dealt = stored(inside, "ranges")
    # Spark puts the number of the partition before the lower 33 bits, which number its rows from 0.
    dealt = dealt.withColumns({"_range": F.shiftright("_place", 33), "_place": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))})
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(before), "_range").select(*df.columns, (F.col("_place") + F.col("_before")).alias(name))


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> list[float]:
    """The smallest values that at least the given shares of rows do not exceed; null and NaN are no values."""
    value = F.col(column).cast("double")
    values = cut_lineage(
        df.where(value.isNotNull() & ~F.isnan(value)).groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    )
    total = values.agg(F.sum("n")).first()[0] or 0
    if not total:
        return []
    ranked = running_totals(values, "value", ["n"])
    least: list[Column] = [
        F.min(F.when(F.col("n_upto") >= p * total, F.col("value"))).alias(str(i))
        for i, p in enumerate(probabilities)
    ]
    return list(ranked.agg(*least).first())
