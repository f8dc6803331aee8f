"""Ideal code lengths of texts under the symbol frequencies of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aliasmith.session import cut_lineage


def code_lengths(texts: DataFrame, column: str) -> DataFrame:
    """``(column, bits)``: per distinct text the sum of ``-log2`` of its symbols' shares.

    Shares are taken over the distinct texts. Symbols are ASCII, so the table of their
    shares has at most 128 rows and is broadcast.
    """
    symbol = F.explode(F.regexp_extract_all(F.col(column), F.lit(r"(?s)[\x00-\x7F]"), F.lit(0))).alias("symbol")
    distinct = cut_lineage(texts.select(column).distinct())
    placed = distinct.select(column, symbol).groupBy(column, "symbol").agg(F.count("*").alias("n"))
    counts = placed.groupBy("symbol").agg(F.sum("n").alias("total"))
    share = F.col("total") / F.sum("total").over(Window.partitionBy(F.lit(0)))
    bits = counts.select("symbol", (-F.log2(share)).alias("bits"))
    lengths = placed.join(F.broadcast(bits), "symbol").groupBy(column).agg(F.sum(F.col("n") * F.col("bits")).alias("bits"))
    return distinct.join(lengths, column, "left").select(column, F.coalesce("bits", F.lit(0.0)).alias("bits"))


def code_length_difference(pairs: DataFrame) -> DataFrame:
    """``pairs`` of ``string1`` and ``string2`` with the difference of their code lengths."""
    both = pairs.select(F.explode(F.array("string1", "string2")).alias("text"))
    bits = code_lengths(both, "text")
    one = bits.withColumnsRenamed({"text": "string1", "bits": "_bits1"})
    two = bits.withColumnsRenamed({"text": "string2", "bits": "_bits2"})
    joined = pairs.join(one, "string1").join(two, "string2")
    return joined.select(*pairs.columns, F.abs(F.col("_bits1") - F.col("_bits2")).alias("code_length_diff"))
