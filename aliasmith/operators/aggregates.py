"""Counts over tokens, categories and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case words, commas read as spaces, empty words dropped."""
    return F.filter(F.split(F.lower(F.translate(text, ",", " ")), " "), lambda t: t != "")


def token_counts(df: DataFrame, column: str) -> DataFrame:
    words = df.select(F.explode(tokens(F.col(column))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("count"))


def token_frequency(df: DataFrame, column: str) -> DataFrame:
    """Tokens by falling frequency, then alphabetically."""
    return token_counts(df, column).orderBy(F.desc("count"), "token")


def most_frequent_tokens(df: DataFrame, column: str, n: int) -> DataFrame:
    """A top-n report of tokens; sorts only the n rows it keeps."""
    return token_frequency(df, column).limit(n)


def category_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column)


def candidate_counts(queries: DataFrame, aliases: DataFrame, block: str) -> DataFrame:
    """Per block, the pairs a full comparison would score; counted without forming them."""
    asked = queries.groupBy(block).agg(F.count("*").alias("n_queries"))
    offered = aliases.groupBy(block).agg(F.count("*").alias("n_candidates"))
    return asked.join(offered, block).withColumn("n_pairs", F.col("n_queries") * F.col("n_candidates"))
