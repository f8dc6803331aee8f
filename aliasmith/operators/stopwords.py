"""Removal of stopwords by exact token."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aliasmith.session import stored

# Short words that are always removed.
SHORT_WORDS = ("di", "ou", "for", "de", "in", "der", "vyi", "gen", "capo", "i", "del")


def remove_stopwords(df: DataFrame, column: str, stopwords: DataFrame | Iterable[str]) -> DataFrame:
    """``df`` with stopwords and short words removed from the space-separated ``column``.

    A sequence of words travels inside the expression and no row moves. A table, with its words
    in the first column, is anti joined with the tokens, whatever its size. Both give the same
    texts: words are trimmed, empty ones are no stopwords, and every space that is not next to
    a removed token stays.
    """
    if isinstance(stopwords, DataFrame):
        return _removed_by_join(df, column, stopwords)
    stop = sorted({w.strip(" ") for w in stopwords if w} - {""} | set(SHORT_WORDS))

    def kept(token: Column) -> Column:
        return ~token.isin(stop)

    return df.withColumn(column, F.array_join(F.filter(F.split(F.col(column), " "), kept), " "))


def _removed_by_join(df: DataFrame, column: str, stopwords: DataFrame) -> DataFrame:
    """Rows get a number of their own, which is stored before they are taken apart."""
    words = stopwords.select(F.trim(F.col(stopwords.columns[0])).alias("_token"))
    short = df.sparkSession.createDataFrame([(w,) for w in SHORT_WORDS], "_token string")
    stop = words.where(F.col("_token") != "").union(short).distinct()
    rows = stored(df.withColumn("_row", F.monotonically_increasing_id()), "texts")
    placed = rows.select("_row", F.posexplode(F.split(F.col(column), " ")).alias("_pos", "_token"))
    left = (
        placed.join(stop, "_token", "left_anti")
        .groupBy("_row")
        .agg(F.sort_array(F.collect_list(F.struct("_pos", "_token"))).alias("_found"))
        .select("_row", F.array_join(F.col("_found._token"), " ").alias("_kept"))
    )
    text = F.when(F.col(column).isNotNull(), F.coalesce(F.col("_kept"), F.lit("")))
    return rows.join(left, "_row", "left").withColumn(column, text).select(*df.columns)
