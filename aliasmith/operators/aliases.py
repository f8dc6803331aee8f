"""Alias lists: reading them from lines, and flattening them to one row per name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aliasmith.functions.text import LIST_SEPARATOR, clean_text

# The four name lists of a watch-list row, in their order of trust.
NAME_LISTS = ("name", "aliases", "low_quality_aliases", "alternative_spelling")


def split_alias_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """One array of aliases per ``|``-separated line."""
    return lines.withColumn("aliases", F.split(F.col(column), r"\x7C")).drop(column)


def explode_aliases(watch_list: DataFrame) -> DataFrame:
    """One row per name in any of the four lists, tagged with the list it came from."""

    def tagged(column: str) -> Column:
        items = F.split(F.col(column), LIST_SEPARATOR)
        return F.coalesce(
            F.transform(items, lambda item: F.struct(F.lit(column).alias("kind"), item.alias("name"))),
            F.array().cast("array<struct<kind:string,name:string>>"),
        )

    found = F.explode(F.concat(*[tagged(c) for c in NAME_LISTS])).alias("found")
    return watch_list.select("uid", "citizenship", "person_type", found).select(
        "uid", "citizenship", "person_type", "found.kind", "found.name"
    )


def clean_table(df: DataFrame) -> DataFrame:
    """Every column of text, or of arrays of text, cleaned in a single projection."""

    def cleaned(column: str, kind: str) -> Column:
        if kind == "string":
            return clean_text(F.col(column)).alias(column)
        if kind == "array<string>":
            return F.transform(F.col(column), clean_text).alias(column)
        return F.col(column)

    return df.select(*[cleaned(c, t) for c, t in df.dtypes])
