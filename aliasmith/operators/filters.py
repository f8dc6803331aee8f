"""Row and list filters, all as native predicates that Catalyst can push down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aliasmith.functions.binding import bind
from aliasmith.functions.text import LIST_SEPARATOR, has_both_parts, is_valid_name

# Bounds of the similarity bands and the mark of a legal entity.
BAND_BOUNDS = (0.0, 0.3, 0.7, 1.0)
LEGAL_ENTITY = "e"


def keep_categories(df: DataFrame, column: str, wanted: Sequence[str] | DataFrame) -> DataFrame:
    """Rows whose category is wanted; a long list comes as a DataFrame and is semi joined."""
    if isinstance(wanted, DataFrame):
        return df.join(wanted.select(F.col(wanted.columns[0]).alias(column)), column, "left_semi")
    return df.where(F.col(column).isin(list(wanted)))


def keep_natural_persons(df: DataFrame, column: str = "person_type") -> DataFrame:
    """Rows not marked as a legal entity, without the mark; an unknown mark is dropped too."""
    return df.where(F.col(column) != LEGAL_ENTITY).drop(column)


def drop_short_aliases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """In ``;``-lists keep only names with both parts; the columns move to the end."""
    kept = [
        F.array_join(F.filter(F.split(F.col(c), LIST_SEPARATOR), has_both_parts), LIST_SEPARATOR).alias(c)
        for c in columns
    ]
    return df.select(*[c for c in df.columns if c not in columns], *kept)


def valid_names(df: DataFrame, column: str = "name") -> DataFrame:
    return df.where(is_valid_name(F.col(column)))


def multiword_aliases(df: DataFrame, column: str = "aliases") -> DataFrame:
    """Keep aliases of two words or more, and entities that still have one."""
    kept = F.filter(F.col(column), lambda a: F.size(F.split(F.rtrim(a), " ")) > 1)
    return df.withColumn(column, kept).where(F.size(column) > 0)


def similarity_band(similarity: Column, bounds: Sequence[float] = BAND_BOUNDS) -> Column:
    """Number of the half-open band a similarity lies in, from 1; the last band is closed."""
    last = len(bounds) - 1

    def number_of(value: Column) -> Column:
        band = F.when((value >= bounds[last - 1]) & (value <= bounds[last]), last)
        for number in range(1, last):
            band = band.when((value >= bounds[number - 1]) & (value < bounds[number]), number)
        return band

    return bind(similarity, number_of)


def in_band(similarity: Column, number: int, bounds: Sequence[float] = BAND_BOUNDS) -> Column:
    return similarity_band(similarity, bounds) == number
