"""Column-shape operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def leaf_columns(schema: StructType, prefix: str = "") -> list[Column]:
    """Every leaf of a nested schema, aliased by its full path joined with ``_``."""
    leaves: list[Column] = []
    for field in schema.fields:
        path = f"{prefix}`{field.name}`"
        if isinstance(field.dataType, StructType):
            leaves += leaf_columns(field.dataType, f"{path}.")
        else:
            leaves.append(F.col(path).alias(path.replace("`", "").replace(".", "_")))
    return leaves


def flatten_struct(df: DataFrame) -> DataFrame:
    return df.select(*leaf_columns(df.schema))


def feature_names(df: DataFrame, label: str, ignored: Iterable[str]) -> list[str]:
    """The columns that are features: neither ignored nor the label."""
    skipped = {label, *ignored}
    return [c for c in df.columns if c not in skipped]


def cast_features(df: DataFrame, label: str, ignored: Iterable[str] = ()) -> DataFrame:
    """Features and label as doubles in one projection; unreadable values become null."""
    numeric = {label, *feature_names(df, label, ignored)}
    return df.select(
        *[F.col(c).try_cast("double").alias(c) if c in numeric else F.col(c) for c in df.columns]
    )


def unreadable_counts(df: DataFrame, label: str, ignored: Iterable[str] = ()) -> DataFrame:
    """One row: per feature and label, the values that are present but not numeric."""
    numeric = [c for c in df.columns if c == label or c in feature_names(df, label, ignored)]
    bad = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in numeric]
    return df.agg(*bad)
