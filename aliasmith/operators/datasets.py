"""Feature vectors and binning for Spark ML."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.feature import Bucketizer, QuantileDiscretizer, VectorAssembler, VectorSlicer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aliasmith.operators.projections import cast_features, feature_names
from aliasmith.operators.ranking import exact_quantiles

FEATURES_COLUMN = "features"
LABEL_COLUMN = "label"
# Values kept at the top level of a sketch: a rank is then off by less than 0.002 with 99 percent chance.
SKETCH_SIZE = 4096


def assemble_features(
    df: DataFrame,
    label: str = LABEL_COLUMN,
    ignored: Iterable[str] = (),
    invalid: str = "skip",
    keep_ignored: bool = True,
) -> DataFrame:
    """One ``features`` vector from all columns but the label and the ignored ones.

    ``invalid`` says what happens to rows with a missing feature: skip, keep or error.
    """
    ignored = list(ignored)
    features = feature_names(df, label, ignored)
    numeric = cast_features(df, label, ignored)
    if label in df.columns and invalid == "skip":
        numeric = numeric.where(F.col(label).isNotNull())
    vectors = VectorAssembler(inputCols=features, outputCol=FEATURES_COLUMN, handleInvalid=invalid).transform(numeric)
    return vectors.drop(*features, *([] if keep_ignored else ignored))


def slice_features(df: DataFrame, indices: Sequence[int], column: str = FEATURES_COLUMN) -> DataFrame:
    """``column`` reduced to the given positions."""
    slicer = VectorSlicer(inputCol="_all", outputCol=column, indices=list(indices))
    return slicer.transform(df.withColumnRenamed(column, "_all")).drop("_all")


def discretize(df: DataFrame, column: str, output: str, n_bins: int, relative_error: float = 0.001) -> DataFrame:
    """Bins of about equal size from approximate quantiles; the choice for very large data."""
    binner = QuantileDiscretizer(inputCol=column, outputCol=output, numBuckets=n_bins, relativeError=relative_error)
    return binner.fit(df).transform(df)


def quantile_sketches(df: DataFrame, column: str, keys: Sequence[str] = (), size: int = SKETCH_SIZE) -> DataFrame:
    """``(*keys, sketch)``: a KLL sketch of the values of each group, made in tasks and merged.

    Sketches are binary values of a few times ``size`` numbers. They can be stored, and merged
    with those of later rows. Rows whose value is missing or NaN are skipped.
    """
    value = F.col(column).cast("double")
    usable = df.where(value.isNotNull() & ~F.isnan(value))
    return usable.groupBy(*keys).agg(F.kll_sketch_agg_double(value, F.lit(size)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, probabilities: Sequence[float]) -> list[float]:
    """Quantiles of all rows behind stored sketches, which are merged; none where there are no rows."""
    merged = sketches.agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    merged = merged.where(F.col("sketch").isNotNull() & (F.kll_sketch_get_n_double("sketch") > 0))
    ranks = F.array(*[F.lit(float(p)) for p in probabilities])
    rows = merged.select(F.kll_sketch_get_quantile_double("sketch", ranks)).collect()
    return list(rows[0][0]) if rows else []


def discretize_by_sketch(df: DataFrame, sketches: DataFrame, column: str, output: str, n_bins: int) -> DataFrame:
    """Bins of about equal size bounded by the quantiles of stored sketches; rows as in ``discretize_exact``."""
    return _binned(df, column, output, sketch_quantiles(sketches, [i / n_bins for i in range(1, n_bins)]))


def rank_errors(df: DataFrame, column: str, edges: Sequence[float], probabilities: Sequence[float]) -> DataFrame:
    """``(probability, edge, n, error)``: how far each edge is from its place among all values, as a share of them.

    A value that repeats has all places from its first to its last; the error is to the nearest.
    """
    value = F.col(column).cast("double")
    usable = df.where(value.isNotNull() & ~F.isnan(value))
    counts = [
        F.struct(
            F.lit(float(p)).alias("probability"),
            F.lit(float(edge)).alias("edge"),
            F.count_if(value < edge).alias("below"),
            F.count_if(value <= edge).alias("upto"),
        )
        for p, edge in zip(probabilities, edges, strict=True)
    ]
    rows = usable.agg(F.count("*").alias("n"), F.array(*counts).alias("edges")).select("n", F.inline("edges"))
    place = F.col("probability") * F.col("n")
    error = F.greatest(F.col("below") - place, place - F.col("upto"), F.lit(0.0)) / F.col("n")
    return rows.select("probability", "edge", "n", error.alias("error"))


def discretize_exact(df: DataFrame, column: str, output: str, n_bins: int) -> DataFrame:
    """Bins bounded by exact quantiles; rows whose value is missing or NaN are skipped, infinite ones are not."""
    return _binned(df, column, output, exact_quantiles(df, column, [i / n_bins for i in range(1, n_bins)]))


def _binned(df: DataFrame, column: str, output: str, edges: Iterable[float]) -> DataFrame:
    inner = sorted(set(edges))
    value = F.col(column).cast("double")
    reached = F.filter(F.array(*map(F.lit, inner)).cast("array<double>"), lambda edge: edge <= value)
    kept = df.where(value.isNotNull() & ~F.isnan(value))
    return kept.withColumn(output, F.size(reached).cast("double"))


def bucketize(df: DataFrame, splits: Sequence[float], column: str, output: str) -> DataFrame:
    """Bins by fixed splits; rows with a missing value or one outside the splits are skipped."""
    value = F.col(column).cast("double")
    inside = df.where(value.between(float(splits[0]), float(splits[-1])) & ~F.isnan(value))
    binner = Bucketizer(splits=list(splits), inputCol=column, outputCol=output, handleInvalid="skip")
    return binner.transform(inside)
