"""Metrics as single aggregations, and evaluation of feature subsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.base import Estimator, Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aliasmith.operators.datasets import FEATURES_COLUMN, LABEL_COLUMN, slice_features
from aliasmith.operators.models import build_model, save_model
from aliasmith.operators.ranking import running_totals
from aliasmith.session import cut_lineage


def confusion_matrix(df: DataFrame, label: str = LABEL_COLUMN, prediction: str = "prediction") -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count("*").alias("count"))


def accuracy(df: DataFrame, label: str = LABEL_COLUMN, prediction: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def auc_hard_labels(df: DataFrame, label: str = LABEL_COLUMN, prediction: str = "prediction") -> DataFrame:
    """Area under ROC when the 0/1 prediction is the score: the mean of both hit rates."""
    hit = (F.col(label) == F.col(prediction)).cast("double")
    rates = df.agg(
        F.avg(F.when(F.col(label) == 1, hit)).alias("tpr"), F.avg(F.when(F.col(label) == 0, hit)).alias("tnr")
    )
    return rates.select(((F.col("tpr") + F.col("tnr")) / 2).alias("auc"))


def auc_scored(df: DataFrame, label: str = LABEL_COLUMN, score: str = "score") -> DataFrame:
    """Area under ROC of a score, ties counting half.

    Rows are first counted per score, so equal scores cost one row however many they are. A
    row without a score, null or NaN, counts as scored lowest. Rows without a label are left out.
    """
    value = F.col(score).cast("double")
    known = F.when(value.isNull() | F.isnan(value), F.lit(float("-inf"))).otherwise(value)
    positive = (F.col(label) == 1).cast("bigint")
    by_score = cut_lineage(
        df.where(F.col(label).isNotNull()).groupBy(known.alias("score")).agg(
            F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
        )
    )
    ranked = running_totals(by_score, "score", ["neg"])
    beaten = F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2)
    return ranked.agg((F.sum(beaten) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def evaluate_setup(
    train: DataFrame, test: DataFrame, stages: Sequence[Estimator | Transformer], destination: str | None = None
) -> float:
    """Train on one table, save if asked, and give the hard-label area under ROC on the other.

    Not a number where the test table lacks a class.
    """
    model = build_model(train, stages)
    if destination is not None:
        save_model(model, destination)
    score = auc_hard_labels(model.transform(test)).first()["auc"]
    return float("nan") if score is None else score


def evaluate_features(
    train: DataFrame, test: DataFrame, stages: Sequence[Estimator | Transformer], names: Sequence[str], alone: bool
) -> DataFrame:
    """Area under ROC with each feature alone, or with each one left out."""
    train, test = (cut_lineage(d.select(LABEL_COLUMN, FEATURES_COLUMN)) for d in (train, test))
    rows = []
    for index, name in enumerate(names):
        chosen = [index] if alone else [i for i in range(len(names)) if i != index]
        score = evaluate_setup(slice_features(train, chosen), slice_features(test, chosen), stages)
        rows.append((name, float(score)))
    return train.sparkSession.createDataFrame(rows, "feature string, auc double")
