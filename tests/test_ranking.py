import math
import random

import pytest
from pyspark.sql import functions as F

from aliasmith.operators import datasets, evaluate, ranking


def test_running_totals_over_many_buckets(spark):
    draws = random.Random(2)
    values = sorted({draws.expovariate(1.0) for _ in range(500)})
    df = spark.createDataFrame([(v, i % 7) for i, v in enumerate(values)], "v double, n long").repartition(5)
    found = {r.v: r.n_upto for r in ranking.running_totals(df, "v", ["n"], rows_per_range=20).collect()}
    total, expected = 0, {}
    for i, v in enumerate(values):
        total += i % 7
        expected[v] = total
    assert found == expected


def test_exact_quantiles_with_a_value_that_holds_a_third(spark):
    values = [5.0] * 100 + [float(v) for v in range(200)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    shares = [0.1, 0.25, 0.5, 0.9, 1.0]
    ordered = sorted(values)
    assert ranking.exact_quantiles(df, "v", shares) == [ordered[math.ceil(p * 300) - 1] for p in shares]


def test_exact_quantiles_of_nothing(spark):
    assert ranking.exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == []


def test_discretize_exact_makes_equal_bins(spark):
    df = spark.range(1000).select((F.col("id") * 2).alias("v"))
    sizes = datasets.discretize_exact(df, "v", "bin", 4).groupBy("bin").count().collect()
    assert {r.bin for r in sizes} == {0.0, 1.0, 2.0, 3.0}
    assert all(abs(r["count"] - 250) <= 1 for r in sizes)


def test_discretize_approximate(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert datasets.discretize(df, "v", "bin", 5).select("bin").distinct().count() == 5


def test_bucketize_skips_invalid_values(spark):
    df = spark.createDataFrame([(0.0,), (9.9,), (10.0,), (20.0,), (20.1,), (-1.0,), (float("nan"),), (None,)], "v double")
    found = [tuple(r) for r in datasets.bucketize(df, [0.0, 10.0, 20.0], "v", "b").collect()]
    assert found == [(0.0, 0.0), (9.9, 0.0), (10.0, 1.0), (20.0, 1.0)]


def test_auc_scored_counts_ties_half(spark):
    draws = random.Random(3)
    rows = [(draws.randint(0, 1) * 1.0, draws.randint(0, 9) * 1.0) for _ in range(300)]
    df = spark.createDataFrame(rows, "label double, score double")
    pos, neg = [s for l, s in rows if l], [s for l, s in rows if not l]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert evaluate.auc_scored(df).first().auc == pytest.approx(wins / (len(pos) * len(neg)))


def test_awkward_numbers_have_defined_results(spark):
    inf, nan = float("inf"), float("nan")
    values = [nan, None, inf, -inf, 1.0, 2.0, 3.0, 4.0, inf]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = {r.v: r.b for r in datasets.discretize_exact(df, "v", "b", 2).collect()}
    assert found == {-inf: 0.0, 1.0: 0.0, 2.0: 0.0, 3.0: 1.0, 4.0: 1.0, inf: 1.0}
    rows = [(1.0, inf), (1.0, 5.0), (0.0, 4.0), (0.0, -inf), (1.0, None), (0.0, nan), (None, 9.0)]
    scored = spark.createDataFrame(rows, "label double, score double")
    pos, neg = [inf, 5.0, -inf], [4.0, -inf, -inf]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert evaluate.auc_scored(scored).first().auc == pytest.approx(wins / 9)


def test_hard_label_metrics(spark):
    rows = [(1.0, 1.0)] * 3 + [(1.0, 0.0)] + [(0.0, 0.0)] * 4 + [(0.0, 1.0)] * 2
    df = spark.createDataFrame(rows, "label double, prediction double")
    assert evaluate.auc_hard_labels(df).first().auc == pytest.approx((3 / 4 + 4 / 6) / 2)
    assert evaluate.accuracy(df).first().accuracy == pytest.approx(0.7)
    counts = {(r.label, r.prediction): r["count"] for r in evaluate.confusion_matrix(df).collect()}
    assert counts == {(1.0, 1.0): 3, (1.0, 0.0): 1, (0.0, 0.0): 4, (0.0, 1.0): 2}


def test_row_numbers_follow_the_order_and_are_read_without_a_shuffle_of_rows(spark):
    df = spark.range(5000).select(F.sha1(F.col("id").cast("string")).alias("v"), "id").repartition(7)
    found = ranking.row_numbers(df, "v", 5000, "row", rows_per_range=400)
    rows = found.collect()
    assert [r.v for r in sorted(rows, key=lambda r: r.row)] == sorted(r.v for r in rows)
    assert sorted(r.row for r in rows) == list(range(5000)) and found.columns == ["v", "id", "row"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "monotonically" not in plan
    assert ranking.row_numbers(df.limit(0), "v", 0, "row").collect() == []
