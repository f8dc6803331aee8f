import random

import pytest

from aliasmith.operators import datasets

SHARES = [i / 20 for i in range(1, 20)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    values = [rng.gauss(0, 1) for _ in range(40_000)] + [1.5] * 20_000 + [None, float("nan")]
    return spark.createDataFrame([(i % 7, v) for i, v in enumerate(values)], "part int, value double").repartition(16).cache()


def test_merged_sketches_keep_ranks(rows):
    sketches = datasets.quantile_sketches(rows, "value", ["part"])
    assert sketches.count() == 7
    edges = datasets.sketch_quantiles(sketches, SHARES)
    assert edges == sorted(edges)
    errors = datasets.rank_errors(rows, "value", edges, SHARES).collect()
    assert [r.n for r in errors] == [60_000] * len(SHARES)
    assert max(r.error for r in errors) < 0.005


def test_later_rows_are_merged_into_stored_sketches(spark, rows, tmp_path):
    path = str(tmp_path / "sketches")
    for first, last in ((0, 3), (4, 6)):
        part = rows.where(rows.part.between(first, last))
        datasets.quantile_sketches(part, "value").write.mode("append").parquet(path)
    edges = datasets.sketch_quantiles(spark.read.parquet(path), SHARES)
    assert max(r.error for r in datasets.rank_errors(rows, "value", edges, SHARES).collect()) < 0.005


def test_bins_from_sketches(rows):
    values = rows.where("value is null or value < 1.5")
    binned = datasets.discretize_by_sketch(values, datasets.quantile_sketches(values, "value"), "value", "bin", 4)
    sizes = {r.bin: r["count"] for r in binned.groupBy("bin").count().collect()}
    total = sum(sizes.values())
    assert set(sizes) == {0.0, 1.0, 2.0, 3.0} and all(abs(n / total - 0.25) < 0.01 for n in sizes.values())
    assert total == values.where("value is not null and not isnan(value)").count()


def test_rank_errors_count_both_sides_of_repeated_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "value double")
    errors = [r.error for r in datasets.rank_errors(df, "value", [2.0, 3.0, 1.0], [0.5, 0.5, 0.5]).collect()]
    assert errors == [0.0, 0.25, 0.25]


def test_a_table_without_values_has_no_edges(spark):
    empty = spark.createDataFrame([(None,), (float("nan"),)], "value double")
    sketches = datasets.quantile_sketches(empty, "value")
    assert datasets.sketch_quantiles(sketches, SHARES) == []
    assert datasets.sketch_quantiles(sketches.limit(0), SHARES) == []
    assert datasets.discretize_by_sketch(empty, sketches, "value", "bin", 4).count() == 0
