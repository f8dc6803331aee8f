import hashlib
import random

import pytest
from pyspark.sql import functions as F

from aliasmith.operators import sampling, skew


def draw(text, seed):
    return int(hashlib.md5(f"{text}|{seed}".encode()).hexdigest()[:15], 16)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1000).select(F.col("id").cast("string").alias("k"))


def test_seeded_shuffle_is_ordered_by_hash(rows):
    found = [r.k for r in sampling.seeded_shuffle(rows.repartition(7), ["k"], 5).collect()]
    assert found == sorted((str(i) for i in range(1000)), key=lambda k: (draw(k, 5), k))


def test_seeded_sample_ignores_partitioning(rows):
    one = {r.k for r in sampling.seeded_sample(rows, ["k"], 20, 5).collect()}
    two = {r.k for r in sampling.seeded_sample(rows.repartition(9), ["k"], 20, 5).collect()}
    assert one == two == set(sorted((str(i) for i in range(1000)), key=lambda k: (draw(k, 5), k))[:20])


def test_hash_split_is_disjoint_complete_and_by_weight(rows):
    sizes = {r.split: r.n for r in sampling.hash_split(rows, ["k"], [0.5, 0.3, 0.2], 1).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == 1000
    assert sizes[0] == pytest.approx(500, abs=60) and sizes[2] == pytest.approx(200, abs=60)
    train, test = sampling.train_test_split(rows, ["k"], [7, 3], 1)
    assert train.count() + test.count() == 1000 and train.join(test, "k").count() == 0


def test_hash_folds_cover_all_rows(rows):
    sizes = sampling.hash_folds(rows, ["k"], 4, 1).groupBy("fold").count().collect()
    assert {r.fold for r in sizes} == {0, 1, 2, 3} and sum(r["count"] for r in sizes) == 1000


@pytest.mark.parametrize(("n_true", "n_false"), [(30, 500), (500, 30), (40, 40), (0, 10)])
def test_balance_keeps_the_smaller_class_whole(spark, n_true, n_false):
    rows = [(f"t{i}", 1.0) for i in range(n_true)] + [(f"f{i}", 0.0) for i in range(n_false)]
    df = spark.createDataFrame(rows, "k string, label double")
    found = sampling.balance_classes(df, "label", ["k"], 3).collect()
    quota = min(n for n in (n_true, n_false) if n)
    expected = {
        k
        for mark in "tf"
        for k in sorted((k for k, _ in rows if k[0] == mark), key=lambda k: (draw(k, "3balance"), k))[:quota]
    }
    assert {r.k for r in found} == expected and len(found) == len(expected)


def test_union_labelled(spark):
    a, b = spark.createDataFrame([("x",)], "k string"), spark.createDataFrame([("y",)], "k string")
    assert sorted(tuple(r) for r in sampling.union_labelled(a, b).collect()) == [("x", 1.0), ("y", 0.0)]


def test_salted_join_equals_plain_join_when_one_key_is_hot(spark):
    draws = random.Random(1)
    many = [("hot" if i % 3 else str(draws.randint(0, 30)), i) for i in range(3000)] + [(None, -1)]
    few = [("hot", "a"), ("hot", "b"), *[(str(i), "c") for i in range(40)], (None, "n")]
    left, right = spark.createDataFrame(many, "k string, i int"), spark.createDataFrame(few, "k string, v string")
    salted = skew.salted_join(left, right, ["k"], pairs_per_split=100)
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, left.join(right, "k").collect()))


def test_salted_join_splits_by_the_pairs_a_key_forms(spark):
    many = spark.range(2000).select(F.lit("hot").alias("k"), F.col("id").alias("i"))
    few = spark.range(500).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    salted = skew.salted_join(many, few, ["k"], pairs_per_split=100_000)
    assert salted.count() == 1_000_000
    per_task = salted.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 2 and max(r["count"] for r in per_task) < 700_000


def test_balance_leaves_out_rows_without_a_label(spark):
    rows = [(1.0, "a"), (1.0, "b"), (0.0, "c"), (0.0, "d"), (None, "e")]
    found = sampling.balance_classes(spark.createDataFrame(rows, "label double, k string"), "label", ["k"], 1).collect()
    assert sorted((r.label, r.k) for r in found) == [(0.0, "c"), (0.0, "d"), (1.0, "a"), (1.0, "b")]


@pytest.mark.parametrize("n", [0, 1, 500, 999, 1000, 2000])
def test_a_sample_of_any_size_is_the_first_by_hash(spark, n):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k")).repartition(4)
    found = {r.k for r in sampling.seeded_sample(df, ["k"], n, 7).collect()}
    assert found == set(sorted(map(str, range(1000)), key=lambda k: (draw(k, 7), k))[:n])


def test_top_n_per_group(spark):
    rows = [(g, i * 37 % 1009) for g in ("a", "b") for i in range(1000)] + [("c", 1)]
    df = spark.createDataFrame(rows, "g string, v int")
    found = skew.top_n_per_group(df, ["g"], [F.col("v")], 5).collect()
    expected = {(g, v) for g in "abc" for v in sorted(v for k, v in rows if k == g)[:5]}
    assert {tuple(r) for r in found} == expected and len(found) == 11


def test_a_join_has_as_many_tasks_as_its_pairs_ask_for(spark, monkeypatch):
    """Small tables of many pairs: by their bytes the planner would take one task."""
    monkeypatch.setattr(skew, "PAIRS_PER_TASK", 1000)
    left = spark.range(300).select((F.col("id") % 10).alias("k"), F.col("id").alias("a"))
    right = left.select("k", F.col("a").alias("b"))
    for split in (1_000_000, 100):
        joined = skew.salted_join(left, right, ["k"], pairs_per_split=split)
        assert joined.rdd.getNumPartitions() == 9
        assert joined.count() == 9000


def test_a_sample_of_a_stored_table_stores_nothing(spark, rows, monkeypatch):
    wanted = {r.k for r in sampling.seeded_sample(rows, ["k"], 20, 5).collect()}
    monkeypatch.setattr(sampling, "cut_lineage", lambda df: pytest.fail("stored again"))
    assert {r.k for r in sampling.seeded_sample(rows, ["k"], 20, 5, kept=True).collect()} == wanted
