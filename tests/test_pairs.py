from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import brute
from aliasmith.operators import pairs


def test_a_band_that_cannot_be_filled_gives_all_it_has(spark):
    names = brute.names(30, seed=3)
    df = spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "uid string, name string")
    found = pairs.false_pairs(df, 3000).collect()
    every = {tuple(sorted(p)) for p in combinations(set(names), 2)}
    assert {(r.string1, r.string2) for r in found} == every
    few = pairs.false_pairs(df, 30).collect()
    assert {tuple(r) for r in few} <= {tuple(r) for r in found}


@pytest.fixture(scope="module")
def aliases(spark):
    names = brute.names(400)
    rows = [(str(i // 10), n) for i, n in enumerate(names)]
    # One entity holds a third of all rows, one is a copy of another, one name repeats.
    rows += [("big", n) for n in brute.names(200, seed=8)]
    rows += [("copy", n) for uid, n in rows if uid == "3"] + [("4", rows[40][1])]
    return rows


def by_entity(rows):
    held = defaultdict(set)
    for uid, name in rows:
        held[uid].add(name)
    return held


def whole_dice(a, b):
    return brute.dice(a, b)


@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_true_pairs_equal_all_pairs_within_entities(spark, aliases, threshold):
    df = spark.createDataFrame(aliases, "uid string, name string")
    found = [tuple(r) for r in pairs.true_pairs(df, threshold).collect()]
    expected = {
        (*sorted(pair), whole_dice(*pair))
        for names in by_entity(aliases).values()
        for pair in combinations(names, 2)
        if whole_dice(*pair) >= threshold
    }
    assert len(found) == len(expected)
    assert {(a, b): s for a, b, s in found} == pytest.approx({(a, b): s for a, b, s in expected})


def test_false_pairs_join_different_entities_in_each_band(spark, aliases):
    df = spark.createDataFrame(aliases, "uid string, name string")
    found = pairs.false_pairs(df, 90).collect()
    held = defaultdict(set)
    for uid, name in aliases:
        held[name].add(uid)
    assert Counter(r.band for r in found) == {1: 30, 2: 30, 3: 30}
    assert len({(r.string1, r.string2) for r in found}) == 90
    bounds = {1: (0.0, 0.3), 2: (0.3, 0.7), 3: (0.7, 1.01)}
    for r in found:
        assert r.string1 <= r.string2
        assert len(held[r.string1] | held[r.string2]) > 1
        low, high = bounds[r.band]
        assert low <= r.similarity < high
        assert r.similarity == pytest.approx(whole_dice(r.string1, r.string2))


def test_false_pairs_are_repeatable_and_report_shortfall(spark):
    rows = [("1", "aaaa,bbbb"), ("2", "cccc,dddd"), ("3", "eeee,ffff")]
    df = spark.createDataFrame(rows, "uid string, name string")
    first = pairs.false_pairs(df, 30)
    assert sorted(first.collect()) == sorted(pairs.false_pairs(df.repartition(3), 30).collect())
    short = {r.band: (r.found, r.missing) for r in pairs.band_shortfall(first, 30).collect()}
    assert short[2] == (0, 10) and short[3] == (0, 10) and sum(short[1]) == 10


def test_false_pairs_from_sampled_entities(spark, aliases):
    df = spark.createDataFrame(aliases, "uid string, name string")
    found = pairs.false_pairs(df, 300, sample_size=3).collect()
    held = by_entity(aliases)
    used = {n for r in found for n in (r.string1, r.string2)}
    assert any(used <= held[a] | held[b] | held[c] for a, b, c in combinations(held, 3))


def test_labelled_lines_round_trip(spark):
    rows = [("a,b", "c,d", 1.0), ("e,f", "g,h", 0.0)]
    df = spark.createDataFrame(rows, "string1 string, string2 string, label double")
    lines = pairs.to_labelled_lines(df)
    assert sorted(r.value for r in lines.collect()) == ["a,b : c,d:T", "e,f : g,h:F"]
    assert sorted(tuple(r) for r in pairs.read_labelled_lines(lines).collect()) == sorted(rows)


def test_training_features_drop_incomplete_pairs(spark):
    rows = [
        ("smith,john", "smyth,jon", 1.0),
        ("smith", "smyth,jon", 1.0),
        (None, "smyth,jon", 0.0),
        ("a,b", "c,d", None),
        ("smith,", "smyth,jon", 0.0),
    ]
    df = spark.createDataFrame(rows, "string1 string, string2 string, label double")
    (row,) = pairs.training_features(df).collect()
    assert row.ngram == pytest.approx(brute.full_dice("smith,john", "smyth,jon"))
    expected = 0.3 * brute.jaro_winkler("john", "jon") + 0.7 * brute.jaro_winkler("smith", "smyth")
    assert row.jaro_winkler == pytest.approx(expected)
    assert row.phonetic == pytest.approx(1.0)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 40, 41])
def test_places_hold_every_pair_once_and_draws_are_disjoint(spark, n):
    names = spark.createDataFrame([(f"n{i:02d}", i) for i in range(n)], "name string, row bigint")
    places = 1 << 2 * pairs._half_bits(n * (n - 1) // 2)
    cut = places // 3
    drawn = [
        [(r.turn, tuple(sorted((r.name1, r.name2)))) for r in pairs.random_pairs(names, n, a, b, 42).collect()]
        for a, b in ((0, cut), (cut, places))
    ]
    assert all(turn < cut for turn, _ in drawn[0]) and all(turn >= cut for turn, _ in drawn[1])
    found = [pair for part in drawn for _, pair in part]
    assert Counter(found) == Counter(tuple(sorted(p)) for p in combinations([f"n{i:02d}" for i in range(n)], 2))
    assert len({turn for part in drawn for turn, _ in part}) == len(found)


def test_a_permutation_of_large_numbers_keeps_them_apart(spark):
    half = 31
    numbers = spark.range((1 << 62) - 5000, 1 << 62).union(spark.range(5000))
    mixed = [r[0] for r in numbers.select(pairs._permuted(numbers.id, half, 1)).collect()]
    assert len(set(mixed)) == 10_000 and all(0 <= m < 1 << 62 for m in mixed)
    other = [r[0] for r in numbers.select(pairs._permuted(numbers.id, half, 2)).collect()]
    assert len(set(mixed) & set(other)) == 0


def test_random_pairs_join_on_row_numbers_only(spark):
    names = spark.createDataFrame([(f"n{i}", i) for i in range(50)], "name string, row bigint")
    plan = pairs.random_pairs(names, 50, 0, 100, 42)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and plan.count("Join") == 2


def test_names_of_small_entities_are_not_repeated_per_gram(spark):
    rows = [(str(i % 7), n) for i, n in enumerate(brute.names(60, seed=4))]
    found = pairs.true_pairs(spark.createDataFrame(rows, "uid string, name string"), 0.3)
    assert "posexplode" not in found._jdf.queryExecution().toString()
    expected = {(a, b) for u, a in rows for v, b in rows if u == v and a < b and brute.dice(a, b) >= 0.3}
    assert {(r.string1, r.string2) for r in found.collect()} == expected


def test_few_drawn_rows_do_not_shuffle_the_names(spark):
    names = spark.range(200_000).select(F.concat(F.lit("name"), "id").alias("name"), F.col("id").alias("row"))
    plan = pairs.random_pairs(names, 200_000, 0, 1000, 42)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "hashpartitioning" not in plan
