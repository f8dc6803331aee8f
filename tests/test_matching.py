import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

import brute
from aliasmith.functions.metaphone import metaphone_codes
from aliasmith.operators import matching, models
from aliasmith.operators.profiles import FEATURES, pair_features


@pytest.fixture(scope="module")
def rows():
    draws = random.Random(4)
    listed = brute.names(500, seed=11)
    # Two thirds of the list are in one block, and one name belongs to many entities.
    table = [(str(i // 3), "xx" if i % 3 else draws.choice("ab"), "i", n) for i, n in enumerate(listed)]
    table += [(f"c{i}", "xx", "i", listed[1]) for i in range(100)] + [("n", None, "i", listed[2]), ("v", "a", "i", "x")]
    asked = [(n, draws.choice(["xx", "a", "b"])) for n in brute.names(80, seed=12) + listed[:20]]
    return table, [*asked, ("single", "xx"), (None, "xx"), ("a,b", None)]


@pytest.fixture(scope="module")
def index(spark, rows):
    return matching.build_index(aliases(spark, rows))


def aliases(spark, rows):
    return spark.createDataFrame(rows[0], "uid string, citizenship string, person_type string, name string")


def asked(spark, rows):
    return spark.createDataFrame(rows[1], "name string, citizenship string")


def all_pairs(rows):
    table, queries = rows
    return {
        (q, n, uid, block)
        for q, block in queries
        for uid, b, _, n in table
        if q and block and b == block and "," in q and "," in n
    }


@pytest.mark.parametrize("minimum", [0.2, 0.5, 0.8, 0.95])
def test_rule_match_equals_the_whole_comparison(spark, rows, index, minimum):
    found = matching.match_by_rule(asked(spark, rows), index, minimum).collect()
    expected = {
        p: brute.full_dice(p[0], p[1]) for p in all_pairs(rows) if brute.full_dice(p[0], p[1]) >= minimum
    }
    assert len(found) == len(expected)
    assert {(r.string1, r.string2, r.uid, r.citizenship): r.similarity for r in found} == pytest.approx(expected)


def test_block_pairs_are_all_valid_pairs(spark, rows):
    queries = matching.valid_names(asked(spark, rows).distinct())
    found = matching.block_pairs(queries, aliases(spark, rows)).collect()
    assert {(r.string1, r.string2, r.uid, r.citizenship) for r in found} == all_pairs(rows)


def vectors(spark, decide):
    draws = random.Random(5)
    points = [[draws.random() for _ in FEATURES] for _ in range(400)]
    data = [(float(decide(p)), Vectors.dense(p)) for p in points]
    return spark.createDataFrame(data, ["label", "features"])


def trained(spark, name):
    sharp = vectors(spark, lambda p: p[0] > 0.75)
    mixed = vectors(spark, lambda p: p[0] + p[1] > 1.2)
    sounding = vectors(spark, lambda p: p[0] + p[FEATURES.index("phonetic")] > 1.15)
    return {
        "regression": lambda: models.build_model(sharp, [models.logistic_regression(threshold=0.8)]),
        "multinomial": lambda: models.build_model(mixed, [models.logistic_regression(family="multinomial")]),
        "forest": lambda: models.build_model(sharp, [models.random_forest(trees=5, depth=4)]),
        "mixed forest": lambda: models.build_model(mixed, [models.random_forest(trees=5, depth=4)]),
        "bayes": lambda: models.build_model(mixed, [models.naive_bayes()]),
        "svm": lambda: models.build_model(sharp, [models.linear_svm()]),
        "sounding svm": lambda: models.build_model(sounding, [models.linear_svm()]),
        "sounding regression": lambda: models.build_model(sounding, [models.logistic_regression()]),
        "sounding forest": lambda: models.build_model(sounding, [models.random_forest(trees=5, depth=4)]),
    }[name]()


SOUNDING = ["sounding svm", "sounding regression"]


@pytest.mark.parametrize("name", ["regression", "multinomial", "forest", "mixed forest", "bayes", "svm", "sounding forest", *SOUNDING])
def test_model_match_equals_the_whole_comparison(spark, rows, index, name):
    model = trained(spark, name)
    floor = models.ngram_floor(model, FEATURES)
    apart = models.unlike_floor(model, FEATURES)
    found = matching.match_by_model(asked(spark, rows), index, model, floor, unlike_floor=apart).collect()
    pairs = spark.createDataFrame(sorted({p[:2] for p in all_pairs(rows)}), "string1 string, string2 string")
    scored = matching.assemble_features(pair_features(pairs), ignored=["string1", "string2"])
    accepted = {(r.string1, r.string2) for r in model.transform(scored).where("prediction = 1").collect()}
    expected = {p for p in all_pairs(rows) if p[:2] in accepted}
    assert {(r.string1, r.string2, r.uid, r.citizenship) for r in found} == expected
    assert len(found) == len(expected)


@pytest.mark.parametrize("name", SOUNDING)
def test_models_that_accept_like_sounding_names_do_not_compare_whole_blocks(spark, rows, index, name, monkeypatch):
    model = trained(spark, name)
    floor, apart = models.ngram_floor(model, FEATURES), models.unlike_floor(model, FEATURES)
    assert floor <= 0.3 < apart
    keys = []
    joined = matching.salted_join

    def watched(left, right, on, *more):
        keys.append(list(on))
        return joined(left, right, on, *more)

    monkeypatch.setattr(matching, "salted_join", watched)
    matching.match_by_model(asked(spark, rows), index, model, floor, unlike_floor=apart)
    assert keys and [matching.BLOCK] not in keys


def test_like_sounding_names_equal_all_pairs_with_a_common_code(spark, rows, index):
    table = [(str(i), "xx", "i", n) for i, n in enumerate(["smith,a", "schmidt,b", "smyth,c", "12,d", "34,e", "jones,f"])]
    queries = [("smith,x", "xx"), ("9,y", "xx"), ("smith,x", "a"), ("yones,z", "xx")]
    for listed, given, known in ((rows[0], rows[1], index), (table, queries, None)):
        known = known or matching.build_index(aliases(spark, (listed, given)))
        found = matching.like_sounding_names(asked(spark, (listed, given)), known).collect()

        def codes(name):
            return set(metaphone_codes(name.split(",")[0]))

        expected = {(a, b, c) for a, b, _, c in all_pairs((listed, given)) if codes(a) & codes(b)}
        assert {tuple(r) for r in found} == expected and len(found) == len(expected) > 0


@pytest.mark.parametrize("name", ["regression", "multinomial", "forest", "mixed forest", "bayes", "svm", *SOUNDING])
def test_unlike_floor_is_below_every_accepted_input_of_unlike_names(spark, name):
    model = trained(spark, name)
    draws = random.Random(7)
    grid = [(Vectors.dense([draws.random(), draws.random(), draws.random() * 0.65]),) for _ in range(3000)]
    accepted = model.transform(spark.createDataFrame(grid, ["features"])).where("prediction = 1").collect()
    assert models.unlike_floor(model, FEATURES) <= min((r.features[0] for r in accepted), default=1.0)


@pytest.mark.parametrize("name", ["regression", "multinomial", "forest", "mixed forest", "bayes", "svm", *SOUNDING])
def test_floor_is_below_every_accepted_input(spark, name):
    model = trained(spark, name)
    floor = models.ngram_floor(model, FEATURES)
    draws = random.Random(6)
    grid = [(Vectors.dense([draws.random() for _ in FEATURES]),) for _ in range(3000)]
    accepted = model.transform(spark.createDataFrame(grid, ["features"])).where("prediction = 1").collect()
    lowest = min(r.features[0] for r in accepted)
    assert floor <= lowest
    if name in ("regression", "forest", "svm"):
        assert floor > 0.4


def test_match_lines(spark):
    df = spark.createDataFrame([("q", "a,b", "7", "gb")], "string1 string, string2 string, uid string, citizenship string")
    assert matching.to_match_lines(df).first().value == "a,b,7,gb"


def test_features_form_the_pairs_once(spark):
    names = brute.names(12, seed=6)
    pairs = spark.range(10).select(F.lit(names[0]).alias("string1"), F.element_at(F.array(*map(F.lit, names)), (F.col("id") + 1).cast("int")).alias("string2"))
    scored = pair_features(pairs, phonetic=False)
    assert "Range" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert {r.string2 for r in scored.collect()} == set(names[:10])


def test_pairs_of_a_rule_match_are_not_joined_with_entities_afterwards(spark, rows, index, monkeypatch):
    """The pairs, which grow with the square of the names, were shuffled once more to meet their entities."""
    monkeypatch.setattr(matching, "UIDS_PER_ROW", 7)
    held = matching.entities(index).collect()
    assert max(len(r.uids) for r in held) < 40 and sum(len(r.uids) for r in held) == index.aliases.count()
    matches = matching.match_by_rule(asked(spark, rows), index, 0.8)
    plan = matches._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("Generate explode(uids" in line for line in plan[:2])
    found = matches.collect()
    expected = {p: brute.full_dice(p[0], p[1]) for p in all_pairs(rows) if brute.full_dice(p[0], p[1]) >= 0.8}
    assert len(found) == len(expected)
    assert {(r.string1, r.string2, r.uid, r.citizenship): r.similarity for r in found} == pytest.approx(expected)
