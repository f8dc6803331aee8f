import pytest
from pyspark.sql import functions as F

import brute
from aliasmith.functions.ngrams import char_grams
from aliasmith.functions.text import strip_special
from aliasmith.operators.simjoin import gram_array, gram_bounds, gram_ids, gram_order, ordered_grams, similar_texts


def sides(spark, left, right, keys=()):
    """Both sides with grams; rows are (key..., text)."""
    schema = ", ".join([*(f"{k} string" for k in keys), "text string"])
    one, two = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    order = gram_order(two, "text")
    a = one.join(ordered_grams(one, "text", order), "text").withColumnsRenamed({"text": "a", "grams": "grams1"})
    b = two.join(ordered_grams(two, "text", order), "text").withColumnsRenamed({"text": "b", "grams": "grams2"})
    return a, b


TEXTS = ["", "a", "b", "ab", "abc", "o'neil", "oneil", "n/a", *{n.replace(",", " ") for n in brute.names(150)}]


@pytest.mark.parametrize("threshold", [0.05, 1 / 3, 0.5, 5 / 7, 0.9, 1.0])
def test_join_finds_exactly_the_similar_pairs(spark, threshold):
    a, b = sides(spark, [(t,) for t in TEXTS[::2]], [(t,) for t in TEXTS[1:]])
    found = similar_texts(a, b, threshold).collect()
    expected = {
        (x, y): brute.dice(x, y) for x in TEXTS[::2] for y in TEXTS[1:] if brute.dice(x, y) >= threshold - 1e-9
    }
    assert len(found) == len(expected)
    assert {(r.a, r.b): r.similarity for r in found} == pytest.approx(expected)


def test_join_within_keys_and_with_row_thresholds(spark):
    left = [(str(i % 3), t) for i, t in enumerate(TEXTS[:80])]
    right = [(str(i % 2), t) for i, t in enumerate(TEXTS)]
    a, b = sides(spark, left, right, ["k"])
    own = F.when(F.col("k") == "0", 0.8).otherwise(0.4)
    found = similar_texts(a, b, 0.4, keys=["k"], left_threshold=own).collect()
    expected = {
        (k, x, y)
        for k, x in left
        for k2, y in right
        if k == k2 and brute.dice(x, y) >= (0.8 if k == "0" else 0.4) - 1e-9
    }
    assert len(found) == len(expected) and {(r.k, r.a, r.b) for r in found} == expected


@pytest.mark.parametrize("compared_per_row", [0, 20, 1000])
def test_crowded_keys_go_by_prefixes_with_the_same_pairs(spark, compared_per_row):
    left = [("few" if i % 9 == 0 else "many", t) for i, t in enumerate(TEXTS)] + [(None, "abc")]
    right = left[::2]
    a, b = sides(spark, left, right, ["k"])
    found = similar_texts(a, b, 0.4, keys=["k"], compared_per_row=compared_per_row).collect()
    expected = [(k, x, y) for k, x in left for k2, y in right if k and k == k2 and brute.dice(x, y) >= 0.4 - 1e-9]
    assert sorted((r.k, r.a, r.b) for r in found) == sorted(expected)


def test_few_left_rows_find_the_same_pairs(spark):
    a, b = sides(spark, [(t,) for t in TEXTS[:20]], [(t,) for t in TEXTS])
    one, two = (sorted(map(tuple, similar_texts(a, b, 0.5, few_left=few).collect())) for few in (True, False))
    assert one == two and one


def test_grams_of_a_text_by_their_order(spark):
    texts = [*TEXTS, "Aé B-b", "aaaa", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    order = gram_order(df.where("length(text) > 3"), "text")
    ids = {r.gram: r.gram_id for r in order.collect()}
    found = {r.text: r for r in df.join(ordered_grams(df, "text", order), "text").select("text", "grams", char_grams(strip_special(F.col("text"))).alias("plain")).collect()}
    assert set(found) == set(texts) - {None}
    for row in found.values():
        assert row.grams == sorted(ids.get(g, sum(128 ** (2 - i) * ord(c) for i, c in enumerate(g))) for g in row.plain)


def test_threshold_must_bound_something(spark):
    a, b = sides(spark, [("ab",)], [("ab",)])
    with pytest.raises(ValueError):
        similar_texts(a, b, 0.0)


def test_gram_order_puts_rare_grams_first(spark):
    df = spark.createDataFrame([("abx",), ("aby",), ("abz",)], "text string")
    order = gram_order(df, "text")
    common = order.where("gram = 'ab'").first().gram_id
    assert order.where(F.col("gram_id") >= common).count() == 1


@pytest.mark.parametrize("compared_per_row", [0, 20, 1000])
def test_pairs_by_bounds_are_the_same_and_shuffle_no_grams(spark, compared_per_row):
    rows = [(str(i % 3), t) for i, t in enumerate(TEXTS)] + [("1", None), (None, "abc")]
    df = spark.createDataFrame(rows, "k string, text string")
    ids = gram_ids(gram_order(df, "text"))
    one, two = (df.select("k", F.col("text").alias(n), gram_bounds(F.col("text"), ids).alias(f"bounds{i}")) for i, n in ((1, "a"), (2, "b")))
    grams = tuple(gram_array(F.col(n), ids, ranks=True) for n in ("a", "b"))
    similar = similar_texts(one, two, 0.4, keys=["k"], compared_per_row=compared_per_row, grams=grams)
    found = similar.collect()
    known = [(k, t) for k, t in rows if k and t is not None]
    expected = [(k, x, y) for k, x in known for k2, y in known if k == k2 and brute.dice(x, y) >= 0.4 - 1e-9]
    assert sorted((r.k, r.a, r.b) for r in found) == sorted(expected)
    if compared_per_row == 1000:
        plan = similar._jdf.queryExecution().optimizedPlan().toString()
        assert "grams(" in plan and "grams(" not in plan[plan.index("Join Inner") :]
