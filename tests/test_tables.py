import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aliasmith.operators import aggregates, aliases, datasets, filters, projections, stopwords

WATCH = "uid string, name string, citizenship string, person_type string, aliases string, low_quality_aliases string, alternative_spelling string"
ROWS = [
    ("1", "smith,john", "gb", "i", "smyth,jon;johnny", "smith,j", None),
    ("2", "acme", "fr", "e", "", None, "null"),
    ("3", None, None, None, "doe,", "doe,jane;x,y", "d"),
]


def watch(spark):
    return spark.createDataFrame(ROWS, WATCH)


def test_explode_aliases_takes_all_four_lists(spark):
    found = {(r.uid, r.kind, r.name) for r in aliases.explode_aliases(watch(spark)).collect()}
    assert found == {
        ("1", "name", "smith,john"),
        ("1", "aliases", "smyth,jon"),
        ("1", "aliases", "johnny"),
        ("1", "low_quality_aliases", "smith,j"),
        ("2", "name", "acme"),
        ("2", "aliases", ""),
        ("2", "alternative_spelling", "null"),
        ("3", "aliases", "doe,"),
        ("3", "low_quality_aliases", "doe,jane"),
        ("3", "low_quality_aliases", "x,y"),
        ("3", "alternative_spelling", "d"),
    }


def test_valid_names(spark):
    names = filters.valid_names(aliases.explode_aliases(watch(spark)))
    assert {r.name for r in names.collect()} == {"smith,john", "smyth,jon", "smith,j", "doe,jane", "x,y"}


def test_keep_natural_persons_drops_unknown(spark):
    found = filters.keep_natural_persons(watch(spark))
    assert [r.uid for r in found.collect()] == ["1"] and "person_type" not in found.columns


def test_keep_categories_by_list_and_by_table(spark):
    wanted = spark.createDataFrame([("gb",), ("us",)], "c string")
    for asked in (["gb", "us"], wanted):
        assert [r.uid for r in filters.keep_categories(watch(spark), "citizenship", asked).collect()] == ["1"]


def test_drop_short_aliases_keeps_null_and_moves_columns(spark):
    found = filters.drop_short_aliases(watch(spark), ["aliases", "low_quality_aliases"])
    assert found.columns[-2:] == ["aliases", "low_quality_aliases"]
    rows = {r.uid: (r.aliases, r.low_quality_aliases) for r in found.collect()}
    assert rows == {"1": ("smyth,jon", "smith,j"), "2": ("", None), "3": ("", "doe,jane;x,y")}


def test_multiword_aliases(spark):
    df = spark.createDataFrame([("1", ["a b", "c", "d e f", "g "]), ("2", ["x"]), ("3", [])], "uid string, aliases array<string>")
    assert [tuple(r) for r in filters.multiword_aliases(df).collect()] == [("1", ["a b", "d e f"])]


def test_bands_are_half_open_and_the_last_is_closed(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.29, 0.3, 0.69, 0.7, 1.0)], "s double")
    assert [r[0] for r in df.select(filters.similarity_band(F.col("s"))).collect()] == [1, 1, 2, 2, 3, 3]
    assert df.where(filters.in_band(F.col("s"), 2)).count() == 2


def test_flatten_struct_names_leaves_by_path(spark):
    df = spark.sql("SELECT 1 AS a, named_struct('b', named_struct('c', 2, 'a', 3), 'd', 'x') AS s")
    flat = projections.flatten_struct(df)
    assert flat.columns == ["a", "s_b_c", "s_b_a", "s_d"] and tuple(flat.first()) == (1, 2, 3, "x")


def test_cast_features_and_unreadable_counts(spark):
    df = spark.createDataFrame([("k", "1", "2.5", "0"), ("m", "x", None, "1")], "id string, a string, b string, label string")
    cast = projections.cast_features(df, "label", ["id"])
    assert [tuple(r) for r in cast.collect()] == [("k", 1.0, 2.5, 0.0), ("m", None, None, 1.0)]
    assert projections.unreadable_counts(df, "label", ["id"]).first().asDict() == {"a": 1, "b": 0, "label": 0}


def test_assemble_and_slice_features(spark):
    df = spark.createDataFrame([("k", 1, 2, 3, 1), ("m", None, 2, 3, 0)], "id string, a int, b int, c int, label int")
    rows = datasets.assemble_features(df, "label", ["id"]).collect()
    assert [(r.id, r.label, list(r.features)) for r in rows] == [("k", 1.0, [1.0, 2.0, 3.0])]
    sliced = datasets.slice_features(datasets.assemble_features(df, "label", ["id"], keep_ignored=False), [2, 0])
    assert set(sliced.columns) == {"label", "features"} and list(sliced.first().features) == [3.0, 1.0]


def test_token_frequency_order(spark):
    df = spark.createDataFrame([("B,a  a",), ("b c",), (None,)], "t string")
    assert [tuple(r) for r in aggregates.token_frequency(df, "t").collect()] == [("a", 2), ("b", 2), ("c", 1)]


def test_category_and_candidate_counts(spark):
    counted = aggregates.category_counts(watch(spark), "citizenship")
    assert counted.count() == 3
    queries = spark.createDataFrame([("x",), ("x",), ("y",)], "b string")
    table = spark.createDataFrame([("x",), ("x",), ("x",)], "b string")
    assert [tuple(r) for r in aggregates.candidate_counts(queries, table, "b").collect()] == [("x", 2, 3, 6)]


LONG_LIST = [f"stop{i}" for i in range(3000)]


@pytest.mark.parametrize("more", [[], LONG_LIST])
@pytest.mark.parametrize("as_table", [True, False])
def test_remove_stopwords_gives_the_same_for_any_list(spark, more, as_table):
    rows = [(1, "the cat of in del mar"), (2, "of the"), (3, None), (None, "the x y"), (7, "p the"), (7, "q of"), (8, "a  b"), (9, ""), (9, " the  z ")]
    df = spark.createDataFrame(rows, "id int, t string").repartition(3)
    words = ["the", " of ", "", *more]
    stop = spark.createDataFrame([(w,) for w in [*words, None]], "w string") if as_table else words
    found = stopwords.remove_stopwords(df, "t", stop)
    assert found.columns == df.columns
    expected = [(1, "cat mar"), (2, ""), (3, None), (None, "x y"), (7, "p"), (7, "q"), (8, "a  b"), (9, ""), (9, "  z ")]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))


def test_clean_table_leaves_other_types(spark):
    df = spark.createDataFrame([(1, "É-a", 2.0)], T.StructType.fromDDL("i int, s string, d double"))
    assert tuple(aliases.clean_table(df).first()) == (1, "ea", 2.0)
