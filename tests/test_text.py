import unicodedata

import pytest
from pyspark.sql import functions as F

from aliasmith.functions import text
from aliasmith.functions.ngrams import skip_grams


def direct_clean(value):
    folded = unicodedata.normalize("NFD", value).lower()
    return "".join(c for c in folded if ord(c) < 128).replace("-", "")


def test_clean_text_equals_the_direct_rule(spark):
    values = ["Élodie Müller-Ørsted", "ASCII only", "", "ÀÉÎÕÜ ñ ç ß ø æ", "Jean-Luc", "日本 x", "é", "Ǆ ﬁ"]
    values += ["".join(map(chr, range(start, start + 64))) for start in range(32, 0x2200, 64)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for row in df.select("v", text.clean_text(F.col("v")).alias("c")).collect():
        assert row.c == direct_clean(row.v)


def test_clean_text_keeps_null(spark):
    df = spark.createDataFrame([(None,)], "v string")
    assert df.select(text.clean_text(F.col("v")).alias("c")).first().c is None


@pytest.mark.parametrize(
    ("name", "last", "first", "valid"),
    [
        ("smith,john", "smith", "john", True),
        ("smith", "smith", None, False),
        ("smith,", "smith", "", False),
        (",john", "", "john", True),
        ("a,b,c", "a", "b", True),
        ("null", "null", None, False),
        ("", "", None, False),
        (None, None, None, False),
    ],
)
def test_name_parts_and_validity(spark, name, last, first, valid):
    df = spark.createDataFrame([(name,)], "n string")
    n = F.col("n")
    row = df.select(
        text.last_name(n).alias("l"), text.first_name(n).alias("f"), text.is_valid_name(n).alias("v")
    ).first()
    assert (row.l, row.f, bool(row.v)) == (last, first, valid)


def test_parse_label(spark):
    df = spark.createDataFrame([("T",), (" F ",), ("x",), (None,)], "m string")
    assert [r[0] for r in df.select(text.parse_label(F.col("m"))).collect()] == [1.0, 0.0, None, None]


def test_parse_message(spark):
    df = spark.createDataFrame([('"smith,john";"gb"',), ("a,b;fr",), ("broken",)], "m string")
    name, country = text.parse_message(F.col("m"))
    rows = [tuple(r) for r in df.select(name, country).collect()]
    assert rows == [("smith,john", "gb"), ("a,b", "fr"), ("broken", None)]


def test_vowels_and_consonants(spark):
    df = spark.createDataFrame([("Mary Jane-9",)], "t string")
    assert tuple(df.select(text.vowels(F.col("t")), text.consonants(F.col("t"))).first()) == ("aae", "mryjn")


def test_skip_grams(spark):
    df = spark.createDataFrame([("a b c d e",), ("a",), ("",)], "t string")
    found = [sorted(r[0]) for r in df.select(skip_grams(F.col("t"), 2)).collect()]
    assert found == [["a b", "a c", "b c", "b d", "c d", "c e", "d e"], [], []]
