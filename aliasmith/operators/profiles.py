"""Per-name properties, computed once per distinct name or word, and pair features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aliasmith.functions.jaro import jaro_winkler_all
from aliasmith.functions.ngrams import char_grams, dice
from aliasmith.functions.phonetic import compared_codes, double_metaphone, phonetic_similarity
from aliasmith.functions.similarity import full_name
from aliasmith.functions.text import first_name, last_name, strip_special
from aliasmith.operators.skew import spread_join
from aliasmith.session import cut_lineage, stored

# Pairs of one name in a task before they are split.
ROWS_PER_SPLIT = 1_000_000
FEATURES = ("ngram", "jaro_winkler", "phonetic")


def name_profiles(names: DataFrame, phonetic: bool = True) -> DataFrame:
    """Per distinct ``name`` its parts, their gram sets and their phonetic codes."""
    parts = names.select("name").distinct().select(
        "name",
        F.coalesce(last_name(F.col("name")), F.lit("")).alias("last"),
        F.coalesce(first_name(F.col("name")), F.lit("")).alias("first"),
    )
    profile = parts.select(
        "*",
        char_grams(strip_special(F.col("last"))).alias("last_grams"),
        char_grams(strip_special(F.col("first"))).alias("first_grams"),
    )
    if not phonetic:
        return profile
    words = parts.select(F.explode(F.array("last", "first")).alias("word")).distinct()
    codes = words.select("word", double_metaphone(F.col("word")).alias("code"))
    last_codes = codes.select(F.col("word").alias("last"), F.col("code").alias("last_code"))
    first_codes = codes.select(F.col("word").alias("first"), F.col("code").alias("first_code"))
    return profile.join(last_codes, "last").join(first_codes, "first")


def _as_side(profiles: DataFrame, side: int) -> DataFrame:
    renamed = {c: f"_{c}{side}" for c in profiles.columns if c != "name"}
    return profiles.withColumnsRenamed(renamed).withColumnRenamed("name", f"string{side}")


def _both(part: str, property_: str) -> tuple[Column, Column]:
    return F.col(f"_{part}{property_}1"), F.col(f"_{part}{property_}2")


def _compared_texts(phonetic: bool) -> list[tuple[Column, Column]]:
    """The pairs of texts of which the features need the Jaro-Winkler similarity."""
    texts = [_both("first", ""), _both("last", "")]
    if phonetic:
        texts += [compared_codes(*_both("first", "_code")), compared_codes(*_both("last", "_code"))]
    return texts


def feature_columns(phonetic: bool = True) -> dict[str, Column]:
    """The three full-name similarities of a pair with profile columns and scores of both sides."""

    def score(i: int) -> Column:
        return F.get("_scores", F.lit(i))

    features = {
        "ngram": full_name(dice(*_both("first", "_grams")), dice(*_both("last", "_grams"))),
        "jaro_winkler": full_name(score(0), score(1)),
    }
    if phonetic:
        features["phonetic"] = full_name(
            phonetic_similarity(*_both("first", "_code"), score(2)),
            phonetic_similarity(*_both("last", "_code"), score(3)),
        )
    return features


def pair_features(pairs: DataFrame, phonetic: bool = True) -> DataFrame:
    """``pairs`` of ``string1`` and ``string2`` with their full-name similarities added.

    All texts of a pair are scored in one pass. The profiles are one row per name; both
    joins split a name that stands in very many pairs.
    """
    pairs = stored(pairs, "pairs")
    both = pairs.select(F.explode(F.array("string1", "string2")).alias("name"))
    profiles = cut_lineage(name_profiles(both, phonetic))
    joined = pairs
    for side in (1, 2):
        # One row per name is joined, so the pairs of a name can be counted before either join.
        name = pairs.groupBy(f"string{side}").agg(F.count("*").alias("_many")).where(F.col("_many") > ROWS_PER_SPLIT)
        heavy = stored(name.withColumn("_few", F.lit(1)), "heavy-names")
        joined = spread_join(joined, _as_side(profiles, side), [f"string{side}"], heavy, heavy.count(), ROWS_PER_SPLIT)
    lefts, rights = zip(*_compared_texts(phonetic), strict=True)
    scored = joined.withColumn("_scores", jaro_winkler_all(*lefts, *rights))
    features = [c.alias(n) for n, c in feature_columns(phonetic).items()]
    return scored.select(*[F.col(c) for c in pairs.columns], *features)
