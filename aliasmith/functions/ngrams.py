"""Character n-grams and token skip-grams with Dice similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aliasmith.functions.binding import bind
from aliasmith.functions.text import strip_special

# A text too short for a bigram stands for itself, so two such texts have
# similarity 1 when equal and 0 otherwise.
_SHORT = "#"


def char_grams(text: Column) -> Column:
    """Distinct 2- and 3-grams of a text over the ``strip_special`` alphabet."""

    def grams(plain: Column) -> Column:
        bigrams = F.regexp_extract_all(plain, F.lit("(?=(..))"), F.lit(1))
        trigrams = F.regexp_extract_all(plain, F.lit("(?=(...))"), F.lit(1))
        return F.when(F.length(plain) < 2, F.array(F.concat(F.lit(_SHORT), plain))).otherwise(
            F.array_distinct(F.concat(bigrams, trigrams))
        )

    return bind(text, grams)


def dice(left: Column, right: Column) -> Column:
    """Dice coefficient of two arrays without repeats; equal when both are empty."""
    total = F.size(left) + F.size(right)
    overlap = F.size(F.array_intersect(left, right))
    return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(2.0) * overlap / total)


def ngram_similarity(left: Column, right: Column) -> Column:
    """Dice over the 2- and 3-gram sets of two texts, special characters removed."""
    sets = F.struct(
        char_grams(strip_special(left)).alias("left"), char_grams(strip_special(right)).alias("right")
    )
    return bind(sets, lambda s: dice(s.getField("left"), s.getField("right")))


def gram_code(gram: Column) -> Column:
    """A gram of up to three ASCII characters as a number below 2**21."""
    code = F.lit(0).cast("bigint")
    for position in (1, 2, 3):
        code = code * 128 + F.ascii(F.substring(gram, position, 1))
    return code


GRAM_CODE_RANGE = 1 << 21


def skip_grams(text: Column, max_gap: int = 3) -> Column:
    """Distinct ordered token pairs that stand at most ``max_gap`` tokens apart."""
    def grams(tokens: Column) -> Column:
        pairs = [
            F.zip_with(
                tokens,
                F.slice(tokens, gap + 1, F.greatest(F.size(tokens), F.lit(0))),
                lambda a, b: F.concat(a, F.lit(" "), b),
            )
            for gap in range(1, max_gap + 1)
        ]
        return F.array_distinct(F.filter(F.concat(*pairs), lambda p: p.isNotNull()))

    return bind(F.filter(F.split(text, r"\s+"), lambda t: t != ""), grams)
