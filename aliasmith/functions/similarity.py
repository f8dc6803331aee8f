"""Similarities of whole names, built from the similarities of their parts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the two name parts.
FIRST_WEIGHT = 0.3
LAST_WEIGHT = 0.7
# The most that the phonetic similarity of two names can be if no codes of their last names agree:
# such words have half the similarity of their codes. The slack is for rounding.
UNLIKE_PHONETIC = FIRST_WEIGHT + LAST_WEIGHT * 0.5 + 1e-9


def full_name(
    first: Column, last: Column, first_weight: float = FIRST_WEIGHT, last_weight: float = LAST_WEIGHT
) -> Column:
    """Weighted sum of the similarities of first and last names."""
    if not math.isclose(first_weight + last_weight, 1.0):
        raise ValueError("the weights of the name parts must sum to 1")
    return F.lit(first_weight) * first + F.lit(last_weight) * last


def levenshtein_similarity(left: Column, right: Column) -> Column:
    """1 minus the edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(left), F.length(right))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(left, right) / longest)


def length_difference(left: Column, right: Column) -> Column:
    return F.abs(F.length(left) - F.length(right))
