"""Phonetic codes of words, and the similarity of two codes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aliasmith.functions.jaro import jaro_winkler
from aliasmith.functions.metaphone import metaphone_codes


_CODES = T.StructType([T.StructField(name, T.StringType()) for name in ("primary", "alternate")])


@F.pandas_udf(_CODES)
def double_metaphone(text: pd.Series) -> pd.DataFrame:
    """Struct of the primary and alternate Double Metaphone codes, four symbols at most.

    Apply it to a table of distinct words and join the codes; null gives null codes.
    """
    codes = [(None, None) if word is None else metaphone_codes(word) for word in text]
    return pd.DataFrame(codes, columns=["primary", "alternate"])


def _agreement(left: Column, right: Column) -> Column:
    """1 for equal primary codes, 0.75 when an alternate code agrees, else null."""
    p1, a1 = left.getField("primary"), left.getField("alternate")
    p2, a2 = right.getField("primary"), right.getField("alternate")
    return F.when(p1 == p2, F.lit(1.0)).when((p1 == a2) | (a1 == p2) | (a1 == a2), F.lit(0.75))


def compared_codes(left: Column, right: Column) -> tuple[Column, Column]:
    """The primary codes where their own similarity is asked for, else nulls, which cost nothing to score."""
    open_ = _agreement(left, right).isNull()
    return F.when(open_, left.getField("primary")), F.when(open_, right.getField("primary"))


def phonetic_similarity(left: Column, right: Column, code_similarity: Column | None = None) -> Column:
    """1 for equal primary codes, 0.75 when an alternate code agrees, else half the code similarity."""
    if code_similarity is None:
        code_similarity = jaro_winkler(*compared_codes(left, right))
    return F.coalesce(_agreement(left, right), F.lit(0.5) * code_similarity)
