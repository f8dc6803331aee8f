"""Similarity of two texts by aligning their n-grams in order (Kondrak 2005), over Arrow batches.

A position of a text is the n-gram that ends in it. Before its first character a text has ``n - 1``
marks of that character, which equal only the marks of an equal first character. Two n-grams are as
similar as the share of places at which they agree, the texts as the best sum over an alignment
that keeps the order, divided by the longer length: a longest common subsequence of n-grams.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aliasmith.functions.jaro import PAD_LEFT, PAD_RIGHT, scores_of, text_matrix

# Added to a code point to make its mark; greater than every code point and padding.
_MARK = 1 << 21


def _marked(chars: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    first = np.where(lengths > 0, chars[:, 0].astype(np.int64) + _MARK, chars[:, 0])
    return np.concatenate([np.repeat(first[:, None], n - 1, axis=1), chars], axis=1)


def _aligned(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """One step per position of the left texts, for all pairs and positions of the right ones at once."""
    a, len_a = text_matrix(left, PAD_LEFT)
    b, len_b = text_matrix(right, PAD_RIGHT)
    marked_a, marked_b = _marked(a, len_a, n), _marked(b, len_b, n)
    width = b.shape[1]
    best = np.zeros((len(b), width + 1), np.int64)
    for i in range(a.shape[1]):
        agree = sum((marked_a[:, i + u, None] == marked_b[:, u : u + width]).astype(np.int64) for u in range(n))
        agree[i >= len_a] = 0
        gained = np.maximum(best[:, 1:], best[:, :-1] + agree)
        best[:, 1:] = np.maximum.accumulate(gained, axis=1)
    longest = np.maximum(len_a, len_b)
    total = best[np.arange(len(b)), len_b]
    return np.where(longest == 0, 1.0, total / (float(n) * np.maximum(longest, 1)))


def ngram_alignment(left: Column, right: Column, n: int = 2) -> Column:
    """From 0 to 1; 1 for two empty texts, 0 if one is empty, null if one is null."""
    if n < 1:
        raise ValueError("an n-gram has at least one character")

    @F.pandas_udf(T.DoubleType())
    def aligned(one: pd.Series, two: pd.Series) -> pd.Series:
        return scores_of(one, two, lambda a, b: _aligned(a, b, n))

    return aligned(left, right)
