"""Jaro-Winkler similarity, computed column-wise over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the published measure.
PREFIX_WEIGHT = 0.1
PREFIX_LENGTH = 4
BOOST_ABOVE = 0.7

# Code points beyond Unicode, so padding never equals a character or other padding.
PAD_LEFT, PAD_RIGHT = 0x110000, 0x110001
_CELLS_PER_SLICE = 4_000_000


def text_matrix(texts: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    fixed = texts.astype(str)
    width = max(fixed.dtype.itemsize // 4, 1)
    lengths = np.char.str_len(fixed)
    chars = fixed.astype(f"U{width}").view(np.uint32).reshape(len(fixed), width).copy()
    chars[np.arange(width)[None, :] >= lengths[:, None]] = pad
    return chars, lengths


def _matched_first(chars: np.ndarray, matched: np.ndarray) -> np.ndarray:
    order = np.argsort(~matched, axis=1, kind="stable")
    return np.take_along_axis(chars, order, axis=1)


def _score_slice(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    a, len_a = text_matrix(left, PAD_LEFT)
    b, len_b = text_matrix(right, PAD_RIGHT)
    rows = np.arange(len(a))
    reach = np.maximum(np.maximum(len_a, len_b) // 2 - 1, 0)
    widest = int(reach.max())
    matched_a = np.zeros(a.shape, bool)
    matched_b = np.zeros(b.shape, bool)
    for i in range(a.shape[1]):
        lo, hi = max(i - widest, 0), min(i + widest + 1, b.shape[1])
        if lo >= hi:
            break
        near = np.abs(np.arange(lo, hi) - i)[None, :] <= reach[:, None]
        free = (b[:, lo:hi] == a[:, i : i + 1]) & ~matched_b[:, lo:hi] & near
        first = free.argmax(axis=1)
        hit = free[rows, first]
        matched_a[hit, i] = True
        matched_b[rows[hit], lo + first[hit]] = True
    matches = matched_a.sum(axis=1)
    width = min(a.shape[1], b.shape[1])
    differs = _matched_first(a, matched_a)[:, :width] != _matched_first(b, matched_b)[:, :width]
    differs &= np.arange(width)[None, :] < matches[:, None]
    swaps = differs.sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (matches / len_a + matches / len_b + (matches - swaps) / matches) / 3.0
    jaro = np.where(matches > 0, jaro, 0.0)
    head = min(PREFIX_LENGTH, width)
    prefix = np.cumprod(a[:, :head] == b[:, :head], axis=1).sum(axis=1)
    return np.where(jaro > BOOST_ABOVE, jaro + prefix * PREFIX_WEIGHT * (1.0 - jaro), jaro)


Score = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _by_size(a: np.ndarray, b: np.ndarray, score: Score) -> np.ndarray:
    """``score`` of aligned texts in slices of similar length, so that one long text does not widen all the others."""
    size = np.maximum(*(np.fromiter(map(len, texts), np.int64, len(texts)) for texts in (a, b)))
    order = np.argsort(size, kind="stable")
    scores = np.empty(len(a))
    start = 0
    while start < len(order):
        stop = min(start + max(_CELLS_PER_SLICE // max(int(size[order[start]]), 1), 1), len(order))
        while stop > start + 1 and (stop - start) * int(size[order[stop - 1]]) > 2 * _CELLS_PER_SLICE:
            stop = start + (stop - start) // 2
        part = order[start:stop]
        scores[part] = score(a[part], b[part])
        start = stop
    return scores


def _numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The different texts, and which of them each row has; -1 for a null."""
    coded = texts.dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def aligned_scores(left: pa.Array, right: pa.Array, score: Score) -> np.ndarray:
    """``score`` of aligned texts; NaN where a side is null. Words repeat often inside a batch, so each different pair is scored once."""
    (one, i), (two, j) = _numbered(left), _numbered(right)
    known = (i >= 0) & (j >= 0)
    result = np.full(len(left), np.nan)
    if known.any():
        pairs, which = np.unique(i[known] * len(two) + j[known], return_inverse=True)
        result[known] = _by_size(one[pairs // len(two)], two[pairs % len(two)], score)[which]
    return result


def scores_of(left: pd.Series, right: pd.Series, score: Score) -> pd.Series:
    """``score`` of aligned texts; null on either side gives null."""
    arrays = (pa.array(texts, pa.string(), from_pandas=True) for texts in (left, right))
    scores = aligned_scores(*arrays, score)
    return pd.Series(scores).where(pd.Series(~np.isnan(scores)), None).astype("Float64")


def jaro_winkler_scores(left: pd.Series, right: pd.Series) -> pd.Series:
    return scores_of(left, right, _score_slice)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(left: pd.Series, right: pd.Series) -> pd.Series:
    return jaro_winkler_scores(left, right)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def jaro_winkler_all(*texts: pa.Array) -> pa.Array:
    """The scores of several pairs of columns in one pass: all left columns, then all right ones."""
    half = len(texts) // 2
    scores = np.stack([aligned_scores(texts[i], texts[half + i], _score_slice) for i in range(half)], axis=1)
    upto = np.arange(len(scores) + 1, dtype=np.int32) * half
    return pa.ListArray.from_arrays(pa.array(upto), pa.array(scores.ravel(), mask=np.isnan(scores).ravel()))
