"""Context-triggered piecewise hashing (Kornblum 2006) of one text, in numpy.

The hash of a window that rolls over the text by bytes ends a piece where it falls below a
bound, so piece ends depend on the text near them only. A signature has one character per
piece. A fingerprint holds the signatures at a block size, chosen by the length, and at twice
that size, so texts whose block sizes are equal or neighbours can be compared.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np

# The window in bytes, its multiplier, the characters of a signature, how many
# of them there are at most, and the run that two signatures must share to be alike at all.
WINDOW = 8
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LONGEST = 64
SHARED_RUN = 4
_SMALLEST = 0
# Piece ends are first looked for down to so many halvings below the expected block size.
_SPARE = 3


def _rolled(data: bytes) -> np.ndarray:
    """The hash of the window that ends at each byte; zeros stand before the text."""
    padded = bytes(WINDOW - 1) + data
    return np.ndarray((len(data),), "<u8", padded, strides=(1,)) * _MULTIPLIER


def _bound(exponent: int) -> np.uint64:
    return np.uint64((1 << (64 - exponent)) - 1)


class PieceEnds:
    """Where pieces may end in a text, with their hashes, at all block sizes from an exponent on."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.expected = ((len(data) - 1) // LONGEST).bit_length()
        self._find(max(_SMALLEST, self.expected - _SPARE))

    def _find(self, exponent: int) -> None:
        hashes = _rolled(self.data)
        places = np.flatnonzero(hashes <= _bound(exponent))
        self.exponent, self.hashes, self.ends = exponent, hashes[places], places + 1

    def at(self, exponent: int) -> list[int]:
        """The ends of the pieces at one block size; the last piece reaches to the end of the text."""
        if exponent < self.exponent:
            self._find(exponent)
        ends = self.ends[self.hashes <= _bound(exponent)][: LONGEST - 1].tolist()
        return ends if ends and ends[-1] == len(self.data) else [*ends, len(self.data)]


def _signature(data: bytes, ends: list[int], longest: int) -> str:
    if len(ends) > longest:
        ends = [*ends[: longest - 1], len(data)]
    starts = [0, *ends[:-1]]
    return "".join([_ALPHABET[crc32(data[a:b]) & 63] for a, b in zip(starts, ends, strict=True)])


def fingerprint(data: bytes) -> str:
    """``exponent:signature:signature at twice the block size``; an empty text has empty signatures."""
    if not data:
        return f"{_SMALLEST}::"
    found = PieceEnds(data)
    exponent = found.expected
    ends = found.at(exponent)
    while exponent > _SMALLEST and len(ends) < LONGEST // 2:
        exponent -= 1
        ends = found.at(exponent)
    return f"{exponent}:{_signature(data, ends, LONGEST)}:{_signature(data, found.at(exponent + 1), LONGEST // 2)}"


def _common_length(one: str, two: str) -> int:
    """The length of the longest common subsequence, one bit per character (Hyyrö 2004)."""
    masks: dict[str, int] = {}
    for i, c in enumerate(one):
        masks[c] = masks.get(c, 0) | (1 << i)
    full = (1 << len(one)) - 1
    row = full
    for c in two:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(one) - row.bit_count()


def _alike(one: str, two: str) -> float:
    """1 less the edit distance (insertions and deletions) as a share of both lengths."""
    if one == two:
        return 1.0
    shorter = min(len(one), len(two))
    if not shorter:
        return 0.0
    run = min(SHARED_RUN, max(1, 2 * shorter // 3))
    runs = {one[i : i + run] for i in range(len(one) - run + 1)}
    if not any(two[i : i + run] in runs for i in range(len(two) - run + 1)):
        return 0.0
    return 2.0 * _common_length(one, two) / (len(one) + len(two))


_PARTS = re.compile(r"(\d+):([^:]*):([^:]*)")


def likeness(one: str, two: str) -> float:
    """0 to 1; fingerprints whose block sizes are further than a factor of two apart are not alike."""
    if one == two:
        return 1.0
    size1, fine1, coarse1 = _PARTS.fullmatch(one).groups()
    size2, fine2, coarse2 = _PARTS.fullmatch(two).groups()
    gap = int(size1) - int(size2)
    if gap == 0:
        return max(_alike(fine1, fine2), _alike(coarse1, coarse2))
    if gap == 1:
        return _alike(fine1, coarse2)
    return _alike(coarse1, fine2) if gap == -1 else 0.0
