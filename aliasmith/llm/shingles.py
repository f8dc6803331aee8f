"""Word shingles and MinHash signatures of many texts at once, in numpy.

A shingle is the 64-bit hash of ``SHINGLE`` consecutive words; a text of fewer words is one
shingle, a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

SHINGLE = 5
# Bytes that are hashed together; a longer text is hashed in parts that end between words.
PART = 1 << 20
_COLUMNS = 4096
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
# The bytes words consist of (after lower-casing, see words.py).
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _powers(base: int, size: int) -> np.ndarray:
    steps = np.full(size, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


_FORWARD, _BACKWARD = _powers(_BASE, 2 * PART + 2), _powers(_INVERSE, 2 * PART + 2)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of lower-cased bytes that end in a byte of no word."""
    codes = np.frombuffer(data, np.uint8)
    inside = _IN_WORD[codes]
    change = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = change[::2], change[1::2]
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _FORWARD[: len(codes)], out=sums[1:])
    return starts, mixed((sums[ends] - sums[starts]) * _BACKWARD[starts])


def _pieces(data: bytes) -> Iterator[bytes]:
    """A long text in parts, cut after a byte of no word; a single word longer than that is cut inside."""
    start = 0
    while len(data) - start > PART:
        inside = _IN_WORD[np.frombuffer(data, np.uint8, PART, start)]
        outside = np.flatnonzero(~inside)
        stop = start + (int(outside[-1]) + 1 if len(outside) else PART)
        yield data[start:stop]
        start = stop
    yield data[start:]


def word_hashes(texts: Sequence[bytes]) -> list[np.ndarray]:
    """Per text the hashes of its words in order."""
    found: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    held: list[int] = []
    size = 0

    def together() -> None:
        if not held:
            return
        lowered = [texts[i].lower() + b"\n" for i in held]
        starts, hashes = _hashes(b"".join(lowered))
        bounds = np.cumsum([0, *map(len, lowered)])
        cuts = np.searchsorted(starts, bounds)
        for i, a, b in zip(held, cuts[:-1], cuts[1:], strict=True):
            found[i] = hashes[a:b]

    for number, text in enumerate(texts):
        if len(text) > PART:
            found[number] = np.concatenate([_hashes(piece.lower() + b"\n")[1] for piece in _pieces(text)])
            continue
        if size + len(text) > PART:
            together()
            held, size = [], 0
        held.append(number)
        size += len(text) + 1
    together()
    return found


def shingle_sets(texts: Sequence[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Per text its different shingles in ascending order."""
    found = []
    for words in word_hashes(texts):
        if not len(words):
            found.append(words)
            continue
        size = min(shingle, len(words))
        factor, total = np.uint64(_BASE), np.full(len(words) - size + 1, np.uint64(size))
        for i in range(size):
            total = total * factor + words[i : len(words) - size + 1 + i]
        found.append(np.unique(mixed(total)))
    return found


def multipliers(count: int, seed: int = 42) -> np.ndarray:
    """Odd 32-bit numbers, the same on every machine."""
    spread = mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))
    return (spread >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The smallest value of the shingles under each permutation (multiplication of 32 mixed bits)."""
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    lowest = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(values), _COLUMNS):
        part = factors[:, None] * values[None, start : start + _COLUMNS]
        np.minimum(lowest, part.min(axis=1), out=lowest)
    return lowest


def jaccard(one: np.ndarray, two: np.ndarray) -> float:
    if not len(one) or not len(two):
        return 0.0
    common = len(one) + len(two) - len(np.union1d(one, two))
    return common / (len(one) + len(two) - common)
