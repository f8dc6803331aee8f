"""A minimal perfect hash over 64-bit keys, level by level (Limasset et al. 2017), in numpy.

Each level hashes the keys that are left to a bit array about twice their number. Keys alone
in their place set its bit and are done; the others go to the next level. A key's number is
the rank of its bit, so n keys take the numbers 0 to n - 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_SPREAD = 2
_WORD = 64


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each key; equal for equal keys and seeds on every machine."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


@dataclass(frozen=True)
class PerfectHash:
    """``words``: the bits of all levels; ``ranks``: the bits set before each word; ``sizes``: bits per level."""

    sizes: np.ndarray
    words: np.ndarray
    ranks: np.ndarray

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        """Keys must differ from each other."""
        left, sizes, bits = keys.astype(np.uint64), [], []
        while len(left):
            size = -(-max(_WORD, _SPREAD * len(left)) // _WORD) * _WORD
            place = (mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            met = np.bincount(place, minlength=size)
            alone = met == 1
            bits.append(alone)
            left = left[~alone[place]]
            sizes.append(size)
        flags = np.concatenate(bits) if bits else np.zeros(0, bool)
        words = np.packbits(flags, bitorder="little").view("<u8")
        per_word = flags.reshape(-1, _WORD).sum(axis=1)
        ranks = np.cumsum(per_word) - per_word
        return PerfectHash(np.array(sizes, "<u8"), words, ranks.astype("<u8"))

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 or any number for keys that were not built in."""
        keys = keys.astype(np.uint64)
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        offset = 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            place = offset + (mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, bit = place // _WORD, (place % _WORD).astype(np.uint64)
            content = self.words[word]
            hit = (content >> bit) & np.uint64(1) == 1
            below = content[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            found[open_[hit]] = self.ranks[word[hit]].astype(np.int64) + np.bitwise_count(below)
            open_ = open_[~hit]
            offset += size
        return found
