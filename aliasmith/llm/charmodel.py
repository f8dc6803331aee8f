"""Interpolated Kneser-Ney models of characters, one per language, in sorted hash arrays.

The log chance of a character is a sum. Let a context that a language knows add the log of its
back-off weight, and a known gram the log of its chance over that weight times the chance of the
gram without its first character. Known grams have known contexts and known endings, so what is
added for all lengths telescopes to the log chance of the longest known gram, less what is lost by
backing off. A model is therefore one table of ``(key, language, value)`` without rows for what a
language does not know, and can be added up shard by shard.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np

ORDER = 4
# A text is looked at in parts of at most this many characters, and parts of short texts are put
# together up to so many, so that memory does not grow with the texts. Small groups also sort faster.
PART = 1 << 19
GROUP = 1 << 16
# So many characters are scored by one reading of the shards, and so many sums are held for them.
SLAB = 1 << 23
BLOCK = 1 << 21
# What tells the key of a context from that of a gram.
_CONTEXT = np.uint64(0x5851F42D4C957F2D)
_SPACE = 32
_MULTIPLIER = 0x9E3779B97F4A7C15


@cache
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def parts(texts: Sequence[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers of texts and parts of them, together at most ``GROUP`` characters or one part."""
    numbers, held, size = [], [], 0
    for number, text in enumerate(texts):
        for start in range(0, max(1, len(text)), PART):
            part = text[start : start + PART]
            if held and size + len(part) > GROUP:
                yield numbers, held
                numbers, held, size = [], [], 0
            numbers.append(number)
            held.append(part)
            size += len(part)
    if held:
        yield numbers, held


class Characters:
    """The characters of some parts: lower case, every run of other characters one space.

    Each part begins with ``ORDER - 1`` spaces, which only serve as context, and ends with one.
    """

    def __init__(self, texts: Sequence[str]) -> None:
        lead = " " * (ORDER - 1)
        padded = [f"{lead}{text.lower()} " for text in texts]
        codes = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), "<u4")
        part = np.repeat(np.arange(len(padded), dtype=np.int32), [len(p) for p in padded])
        letter = _letters()[codes]
        first = np.concatenate([[0], np.cumsum([len(p) for p in padded])[:-1]]).astype(np.int64)
        leading = np.zeros(len(codes), bool)
        for shift in range(ORDER - 1):
            leading[first + shift] = True
        keep = letter | leading
        # The character after a letter ends a word; other runs were begun by one before.
        keep[1:] |= letter[:-1]
        self.codes = np.where(letter, codes, _SPACE)[keep]
        self.part = part[keep]
        self.scored = ~leading[keep]

    def hashes(self) -> np.ndarray:
        """The hash of the ``ORDER`` characters that end at each place; places near the start are wrong."""
        found = np.zeros(len(self.codes), np.uint64)
        numbers = self.codes.astype(np.uint64) + np.uint64(1)
        for back in range(ORDER):
            found[back:] += numbers[: len(numbers) - back] * np.uint64(pow(_MULTIPLIER, back + 1, 1 << 64))
        return found

    def grams(self, places: np.ndarray) -> np.ndarray:
        """For each place the ``ORDER`` characters that end there, the last one last."""
        return np.stack([self.codes[places - back] for back in range(ORDER - 1, -1, -1)], axis=1)


def keys_at(grams: np.ndarray) -> np.ndarray:
    """For each row of ``ORDER`` characters the keys of the grams that end with it and of their contexts."""

    def hashes(codes: np.ndarray) -> Iterator[np.ndarray]:
        found = np.zeros(len(codes), np.uint64)
        yield found
        for back in range(codes.shape[1]):
            factor = np.uint64(pow(_MULTIPLIER, back + 1, 1 << 64))
            found = found + (codes[:, -1 - back].astype(np.uint64) + np.uint64(1)) * factor
            yield found

    _, *ending = hashes(grams)
    contexts = [found ^ _CONTEXT for found in hashes(grams[:, :-1])]
    return np.stack([*ending, *contexts], axis=1).view(np.int64)


def keys_of(grams: Sequence[str], context: bool) -> np.ndarray:
    """The same keys for grams, or contexts, given as strings of one length."""
    length = len(grams[0]) if len(grams) else 0
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "replace"), "<u4").reshape(len(grams), length)
    found = np.zeros(len(grams), np.uint64)
    for i in range(length):
        found += (codes[:, length - 1 - i].astype(np.uint64) + np.uint64(1)) * np.uint64(pow(_MULTIPLIER, i + 1, 1 << 64))
    return (found ^ _CONTEXT if context else found).view(np.int64)


class GramCounts:
    """Counts of grams of ``ORDER`` characters by language, in arrays."""

    LIMIT = 1 << 19

    def __init__(self) -> None:
        self.held: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, language: str, texts: Sequence[str]) -> None:
        for _, some in parts(texts):
            characters = Characters(some)
            places = np.flatnonzero(characters.scored)
            keys, example, counts = np.unique(
                characters.hashes()[places], return_index=True, return_counts=True
            )
            self.held.setdefault(language, []).append((keys, counts, characters.grams(places[example])))
            self.size += len(keys)
            if self.size > self.LIMIT:
                self.merge()

    def merge(self) -> None:
        for language, found in self.held.items():
            keys = np.concatenate([k for k, _, _ in found])
            distinct, example, place = np.unique(keys, return_index=True, return_inverse=True)
            counts = np.bincount(place, np.concatenate([c for _, c, _ in found]), len(distinct)).astype(np.int64)
            grams = np.concatenate([g for _, _, g in found])[example]
            self.held[language] = [(distinct, counts, grams)]
        self.size = sum(len(found[0][0]) for found in self.held.values())

    def rows(self) -> Iterator[tuple[str, list[str], list[int]]]:
        """The merged counts; the object is empty afterwards."""
        self.merge()
        for language, found in self.held.items():
            _, counts, grams = found[0]
            text = grams.astype("<u4").tobytes().decode("utf-32-le")
            yield language, [text[i : i + ORDER] for i in range(0, len(text), ORDER)], counts.tolist()
        self.held, self.size = {}, 0

    @property
    def full(self) -> bool:
        return self.size > self.LIMIT // 2


@dataclass(frozen=True)
class Shard:
    """Sorted keys, and in each row what the key adds in the language of that number."""

    keys: np.ndarray
    languages: np.ndarray
    values: np.ndarray

    @property
    def first(self) -> int:
        return int(self.keys[0])

    @property
    def last(self) -> int:
        return int(self.keys[-1])

    def load(self) -> Shard:
        return self


@dataclass(frozen=True)
class Model:
    """``shards`` have rows, a first and a last key and ``load()``; ``floor`` is the log chance of any character."""

    languages: list[str]
    shards: Sequence[Shard]
    floor: float

    @staticmethod
    def fit(languages: list[str], counts: dict[str, np.ndarray]) -> Model:
        """From counts per language of grams of ``ORDER`` characters, all in memory.

        A gram of fewer characters counts the different characters it stands after.
        """
        n = len(languages)
        by_order = [counts]
        for _ in range(ORDER - 1):
            shorter: dict[str, np.ndarray] = {}
            for gram, numbers in by_order[0].items():
                shorter[gram[1:]] = shorter.get(gram[1:], np.zeros(n)) + (numbers > 0)
            by_order.insert(0, shorter)
        floor = 1.0 / (len(by_order[0]) + 1)
        chance: dict[str, np.ndarray] = {"": np.full(n, floor)}
        entries = []
        for grams in by_order:
            # Absolute discount from the grams that occur once and twice.
            once = sum(((v == 1) for v in grams.values()), np.zeros(n))
            twice = sum(((v == 2) for v in grams.values()), np.zeros(n))
            discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.9)
            total: dict[str, np.ndarray] = {}
            kinds: dict[str, np.ndarray] = {}
            for gram, numbers in grams.items():
                context = gram[:-1]
                total[context] = total.get(context, np.zeros(n)) + numbers
                kinds[context] = kinds.get(context, np.zeros(n)) + (numbers > 0)
            back = {
                c: np.where(total[c] > 0, discount * kinds[c] / np.maximum(total[c], 1), 1.0) for c in total
            }
            entries += [
                (int(keys_of([c], True)[0]), k, np.log(back[c][k])) for c in total for k in np.flatnonzero(total[c])
            ]
            found = {}
            for gram, numbers in grams.items():
                context, lower = gram[:-1], chance[gram[1:]]
                own = np.maximum(numbers - discount, 0) / np.maximum(total[context], 1)
                found[gram] = own + back[context] * lower
                gain, key = np.log(found[gram] / (back[context] * lower)), int(keys_of([gram], False)[0])
                entries += [(key, k, gain[k]) for k in np.flatnonzero(numbers)]
            chance = found
        entries.sort()
        kinds_of = (np.int64, np.int32, np.float64)
        shard = Shard(*(np.array([e[i] for e in entries], kind) for i, kind in enumerate(kinds_of)))
        return Model(languages, [shard] if entries else [], float(np.log(floor)))

    def entropies(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text its number of scored characters and, by language, the mean cross-entropy in nats."""
        sizes = np.zeros(len(texts), np.int64)
        sums = np.zeros((len(texts), len(self.languages)))
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for numbers, some in parts(texts):
            characters = Characters(some)
            places = np.flatnonzero(characters.scored)
            if not len(places):
                continue
            hashes, example, place = np.unique(characters.hashes()[places], return_index=True, return_inverse=True)
            # The places of a text follow each other, so that it is known where each text begins.
            part = characters.part[places]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            text = np.array(numbers, np.int64)[part[first]]
            np.add.at(sizes, text, np.diff(first, append=len(places)))
            # A small group has few different grams, and their numbers are kept short.
            place = place.astype(np.min_scalar_type(len(hashes)))
            held.append((hashes, characters.grams(places[example]), place, first, text))
            size += len(places)
            if size >= SLAB:
                self._add(held, sums)
                held, size = [], 0
        if held:
            self._add(held, sums)
        sums += self.floor * sizes[:, None]
        return sizes, -sums / np.maximum(sizes, 1)[:, None]

    def _add(self, held: list[tuple[np.ndarray, ...]], sums: np.ndarray) -> None:
        """Add to ``sums``, by text and language, what the shards have for the held places."""
        distinct, example, number = np.unique(
            np.concatenate([hashes for hashes, *_ in held]), return_index=True, return_inverse=True
        )
        grams = np.concatenate([g for _, g, *_ in held])[example]
        number = number.astype(np.int32)
        step = max(1, BLOCK // len(self.languages)) if self.languages else len(distinct)
        for start in range(0, len(distinct), step):
            logs = self._logs(keys_at(grams[start : start + step]))
            upto = 0
            for hashes, _, place, first, text in held:
                mine = number[upto : upto + len(hashes)][place] - start
                upto += len(hashes)
                of = np.repeat(text, np.diff(first, append=len(place)))
                if len(distinct) > step:
                    inside = (mine >= 0) & (mine < len(logs))
                    mine, of = mine[inside], of[inside]
                for begin in range(0, len(mine), step):
                    some = of[begin : begin + step]
                    runs = np.flatnonzero(np.diff(some, prepend=-1))
                    np.add.at(sums, some[runs], np.add.reduceat(logs[mine[begin : begin + step]], runs, axis=0))

    def _logs(self, keys: np.ndarray) -> np.ndarray:
        """By row of keys and language the sum of what the shards have for them."""
        n = len(self.languages)
        logs = np.zeros(len(keys) * n)
        for shard in self.shards:
            loaded = shard.load()
            for column in keys.T:
                row = np.flatnonzero((column >= shard.first) & (column <= shard.last))
                asked = column[row]
                left = np.searchsorted(loaded.keys, asked, "left")
                counts = np.searchsorted(loaded.keys, asked, "right") - left
                at = np.repeat(left - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                # A language has at most one row of a key, so no cell comes twice.
                logs[np.repeat(row, counts) * n + loaded.languages[at]] += loaded.values[at]
        return logs.reshape(len(keys), n)
