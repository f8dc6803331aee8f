"""Exact token counts of every prefix of a text, for byte-level pair encoding.

The vocabulary file splits a text into pieces and merges the bytes of each piece by rank.
A sequence of tokens is the encoding of its bytes if and only if each two neighbours
are the encoding of theirs. So the encoding of a prefix is that of a shorter prefix and one
more token that is compatible with its last one, and there is exactly one such token: a
dynamic program over the prefixes finds it, and with it the count at every prefix.

Pieces do not influence each other, so the count at a prefix of the text is the sum of the
pieces before it and the entry of its own piece. Two kinds of prefix end in a piece that the
whole text splits otherwise: inside white space the whole run so far is one piece, and a
contraction of two letters cut after the first is an apostrophe and a letter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import regex

# How a text is split before merging, white space, and the contractions that
# fall apart when cut.
PIECE = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
BLANK = regex.compile(r"\p{White_Space}+")
CUT_CONTRACTIONS = ("'re", "'ve", "'ll")
# White space before a space: here pieces do not begin at the space.
_BLANK_AND_SPACE = re.compile(r"\s ")
_NEVER = 1 << 60
# By how many last bytes tokens are looked for, and bits that hold the number of any token.
_ENDING = 5
_BITS = 32
# Bounds of a worker's memory; what does not fit is computed again.
CACHED_PIECES = 1_000_000
CACHED_PAIRS = 500_000
CACHED_LENGTH = 64


def _byte_of_symbol() -> dict[str, int]:
    """The vocabulary file writes printable bytes as themselves and the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _pieces(chunk: str) -> list[str]:
    """The pieces of a chunk with the space before it; words and words with a mark after them need no search."""
    if chunk.isalpha():
        return [" " + chunk]
    if chunk[-1:] in (",", ".") and chunk[:-1].isalpha():
        return [" " + chunk[:-1], chunk[-1]]
    return PIECE.findall(" " + chunk)


class PieceCounts(dict):
    """The number of tokens of a piece or chunk, computed when first asked for.

    Half of the places are for the newest ones. When these are full, the other half is given up for
    them, so that those asked for again and again stay.
    """

    def __init__(self, compute: Callable[[str], int]) -> None:
        super().__init__()
        self.compute = compute
        self.older: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        count = self.older.get(piece)
        if count is None:
            count = self.compute(piece)
        self.keep(piece, count)
        return count

    def keep(self, piece: str, count: int) -> None:
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = count


class TokenLengths(dict):
    """The lengths that tokens at the end of a text may have, the longest first, by its last bytes."""

    def __init__(self, tokens: Iterable[bytes]) -> None:
        super().__init__()
        self.tokens = tokens
        self.longer: dict[bytes, set[int]] = {}
        for token in tokens:
            if len(token) > _ENDING:
                self.longer.setdefault(token[-_ENDING:], set()).add(len(token))

    def __missing__(self, ending: bytes) -> tuple[int, ...]:
        short = [size for size in range(len(ending), 0, -1) if ending[-size:] in self.tokens]
        found = (*sorted(self.longer.get(ending, ()), reverse=True), *short)
        if len(self) >= CACHED_PAIRS:
            self.clear()
        self[ending] = found
        return found


class BytePairs:
    """One vocabulary file, with the tables that its dynamic program needs."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        symbols = _byte_of_symbol()

        def raw(token: str) -> bytes:
            return bytes(symbols[c] for c in token)

        self.ids = {raw(token): number for token, number in model["vocab"].items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(merges)}
        self._lengths = TokenLengths(self.ids)
        special = sorted((t["content"] for t in content["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self._spines: tuple[dict, dict] = ({}, {})
        # By the numbers of both tokens in one; the left one's is one higher, and nothing is 0.
        self._compatible: dict[int, bool] = {}
        self.counts = PieceCounts(self.count_piece)
        self.chunks = PieceCounts(self.count_chunk)

    def _spine(self, token: bytes, right: bool) -> list[tuple[bytes, int]]:
        """The parts that stand at one end of a token while it is merged, each with the rank that ends it."""
        known = self._spines[right].get(token)
        if known is None:
            parts = [token[i : i + 1] for i in range(len(token))]
            at = -1 if right else 0
            known = []
            while len(parts) > 1:
                ranks = [self.ranks.get(pair, _NEVER) for pair in zip(parts, parts[1:], strict=False)]
                rank = min(ranks)
                if rank == _NEVER:
                    break
                place, edge = ranks.index(rank), parts[at]
                parts[place : place + 2] = [parts[place] + parts[place + 1]]
                if parts[at] != edge:
                    known.append((edge, rank))
            # A token that its own bytes do not merge into never occurs.
            known = [*known, (token, _NEVER)] if parts == [token] else []
            self._spines[right][token] = known
        return known

    def compatible(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens, next to each other, encode their bytes; an empty left side asks for the right alone.

        Merges happen in the order of their ranks, since a merge comes after those of its
        parts. So the parts that meet at the boundary follow from the two spines, and the
        tokens stay apart if no meeting pair merges before one of the two is merged inwards.
        Of equal ranks the leftmost pair merges first.
        """
        key = (self.ids[left] + 1 if left else 0) << _BITS | self.ids[right]
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) >= CACHED_PAIRS:
                self._compatible.clear()
            known = self._compatible[key] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: bytes, right: bytes) -> bool:
        ours, theirs = self._spine(left, True) if left else [(b"", _NEVER)], self._spine(right, False)
        if not ours or not theirs:
            return False
        i = j = 0
        while True:
            (one, leaves), (two, goes) = ours[i], theirs[j]
            across = self.ranks.get((one, two), _NEVER)
            if across != _NEVER and across < leaves and across <= goes:
                return False
            if leaves == goes == _NEVER:
                return True
            if leaves <= goes:
                i += 1
            if goes <= leaves:
                j += 1

    def _programs(self, pieces: Iterable[bytes]) -> Iterator[list[int]]:
        """The counts at every prefix of each piece; neighbours share the program of their common prefix."""
        number_of, lengths, compatible = self.ids.get, self._lengths, self._compatible.get
        # By end: the token that the encoding ends in, and its number as the left side of a pair.
        earlier, last, left, counts = b"", [b""], [0], [0]
        for piece in pieces:
            same = 0
            for one, two in zip(earlier, piece, strict=False):
                if one != two:
                    break
                same += 1
            del last[same + 1 :], left[same + 1 :], counts[same + 1 :]
            for end in range(same + 1, len(piece) + 1):
                for length in lengths[piece[end - _ENDING if end > _ENDING else 0 : end]]:
                    start = end - length
                    if start < 0:
                        continue
                    number = number_of(piece[start:end])
                    if number is not None:
                        fits = compatible(left[start] | number)
                        if fits is None:
                            fits = self.compatible(last[start], piece[start:end])
                        if fits:
                            last.append(piece[start:end])
                            left.append(number + 1 << _BITS)
                            counts.append(counts[start] + 1)
                            break
            earlier = piece
            yield counts

    def prefix_counts(self, piece: bytes) -> list[int]:
        """The number of tokens of every prefix of a piece, by bytes; the empty prefix has none."""
        return next(self._programs([piece]))

    def learn(self, chunks: set[str]) -> None:
        """Counts many chunks at once, in sorted order, so that equal beginnings are done once."""
        fresh = {c: _pieces(c) for c in chunks if c not in self.chunks and c not in self.chunks.older}
        counts = self.counts
        asked = {p for pieces in fresh.values() for p in pieces if len(p) <= CACHED_LENGTH}
        new = sorted(p for p in asked if p not in counts and p not in counts.older)
        for piece, found in zip(new, self._programs(p.encode() for p in new), strict=True):
            counts.keep(piece, found[-1])
        for chunk, pieces in fresh.items():
            self.chunks.keep(chunk, sum(map(counts.__getitem__, pieces)))

    def _by_character(self, piece: str) -> list[int]:
        """The counts at the prefixes of a piece that end between characters, without the empty one."""
        counts, ends = self.prefix_counts(piece.encode()), accumulate(len(c.encode()) for c in piece)
        found = [counts[end] for end in ends]
        if piece in CUT_CONTRACTIONS:
            found[1] = self.counts[piece[0]] + self.counts[piece[1]]
        return found

    def _segments(self, text: str) -> list[tuple[str, str]]:
        """The text between special tokens, each part with the special token that follows it."""
        if self.special is None:
            return [(text, "")]
        found, start = [], 0
        for match in self.special.finditer(text):
            found.append((text[start : match.start()], match.group()))
            start = match.end()
        return [*found, (text[start:], "")]

    def count_piece(self, piece: str) -> int:
        return self.prefix_counts(piece.encode())[-1]

    def count_chunk(self, chunk: str) -> int:
        """The number of tokens of a chunk with the space before it."""
        return sum(map(self.counts.__getitem__, _pieces(chunk)))

    def _split(self, text: str) -> tuple[list[str], list[str], int]:
        """Pieces, chunks and the number of special tokens of a text.

        Pieces begin at a space, unless white space stands before it; then the pieces of
        that part of the text are found one by one.
        """
        segments = self._segments(text)
        pieces: list[str] = []
        chunks: list[str] = []
        for part, _ in segments:
            if not part:
                continue
            if _BLANK_AND_SPACE.search(part):
                pieces += PIECE.findall(part)
            else:
                first, *rest = part.split(" ")
                pieces += PIECE.findall(first)
                chunks += rest
        return pieces, chunks, len(segments) - 1

    def count(self, text: str) -> int:
        """The number of tokens of a whole text."""
        return self.count_all([text])[0]

    def count_all(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text; different chunks are counted once."""
        split = [self._split(text) for text in texts]
        self.learn({chunk for _, chunks, _ in split for chunk in chunks})
        piece, chunk = self.counts.__getitem__, self.chunks.__getitem__
        return [sum(map(piece, pieces)) + sum(map(chunk, chunks)) + n for pieces, chunks, n in split]

    def _segment_prefixes(self, text: str) -> list[int]:
        found = [0]
        for piece in PIECE.findall(text):
            base = found[-1]
            found += [base + c for c in self._by_character(piece)]
        # A piece of white space may be counted in two parts above; its prefixes end one run.
        for run in BLANK.finditer(text):
            base = found[run.start()]
            found[run.start() + 1 : run.end() + 1] = [base + c for c in self._by_character(run.group())]
        return found

    def prefixes(self, text: str) -> list[int]:
        """The number of tokens of every prefix of a text, by characters, the empty one first."""
        found = [0]
        for part, special in self._segments(text):
            base = found[-1]
            inside = self._segment_prefixes(part + special[:-1])
            found += [base + c for c in inside[1:]]
            if special:
                found.append(base + inside[len(part)] + 1)
        return found

    def longest_prefix(self, text: str, limit: int) -> int:
        """How many characters the longest prefix with at most ``limit`` tokens has.

        Counts at the ends of pieces never fall, so only the prefixes after the last piece
        that fits are looked at.
        """
        base, start = 0, 0
        for part, special in self._segments(text):
            fitting, total = [], base
            for match in PIECE.finditer(part):
                count = self.counts[match.group()]
                if total + count > limit:
                    return start + self._fit_inside(part + special[:-1], fitting, limit - base, False)
                fitting.append(match.group())
                total += count
            if special and total + 1 > limit:
                return start + self._fit_inside(part + special[:-1], fitting, limit - base, True)
            base, start = total + (1 if special else 0), start + len(part) + len(special)
        return len(text)

    def _fit_inside(self, text: str, fitting: list[str], limit: int, to_end: bool) -> int:
        """The longest fitting prefix of a segment of which some leading pieces fit.

        The prefixes from the end of the last of these on are looked at: up to the end of the
        next piece that is not blank, or up to the end of the text where a special token
        does not fit. They start before any blanks, whose run is one piece, and in the second
        case before the last piece, which the special token's characters may lengthen.
        """
        while fitting and fitting[-1].isspace():
            fitting.pop()
        if to_end and fitting:
            fitting.pop()
        first = stop = sum(map(len, fitting))
        while stop < len(text):
            piece = PIECE.match(text, stop)
            stop = piece.end()
            if not to_end and not piece.group().isspace():
                break
        head = sum(map(self.counts.__getitem__, fitting))
        tail = self._segment_prefixes(text[first:stop])
        return max((first + i for i, c in enumerate(tail) if head + c <= limit), default=0)
