"""License notices in texts, also where they are misspelt: a fuzzy search for short notices.

A text is searched as its normalised words with one blank before and after each. A notice may
differ from its wording by ``errors`` edits of one character. Its wording is split into one
part more than that, so every occurrence holds some part unchanged (the pigeonhole principle).
One automaton finds all parts of all notices in one pass over a text. Around each part lies
the window in which an occurrence that holds it there must be; the window alone is searched
with the ``regex`` library's bounded-error matching, which gives the span and the edits. A
part inside a span that its notice already has is not looked at again. So time grows with the
text and its parts, spans of one notice do not overlap, and every occurrence within the errors
shares at least a character with a span of its notice.

A notice without errors is its own part and is found at every place.

Defined results: null and empty texts have no words and no spans; a notice split by punctuation
or line breaks is found, since these separate words only; rows that agree in id and text have
the same result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aliasmith.llm.batches import record_batch, slices, utf8

_ROWS = 2048
_SLICE_BYTES = 1 << 23
# The bytes words consist of, after lower-casing A to Z; others separate words.
_WORD_BYTES = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)}
_NORMAL = bytes(c if c in _WORD_BYTES else 0x20 for c in bytes(range(256)).lower())


@dataclass(frozen=True)
class Notice:
    """``words``: the wording, in normalised words; ``errors``: the most edits of one character."""

    label: str
    words: str
    errors: int = 0


# The phrases that name a license by themselves, with its label.
BASE = (
    Notice("gpl", "gnu general public license"),
    Notice("apache", "apache license"),
    Notice("cc-by", "cc by"),
    Notice("mit", "mit license"),
)
# Wordings of the licenses' own notices, with its label and the edits allowed.
NOTICES = (
    Notice("gpl", "gnu general public license", 2),
    Notice("gpl", "this program is free software you can redistribute it and or modify it", 6),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("agpl", "gnu affero general public license", 3),
    Notice("apache", "licensed under the apache license version 2 0", 4),
    Notice("apache", "you may not use this file except in compliance with the license", 5),
    Notice("mit", "released under the mit license", 3),
    Notice("mit", "licensed under the mit license", 3),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification", 6),
    Notice("bsd", "licensed under the bsd license", 3),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 6),
    Notice("mpl", "mozilla public license", 2),
    Notice("epl", "eclipse public license", 2),
    Notice("boost", "boost software license", 2),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 6),
    Notice("cc0", "creative commons zero", 1),
    Notice("cc-by", "creative commons attribution", 2),
    Notice("cc-by", "licensed under cc by", 2),
    Notice("cc-by-nc", "licensed under cc by nc", 2),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 4),
    Notice("cc-by-sa", "licensed under cc by sa", 2),
    Notice("cc-by-sa", "creative commons attribution sharealike", 3),
    Notice("proprietary", "all rights reserved", 1),
)

_SPAN = "struct<label:string,notice:int,first_word:bigint,end_word:bigint,edits:int,likeness:double>"
_SPANS = f"array<{_SPAN}>"
_SPAN_TYPE = pa.list_(
    pa.struct(
        {
            "label": pa.string(),
            "notice": pa.int32(),
            "first_word": pa.int64(),
            "end_word": pa.int64(),
            "edits": pa.int32(),
            "likeness": pa.float64(),
        }
    )
)


def normal_words(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8: runs of digits, letters and characters outside ASCII."""
    return text.translate(_NORMAL).split()


def _one_byte_each(data: bytes) -> str:
    """Bytes as characters, so that the automaton's places are places in the bytes."""
    return data.decode("latin-1")


def parts(wording: str, errors: int) -> list[tuple[int, bytes]]:
    """The pigeonhole parts of a wording, of nearly equal length, with their place in bytes."""
    cuts = [len(wording) * i // (errors + 1) for i in range(errors + 2)]
    found = zip(cuts[:-1], cuts[1:], strict=True)
    return [(len(wording[:a].encode()), wording[a:b].encode()) for a, b in found]


class NoticeSearch:
    """Finds notices in texts; one per worker."""

    def __init__(self, notices: Sequence[Notice]) -> None:
        import ahocorasick
        import regex

        self.notices = tuple(notices)
        self.padded = []
        self.forms = []
        places: dict[str, list[tuple[int, int, int]]] = {}
        for number, notice in enumerate(self.notices):
            words = b" ".join(normal_words(notice.words.encode())).decode()
            padded = f" {words} "
            if not words or len(padded) <= notice.errors:
                raise ValueError(f"a notice needs more characters than errors: {notice}")
            self.padded.append(padded)
            fuzzy = f"{{e<={notice.errors}}}" if notice.errors else ""
            self.forms.append(regex.compile(f"(?b)(?:{regex.escape(padded, literal_spaces=True)}){fuzzy}"))
            for place, part in parts(padded, notice.errors):
                places.setdefault(_one_byte_each(part), []).append((number, place, len(part)))
        self.automaton = ahocorasick.Automaton()
        for part, known in places.items():
            self.automaton.add_word(part, known)
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def spans(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """``(notice, first word, end word, edits)`` of a text, by place."""
        if self.empty or not words:
            return []
        data = b" " + b" ".join(words) + b" "
        upto = [-1] * len(self.notices)
        found: list[tuple[int, int, int, int]] = []
        for end, known in self.automaton.iter(_one_byte_each(data)):
            for number, place, length in known:
                start = end + 1 - length
                if self.notices[number].errors == 0:
                    found.append((start, end + 1, number, 0))
                elif end >= upto[number]:
                    span = self._verified(data, number, start - place, upto[number])
                    if span is not None:
                        found.append(span)
                        upto[number] = span[1]
        return self._by_word(data, found)

    def _verified(self, data: bytes, number: int, expected: int, free: int) -> tuple[int, int, int, int] | None:
        """The best match in the window of a part whose notice would start at ``expected``."""
        # An edit moves the notice by one character, of up to four bytes.
        reach = 4 * self.notices[number].errors
        low = max(0, free, expected - reach)
        high = min(len(data), expected + len(self.padded[number].encode()) + reach)
        while low < len(data) and data[low] & 0xC0 == 0x80:
            low += 1
        while high < len(data) and data[high] & 0xC0 == 0x80:
            high += 1
        window = data[low:high].decode()
        match = self.forms[number].search(window)
        if match is None:
            return None
        before = low + len(window[: match.start()].encode())
        return before, before + len(match.group().encode()), number, sum(match.fuzzy_counts)

    @staticmethod
    def _by_word(data: bytes, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Places in bytes as places in words: as many blanks lie before a word as its number, and one."""
        ends = sorted({place for start, end, _, _ in found for place in (start + 1, end - 1)})
        blanks, total, last = {}, 0, 0
        for place in ends:
            total += data.count(b" ", last, place)
            blanks[place], last = total, place
        return [(number, blanks[start + 1] - 1, blanks[end - 1], edits) for start, end, number, edits in sorted(found)]


def license_spans(docs: DataFrame, notices: Sequence[Notice] = BASE + NOTICES) -> DataFrame:
    """``(doc_id, n_words, spans)`` of every document.

    A span has its label, the number of its notice in ``notices``, its first word and the word after
    its last, the edits, and its likeness: the share of the wording's characters that it kept.
    """
    types = {"doc_id": pa.int64(), "n_words": pa.int64(), "spans": _SPAN_TYPE}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = NoticeSearch(notices)
        for batch in slices(batches, _ROWS, _SLICE_BYTES):
            out: dict[str, list] = {"doc_id": batch.column(0).to_pylist(), "n_words": [], "spans": []}
            for text in utf8(batch.column(1)):
                words = normal_words(text)
                out["n_words"].append(len(words))
                out["spans"].append(
                    [
                        {
                            "label": notices[number].label,
                            "notice": number,
                            "first_word": first,
                            "end_word": end,
                            "edits": edits,
                            "likeness": 1 - edits / len(search.padded[number]),
                        }
                        for number, first, end, edits in search.spans(words)
                    ]
                )
            yield record_batch(out, types)

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(find, f"doc_id bigint, n_words bigint, spans {_SPANS}")


def labels_of(spans: Column) -> Column:
    """The distinct labels in order, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s.label))), ",")


def license_scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, spans, base)``: all spans, and those of the phrases in ``BASE``."""
    found = license_spans(docs)
    return found.withColumn("base", F.filter("spans", lambda s: s.notice < len(BASE)))
