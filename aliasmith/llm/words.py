"""Words of a text, as column expressions and inside tasks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that separates counted words, and the characters that words
# of normalised text consist of (digits, letters, everything outside ASCII).
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """The text with A to Z lower-cased and everything else as it is."""
    return F.translate(text, _UPPER, _UPPER.lower())


def word_count(text: Column) -> Column:
    """How many words, separated by blanks, a text has; null has none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    counted = F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, BLANK_RUN))).otherwise(0)
    return F.coalesce(counted, F.lit(0)).cast("bigint")


def plain_words(text: str | None) -> list[str]:
    """The normalised words of a text; null has none."""
    return PLAIN_WORD.findall(text.translate(ASCII_LOWER)) if text else []
