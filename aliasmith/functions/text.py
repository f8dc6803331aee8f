"""Cleaning and parsing of names as native column expressions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators of the file formats.
LIST_SEPARATOR = ";"
PART_SEPARATOR = ","
TABLE_SEPARATOR = "|"
PAIR_SEPARATOR = ":"
TRUE_MARK, FALSE_MARK = "T", "F"


def _accent_table() -> tuple[str, str]:
    """Every non-ASCII character whose canonical decomposition holds one ASCII character."""
    source, target = [], []
    for code in range(128, sys.maxunicode + 1):
        char = chr(code)
        plain = [c for c in unicodedata.normalize("NFD", char) if ord(c) < 128]
        if len(plain) == 1:
            source.append(char)
            target.append(plain[0])
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accent_table()
_NON_ASCII = r"[^\x00-\x7F]"


def clean_text(text: Column) -> Column:
    """Accents folded, lower case, ASCII only, hyphens dropped."""
    folded = F.regexp_replace(F.lower(F.translate(text, _ACCENTED, _PLAIN)), _NON_ASCII, "")
    # Folding looks up every character, so plain ASCII texts go without it.
    plain = F.when(text.rlike(_NON_ASCII), folded).otherwise(F.lower(text))
    return F.replace(plain, F.lit("-"), F.lit(""))


def strip_special(text: Column) -> Column:
    """Lower case letters, digits and spaces; the alphabet the n-gram functions work on."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9 ]", "")


def last_name(name: Column) -> Column:
    return F.get(F.split(name, PART_SEPARATOR), F.lit(0))


def first_name(name: Column) -> Column:
    return F.get(F.split(name, PART_SEPARATOR), F.lit(1))


def has_both_parts(name: Column) -> Column:
    """True when something other than commas follows the first comma."""
    return name.rlike(",[^,]")


def is_valid_name(name: Column) -> Column:
    """Neither null, empty nor the text ``null``, and written as ``last,first``."""
    return name.isNotNull() & (name != "null") & (name != "") & has_both_parts(name)


def parse_label(mark: Column) -> Column:
    """``T`` and ``F`` to 1.0 and 0.0; anything else is null."""
    trimmed = F.trim(mark)
    return F.when(trimmed == TRUE_MARK, F.lit(1.0)).when(trimmed == FALSE_MARK, F.lit(0.0))


def parse_message(message: Column) -> tuple[Column, Column]:
    """Name and citizenship of a ``name;country`` message, quotes removed."""
    parts = F.split(message, LIST_SEPARATOR)

    def unquoted(index: int) -> Column:
        return F.replace(F.get(parts, F.lit(index)), F.lit('"'), F.lit(""))

    return unquoted(0), unquoted(1)


def natural_order(name: Column) -> Column:
    """``last,first`` written as ``first last``."""
    return F.concat_ws(" ", first_name(name), last_name(name))


def vowels(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^aeiou]", "")


def consonants(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^b-df-hj-np-tv-z]", "")
