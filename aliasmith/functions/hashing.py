"""Seeded, partition-independent ordering by md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 15 hexadecimal digits are the most that a bigint holds without a sign.
HASH_DIGITS = 15
HASH_BITS = 4 * HASH_DIGITS
HASH_RANGE = 1 << HASH_BITS


def seeded_hash(keys: list[str], seed: int, purpose: str = "") -> Column:
    """The leading 60 bits of md5 over ``key|...|seed+purpose`` as a bigint.

    Draws made one after another from the same rows need different purposes: a class
    thinned by its smallest hashes must not be split by the same hashes again.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(f"{seed}{purpose}"))
    return F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("bigint")
