"""Exact Dice similarity join on n-gram sets, by prefix filtering.

If two gram sets have Dice similarity of at least t, each holds at least
``size * t / (2 - t)`` grams of the other, and the smaller set at least ``size * t``. Sorted
by one global order, the two sets must then share a gram among the first ``size -
needed + 1`` grams of each (Chaudhuri et al. 2006, Bayardo et al. 2007). Ordering grams
from rare to frequent makes these prefixes select few partners, so the join is an equi
join on rare grams and never forms all pairs of a block. The short prefix of the smaller
set also leaves out grams that all names of a group share, such as a common last name.

Prefixes repeat each row once per gram, which pays where a row would otherwise meet many others.
Within keys most groups are small: their rows are compared as they are, behind a bound of the
shared grams from bit sets, and only groups with more comparisons per row go through prefixes.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aliasmith.functions.binding import bind, explode_if
from aliasmith.functions.ngrams import GRAM_CODE_RANGE, char_grams, gram_code
from aliasmith.functions.text import strip_special
from aliasmith.operators.skew import key_pairs, salted_join, spread_join
from aliasmith.session import stored

# Candidates of one gram in a task before they are split.
CANDIDATES_PER_SPLIT = 5_000_000
# Comparisons per row of a group up to which its rows are compared without prefixes.
COMPARED_PER_ROW = 1_000
# Slack for comparisons of sizes with fractions; the similarity itself is recomputed.
EPSILON = 1e-9


def gram_order(texts: DataFrame, column: str) -> DataFrame:
    """``(gram, gram_id)``, ids rising with the number of distinct texts that hold the gram.

    Grams are two or three of 37 symbols, so this table has at most 52,022 rows (and 38
    for texts shorter than a gram), whatever the size of the corpus: it can always be
    broadcast.
    """
    plain = texts.select(strip_special(F.col(column)).alias("text")).distinct()
    counts = plain.select(F.explode(char_grams(F.col("text"))).alias("gram")).groupBy("gram").count()
    return counts.select("gram", (F.col("count") * GRAM_CODE_RANGE + gram_code(F.col("gram"))).alias("gram_id"))


# All grams by their place: none or one symbol, two symbols, three symbols.
_SYMBOLS = " 0123456789abcdefghijklmnopqrstuvwxyz"
_N = len(_SYMBOLS)
_GRAMS = ["#", *(f"#{s}" for s in _SYMBOLS), *map("".join, product(_SYMBOLS, repeat=2)), *map("".join, product(_SYMBOLS, repeat=3))]
_PLACE = {gram: place for place, gram in enumerate(_GRAMS)}
_BOUNDS = "size int, bits0 bigint, bits1 bigint"
_BOUNDS_ARROW = pa.struct([("size", pa.int32()), ("bits0", pa.int64()), ("bits1", pa.int64())])
# Spreads ranks over the places of a bit set.
_MIXER = np.uint64(0x9E3779B97F4A7C15)
_SYMBOL_OF_BYTE = np.zeros(256, np.int64)
_SYMBOL_OF_BYTE[[ord(s) for s in _SYMBOLS]] = np.arange(_N)


def gram_ids(order: DataFrame) -> np.ndarray:
    """The id of every possible gram, by its place; a gram missing from ``order`` has its code.

    An order has at most as many rows as there are grams, so it may come to the driver.
    """
    ids = np.array([sum(128 ** (2 - i) * ord(c) for i, c in enumerate(gram)) for gram in _GRAMS], np.int64)
    for row in stored(order.select("gram", "gram_id"), "gram-order").toLocalIterator():
        ids[_PLACE[row.gram]] = row.gram_id
    return ids


def _held_grams(plain: pa.Array, rank_of_place: np.ndarray) -> np.ndarray:
    """Number of the text and rank of the gram, in one number and in order; each text has a gram, also a null."""
    _, ends, data = plain.buffers()
    ends = np.frombuffer(ends, np.int32)[plain.offset : plain.offset + len(plain) + 1] if len(plain) else np.zeros(1, np.int32)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    lengths = np.diff(ends)
    symbols, rows = _SYMBOL_OF_BYTE[data], np.repeat(np.arange(len(plain)), lengths)
    two = np.flatnonzero(rows[1:] == rows[:-1])
    three = np.flatnonzero(rows[2:] == rows[:-2])
    bigrams = symbols[:-1] * _N + symbols[1:]
    empty, single = np.flatnonzero(lengths == 0), np.flatnonzero(lengths[rows] == 1)
    holders = np.concatenate([empty, rows[single], rows[two], rows[three]])
    places = np.concatenate([
        np.zeros(len(empty), np.int64),
        1 + symbols[single],
        1 + _N + bigrams[two],
        1 + _N + _N * _N + bigrams[three] * _N + symbols[three + 2],
    ])
    return np.unique((holders << 16) | rank_of_place[places])


def _grams_of_batch(plain: pa.Array, rank_of_place: np.ndarray, value_of_rank: np.ndarray) -> pa.Array:
    plain = plain.cast(pa.string())
    held = _held_grams(plain, rank_of_place)
    offsets = np.searchsorted(held >> 16, np.arange(len(plain) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(value_of_rank[held & 0xFFFF]), mask=plain.is_null())


def _ranks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by_id = np.argsort(ids)
    rank_of_place = np.empty(len(ids), np.int64)
    rank_of_place[by_id] = np.arange(len(ids))
    return by_id, rank_of_place


def gram_array(text: Column, ids: np.ndarray, ranks: bool = False) -> Column:
    """The ids of a text's different grams, rarest first; or their ``ranks`` among all, which are shorter."""
    by_id, rank_of_place = _ranks(ids)
    values = np.arange(len(ids), dtype=np.int32) if ranks else ids[by_id]

    def grams(plain: pa.Array) -> pa.Array:
        return _grams_of_batch(plain, rank_of_place, values)

    return F.arrow_udf(grams, "array<int>" if ranks else "array<bigint>")(strip_special(text))


def gram_bounds(text: Column, ids: np.ndarray) -> Column:
    """Size and bit set of a text's grams, by which most partners are ruled out: ``size, bits0, bits1``."""
    _, rank_of_place = _ranks(ids)

    def bounds(plain: pa.Array) -> pa.Array:
        plain = plain.cast(pa.string())
        if not len(plain):
            return pa.array([], _BOUNDS_ARROW)
        held = _held_grams(plain, rank_of_place)
        starts = np.searchsorted(held >> 16, np.arange(len(plain)))
        sizes = np.diff(np.append(starts, len(held))).astype(np.int32)
        place = ((held & 0xFFFF).astype(np.uint64) * _MIXER) >> np.uint64(57)
        bit = np.uint64(1) << (place & np.uint64(63))
        words = [np.bitwise_or.reduceat(np.where(place >> np.uint64(6) == word, bit, np.uint64(0)), starts) for word in (0, 1)]
        fields = [pa.array(sizes), *(pa.array(w.view(np.int64)) for w in words)]
        return pa.StructArray.from_arrays(fields, fields=list(_BOUNDS_ARROW), mask=plain.is_null())

    return F.arrow_udf(bounds, _BOUNDS)(strip_special(text))


def ordered_grams(texts: DataFrame, column: str, order: DataFrame) -> DataFrame:
    """``(column, grams)``: per distinct text its gram ids, rarest first.

    A gram missing from ``order`` occurs in no indexed text and sorts before all others.
    """
    known = texts.select(column).distinct().where(F.col(column).isNotNull())
    return known.select(column, gram_array(F.col(column), gram_ids(order)).alias("grams"))


def _required(size: Column, threshold: Column) -> Column:
    """The fewest grams a set must share with any partner at this threshold."""
    return F.ceil(size * threshold / (F.lit(2.0) - threshold) - EPSILON)


def gram_bits(grams: Column, word: int = 0, words: int = 1) -> Column:
    """One of the words of a bit set of 64 hashed grams each."""

    def added(bits: Column, gram: Column) -> Column:
        place = F.pmod(F.xxhash64(gram), F.lit(64 * words))
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))
        return F.when(F.floor(place / 64) == word, bits.bitwiseOR(bit)).otherwise(bits) if words > 1 else bits.bitwiseOR(bit)

    return F.aggregate(grams, F.lit(0).cast("bigint"), added)


def lacking(own: Column, other: Column) -> Column:
    """The bits of ``own`` that ``other`` lacks, at most as many as the grams that it lacks."""
    return F.bit_count(own.bitwiseAND(F.bitwise_not(other)))


def _sized(df: DataFrame, side: int) -> DataFrame:
    if f"bounds{side}" in df.columns:
        known = F.col(f"bounds{side}")
        fields = [known["size"].alias(f"_size{side}"), *[known[f"bits{w}"].alias(f"_bits{side}{w}") for w in (0, 1)]]
        return df.where(known.isNotNull()).select("*", *fields).drop(f"bounds{side}")
    grams = F.col(f"grams{side}")
    bits = [gram_bits(grams, word, 2).alias(f"_bits{side}{word}") for word in (0, 1)]
    return df.where(F.size(grams) > 0).select("*", F.size(grams).alias(f"_size{side}"), *bits)


def _most_shared() -> Column:
    """The most grams that the two sides of a pair can share: a bit that one side lacks is a gram it lacks."""

    def most(own: int, other: int) -> Column:
        first, second = (lacking(F.col(f"_bits{own}{w}"), F.col(f"_bits{other}{w}")) for w in (0, 1))
        return F.col(f"_size{own}") - first - second

    return F.least(most(1, 2), most(2, 1))


def _prefixes(df: DataFrame, side: int, threshold: Column) -> DataFrame:
    """One row per prefix gram and role: ``_smaller`` is the side that is the smaller set.

    As the smaller set of a pair a row needs only its short prefix, as the larger one
    its long prefix.
    """
    grams, size = F.col(f"grams{side}"), F.col(f"_size{side}")
    long = (size - F.greatest(_required(size, threshold), F.lit(1)) + 1).cast("int")
    short = size - F.greatest(F.ceil(size * threshold - EPSILON), F.lit(1)) + 1
    placed = df.select(
        "*",
        short.alias("_short"),
        F.posexplode(F.slice(grams, F.lit(1), long)).alias(f"_pos{side}", "_gram"),
    )
    larger, own = F.lit(3 - side), F.lit(side)
    roles = F.when(F.col(f"_pos{side}") < F.col("_short"), F.array(larger, own)).otherwise(F.array(larger))
    return placed.withColumn("_smaller", F.explode(roles)).drop("_short")


_SCRATCH = [
    *("_threshold", "_size1", "_size2", "_bits10", "_bits11", "_bits20", "_bits21"),
    *("_pos1", "_pos2", "_gram", "_smaller", "grams1", "grams2"),
]


def similar_texts(
    left: DataFrame,
    right: DataFrame,
    threshold: float,
    *,
    keys: Sequence[str] = (),
    left_threshold: Column | None = None,
    condition: Column | None = None,
    few_left: bool = False,
    compared_per_row: int = COMPARED_PER_ROW,
    grams: tuple[Column, Column] | None = None,
) -> DataFrame:
    """All pairs of rows, equal on ``keys``, whose gram sets have Dice of at least the threshold.

    ``left`` brings an array ``grams1`` and ``right`` an array ``grams2`` of ids from the
    same gram order; the other columns, besides the keys, have different names.
    ``left_threshold`` may raise the threshold per left row, never lower it. The result
    holds all columns but the grams, and ``similarity``. With ``few_left`` the prefixes of ``left``
    are broadcast, so ``right`` is not shuffled. Both sides may bring ``bounds1`` and ``bounds2`` of
    ``gram_bounds``. With these, ``grams`` may give both arrays as expressions of the other columns:
    then they are not shuffled, but made for the pairs that the bounds leave over.
    """
    if not 0.0 < threshold <= 1.0:
        raise ValueError("prefix filtering needs a threshold above 0 and up to 1")
    keys = list(keys)
    floor = F.lit(float(threshold))
    own = floor if left_threshold is None else F.greatest(floor, left_threshold)
    condition = F.lit(True) if condition is None else condition
    one, two = _sized(left, 1), _sized(right, 2)
    if not keys:
        return _by_prefixes(one, two, keys, floor, own, condition, few_left)
    pairs = F.col("_many") * F.col("_few")
    wide = pairs > compared_per_row * (F.col("_many") + F.col("_few"))
    counted = stored(key_pairs(left, right, keys), "key-pairs")
    heavy, crowded = counted.where(~wide & (pairs > CANDIDATES_PER_SPLIT)), counted.where(wide).select(*keys)
    seen = counted.agg(F.count_if(~wide & (pairs > CANDIDATES_PER_SPLIT)), F.count_if(wide), F.sum(F.when(~wide, pairs))).first()
    n_heavy, n_crowded, n_pairs = (n or 0 for n in seen)
    if not n_crowded:
        return _compared(one, two, keys, own, condition, heavy, n_heavy, n_pairs, grams)
    apart = _compared(
        one.join(crowded, keys, "left_anti"), two.join(crowded, keys, "left_anti"), keys, own, condition, heavy, n_heavy, n_pairs, grams
    )
    one, two = one.join(crowded, keys, "left_semi"), two.join(crowded, keys, "left_semi")
    if grams is not None:
        one, two = one.withColumn("grams1", grams[0]), two.withColumn("grams2", grams[1])
    return apart.unionByName(_by_prefixes(one, two, keys, floor, own, condition, few_left))


def _compared(
    one: DataFrame,
    two: DataFrame,
    keys: list[str],
    own: Column,
    condition: Column,
    heavy: DataFrame,
    n_heavy: int,
    n_pairs: int,
    grams: tuple[Column, Column] | None,
) -> DataFrame:
    """Similar pairs among all rows with equal keys."""
    total = F.col("_size1") + F.col("_size2")
    near = spread_join(one, two, keys, heavy, n_heavy, CANDIDATES_PER_SPLIT, n_pairs).where(
        condition & (F.lit(2.0) * _most_shared() >= own * total - EPSILON)
    )
    if grams is not None:
        near = near.select("*", grams[0].alias("grams1"), grams[1].alias("grams2"))
    similarity = F.lit(2.0) * F.size(F.array_intersect("grams1", "grams2")) / total
    return near.select("*", explode_if(similarity, lambda s: s >= own - EPSILON).alias("similarity")).drop(*_SCRATCH)


def _by_prefixes(
    one: DataFrame, two: DataFrame, keys: list[str], floor: Column, own: Column, condition: Column, few_left: bool
) -> DataFrame:
    one = _prefixes(one.withColumn("_threshold", own), 1, F.col("_threshold"))
    two = _prefixes(two, 2, floor)
    size1, size2, least = F.col("_size1"), F.col("_size2"), F.col("_threshold")
    needed = least * (size1 + size2) / 2 - EPSILON
    reachable = 1 + F.least(size1 - F.col("_pos1"), size2 - F.col("_pos2")) - 1
    first_is_smaller = F.col("_smaller") == 1
    on = [*keys, "_gram", "_smaller"]
    # There are few grams, so the lists of a frequent one grow with the texts and are split.
    met = F.broadcast(one).join(two, on) if few_left else salted_join(one, two, on, CANDIDATES_PER_SPLIT)
    joined = met.where(
        F.when(first_is_smaller, (size1 <= size2) & (size1 >= _required(size2, least))).otherwise(
            (size2 < size1) & (size2 >= _required(size1, least))
        )
        & (reachable >= needed)
        & (_most_shared() >= needed)
        & condition
    )
    # A pair meets once per shared prefix gram; it is kept at the first gram it shares.
    similarity = bind(
        F.array_intersect("grams1", "grams2"),
        lambda c: F.when(F.get(c, F.lit(0)) == F.col("_gram"), F.lit(2.0) * F.size(c) / (size1 + size2)),
    )
    similar = explode_if(similarity, lambda s: s >= least - EPSILON).alias("similarity")
    return joined.select("*", similar).drop(*_SCRATCH)
