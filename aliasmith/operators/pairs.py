"""True and false name pairs for training."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aliasmith.functions.binding import explode_if
from aliasmith.functions.hashing import HASH_DIGITS, seeded_hash
from aliasmith.functions.ngrams import dice
from aliasmith.functions.text import (
    FALSE_MARK,
    PAIR_SEPARATOR,
    TRUE_MARK,
    has_both_parts,
    parse_label,
)
from aliasmith.operators.filters import BAND_BOUNDS, similarity_band
from aliasmith.operators.profiles import pair_features
from aliasmith.operators.ranking import row_numbers
from aliasmith.operators.sampling import seeded_sample
from aliasmith.operators.simjoin import gram_array, gram_bounds, gram_ids, gram_order, similar_texts
from aliasmith.operators.skew import top_n_per_group
from aliasmith.session import cut_lineage, stored_alone

# Rounds after which a Feistel network of a random function is a pseudorandom permutation (Luby and Rackoff).
FEISTEL_ROUNDS = 4
# Places of the first round for each pair that a band asks for.
PLACES_PER_PAIR = 64
# Names up to which those that look for similar ones are broadcast.
BROADCAST_ANCHORS = 50_000
# Places up to which the names are looked up for broadcast rows.
BROADCAST_PLACES = 100_000


@dataclass(frozen=True)
class NameTable:
    """The names of an alias table and the order of their grams, made once for true and false pairs.

    held:  uid, name; one row per entity and name.
    names: name, low, high; distinct names with the lowest and the highest entity; true pairs do without.
    ids:   the ids of all grams, by which a name's grams are made where they are needed.
    """

    held: DataFrame
    names: DataFrame | None
    ids: np.ndarray

    def grams(self, name: str) -> Column:
        return gram_array(F.col(name), self.ids, ranks=True)

    def bounds(self, name: str) -> Column:
        return gram_bounds(F.col(name), self.ids)


def held_names(aliases: DataFrame) -> DataFrame:
    """The distinct ``uid, name`` rows of an alias table, stored."""
    return cut_lineage(aliases.select("uid", "name").distinct())


def name_table(aliases: DataFrame) -> NameTable:
    """Prepare ``uid, name`` rows for pair generation."""
    return name_table_of(held_names(aliases))


def name_table_of(held: DataFrame) -> NameTable:
    """``name_table`` of rows that ``held_names`` has stored."""
    names = cut_lineage(held.groupBy("name").agg(F.min("uid").alias("low"), F.max("uid").alias("high")))
    named = F.col("name").isNotNull()
    return NameTable(held.where(named), names.where(named), gram_ids(gram_order(names, "name")))


def true_pairs(aliases: DataFrame | NameTable, min_similarity: float) -> DataFrame:
    """Distinct pairs of different names of one entity that are similar enough.

    ``aliases`` holds ``uid`` and ``name``. A pair is written once, in text order.
    """
    table = aliases if isinstance(aliases, NameTable) else name_table(aliases)
    left, right = (table.held.select("uid", F.col("name").alias(f"string{i}"), table.bounds("name").alias(f"bounds{i}")) for i in (1, 2))
    grams = table.grams("string1"), table.grams("string2")
    found = similar_texts(left, right, min_similarity, keys=["uid"], condition=F.col("string1") < F.col("string2"), grams=grams)
    # Equal pairs have equal similarities, which are not shuffled where they are not asked for.
    return found.where(F.col("similarity") >= min_similarity).select("string1", "string2", "similarity").dropDuplicates(["string1", "string2"])


def _half_bits(n_pairs: int) -> int:
    """Bits of each half of a place: the fewest that make at least as many places as pairs."""
    return max(((max(n_pairs, 1) - 1).bit_length() + 1) // 2, 1)


def _permuted(place: Column, half: int, seed: int) -> Column:
    """A keyed permutation of the numbers of ``2 * half`` bits: a Feistel network of md5 rounds."""
    mask = F.lit((1 << half) - 1).cast("bigint")
    halves = F.struct(F.shiftright(place, half).alias("left"), place.bitwiseAND(mask).alias("right"))

    def mix(held: Column, turn: Column) -> Column:
        digest = F.md5(F.concat(held["right"].cast("string"), F.lit("|"), turn))
        bits = F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("bigint").bitwiseAND(mask)
        return F.struct(held["right"].alias("left"), held["left"].bitwiseXOR(bits).alias("right"))

    turns = F.array(*[F.lit(f"{seed}mix{turn}") for turn in range(FEISTEL_ROUNDS)])
    return F.aggregate(turns, halves, mix, lambda held: F.shiftleft(held["left"], half) + held["right"])


def random_pairs(names: DataFrame, n_names: int, start: int, stop: int, seed: int) -> DataFrame:
    """The pairs at the places ``start`` to ``stop`` of a random order of all pairs of different names.

    ``names`` has a ``row``, numbers from 0 without gaps. Pair ``p`` is row ``p % n`` and the one ``p
    div n + 1`` rows after it, round the table, which gives each pair once. A keyed permutation deals
    pairs to places, so that draws of different places are disjoint and together form all pairs, by
    equi joins on row numbers. There are up to four times as many places as pairs; ``turn`` is a
    pair's place.
    """
    n_pairs, n_rows = n_names * (n_names - 1) // 2, max(n_names, 1)
    pair = explode_if(_permuted(F.col("id"), _half_bits(n_pairs), seed), lambda p: p < n_pairs)
    drawn = names.sparkSession.range(start, stop).select(F.col("id").alias("turn"), pair.alias("_pair"))
    rows = drawn.selectExpr("turn", f"_pair % {n_rows} AS row1", f"(_pair % {n_rows} + _pair div {n_rows} + 1) % {n_rows} AS row2")
    one = names.withColumnsRenamed({c: f"{c}1" for c in names.columns})
    two = names.withColumnsRenamed({c: f"{c}2" for c in names.columns})
    # Few places are sent to the names, which then need not be shuffled.
    sent = F.broadcast if stop - start <= BROADCAST_PLACES else lambda df: df
    return sent(sent(rows).join(one, "row1")).join(two, "row2").drop("row1", "row2")


def false_pairs(
    aliases: DataFrame | NameTable, n_pairs: int, *, sample_size: int | None = None, seed: int = 42
) -> DataFrame:
    """``n_pairs / 3`` pairs of names of different entities from each similarity band.

    ``sample_size`` first draws that many entities. Pairs come in turns. In the lower bands these
    are places of a random order of all pairs; similar names are
    too rare for that, so in the top band they are names in random order with all their
    partners, found by an exact similarity join. Turns are added until every band is full
    or all pairs have been looked at, and a band holds the pairs of its earliest turns, so the
    result does not depend on how many turns were made. It has the columns string1, string2,
    similarity and band (see ``band_shortfall``).
    """
    if sample_size is not None:
        held = aliases.held if isinstance(aliases, NameTable) else aliases
        chosen = seeded_sample(held.select("uid").distinct(), ["uid"], sample_size, seed)
        aliases = held.select("uid", "name").join(chosen, "uid", "left_semi")
    table = aliases if isinstance(aliases, NameTable) else name_table(aliases)
    per_band = n_pairs // (len(BAND_BOUNDS) - 1)
    n_names = table.names.count()
    unlike = stored_alone(table.names.sparkSession, lambda: _unlike(table, n_names, per_band, seed))
    found = unlike.unionByName(_alike(table, n_names, per_band, seed))
    order = [
        F.col("turn"),
        seeded_hash(["string1", "string2"], seed, "pair"),
        F.col("string1"),
        F.col("string2"),
    ]
    return top_n_per_group(found, ["band"], order, per_band).drop("turn")


def _banded(pairs: DataFrame, turn: Column) -> DataFrame:
    return pairs.select(
        F.col("name1").alias("string1"),
        F.col("name2").alias("string2"),
        "similarity",
        similarity_band(F.col("similarity")).alias("band"),
        turn.cast("bigint").alias("turn"),
    )


def _unlike(table: NameTable, n_names: int, per_band: int, seed: int) -> DataFrame:
    """The first pairs of the lower bands in a random order of all pairs, at least ``per_band`` of each if there are.

    Each round draws four times as many places as the one before, and keeps the bands not yet full.
    """
    top, names = BAND_BOUNDS[-2], table.names
    similarity = explode_if(dice(F.col("grams1"), F.col("grams2")), lambda s: s < top).alias("similarity")

    numbered = row_numbers(names, "name", n_names, "row")
    places = 1 << 2 * _half_bits(n_names * (n_names - 1) // 2)
    missing = {band: per_band for band in range(1, len(BAND_BOUNDS) - 1)}
    rounds: list[DataFrame] = []
    start, stop = 0, min(max(PLACES_PER_PAIR * per_band, 1), places)
    while start < places and (not rounds or missing):
        one, two = F.col("name1"), F.col("name2")
        apart = random_pairs(numbered, n_names, start, stop, seed).where(_apart())
        grams = apart.select("name1", "name2", "turn", table.grams("name1").alias("grams1"), table.grams("name2").alias("grams2"))
        pairs = grams.select(
            F.least(one, two).alias("name1"), F.greatest(one, two).alias("name2"), similarity, "turn"
        )
        drawn = _banded(pairs, F.col("turn"))
        rounds.append(cut_lineage(drawn.where(F.col("band").isin(list(missing)))))
        for band, found in rounds[-1].groupBy("band").count().collect():
            missing[band] -= found
        missing = {band: count for band, count in missing.items() if count > 0}
        start, stop = stop, min(stop + 4 * (stop - start), places)
    return reduce(DataFrame.unionByName, rounds)


def _alike(table: NameTable, n_names: int, per_band: int, seed: int) -> DataFrame:
    """Pairs of the top band; a pair's turn is the hash of that of its names that comes first."""
    top, asked = BAND_BOUNDS[-2], max(10 * per_band, 1)
    while True:
        anchors = seeded_sample(table.names.select("name"), ["name"], asked, seed, kept=True)
        similar = _similar_partners(anchors, table, top, asked <= BROADCAST_ANCHORS)
        turn = F.least(seeded_hash(["name1"], seed), seeded_hash(["name2"], seed))
        found = cut_lineage(_banded(similar, turn))
        if asked >= n_names or found.count() >= per_band:
            return found
        asked *= 4


def _apart() -> Column:
    """Two names belong to different entities unless one entity alone holds them both.

    Each name comes with the lowest and the highest entity that holds it.
    """
    low1, high1, low2, high2 = (F.col(c) for c in ("low1", "high1", "low2", "high2"))
    return ~((low1 == high1) & (low2 == high2) & (low1 == low2))


def _similar_partners(anchors: DataFrame, table: NameTable, threshold: float, few: bool) -> DataFrame:
    """Similar names of other entities for each anchor, each pair once and in text order."""
    made = {"grams": table.grams("name"), "bounds": table.bounds("name")}
    names = table.names.withColumns(made)
    asked = F.broadcast(anchors.select("name")) if few else anchors.select("name")
    left = cut_lineage(table.names.join(asked, "name", "left_semi")).withColumns(made)
    found = similar_texts(
        left.withColumnsRenamed({c: f"{c}1" for c in names.columns}),
        names.withColumnsRenamed({c: f"{c}2" for c in names.columns}),
        threshold,
        condition=_apart(),
        few_left=few,
    ).where(F.col("similarity") >= threshold)
    one, two = F.col("name1"), F.col("name2")
    return found.select(F.least(one, two).alias("name1"), F.greatest(one, two).alias("name2"), "similarity").distinct()


def band_shortfall(pairs: DataFrame, n_pairs: int) -> DataFrame:
    """Per band the pairs found and the pairs missing."""
    n_bands = len(BAND_BOUNDS) - 1
    bands = pairs.sparkSession.range(1, n_bands + 1).select(F.col("id").cast("int").alias("band"))
    found = pairs.groupBy("band").agg(F.count("*").alias("found"))
    return bands.join(found, "band", "left").select(
        "band",
        F.coalesce("found", F.lit(0)).alias("found"),
        (F.lit(n_pairs // n_bands) - F.coalesce("found", F.lit(0))).alias("missing"),
    )


def to_labelled_lines(pairs: DataFrame) -> DataFrame:
    """Labelled pairs as lines ``name1 : name2:T``."""
    mark = F.when(F.col("label") == 1.0, F.lit(TRUE_MARK)).otherwise(F.lit(FALSE_MARK))
    joined = F.concat_ws(f" {PAIR_SEPARATOR} ", "string1", "string2")
    return pairs.select(F.concat_ws(PAIR_SEPARATOR, joined, mark).alias("value"))


def read_labelled_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines ``name1 : name2:T`` as string1, string2 and label."""
    fields = F.split(F.col(column), PAIR_SEPARATOR)
    return lines.select(
        F.trim(F.get(fields, F.lit(0))).alias("string1"),
        F.trim(F.get(fields, F.lit(1))).alias("string2"),
        parse_label(F.get(fields, F.lit(2))).alias("label"),
    )


def training_features(labelled: DataFrame, phonetic: bool = True) -> DataFrame:
    """Feature table of labelled pairs; pairs with a missing field or name part are dropped."""
    usable = labelled.where(
        F.col("string1").isNotNull()
        & F.col("string2").isNotNull()
        & F.col("label").isNotNull()
        & has_both_parts(F.col("string1"))
        & has_both_parts(F.col("string2"))
    )
    return pair_features(usable.select("string1", "string2", "label"), phonetic)

