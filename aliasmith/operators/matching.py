"""Matching names against a watch list, blocked by citizenship."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aliasmith.functions.binding import explode_if
from aliasmith.functions.ngrams import dice
from aliasmith.functions.phonetic import double_metaphone
from aliasmith.functions.similarity import FIRST_WEIGHT, LAST_WEIGHT, full_name
from aliasmith.functions.text import first_name, last_name
from aliasmith.operators.datasets import assemble_features
from aliasmith.operators.filters import valid_names
from aliasmith.operators.profiles import FEATURES, pair_features
from aliasmith.operators.simjoin import EPSILON, gram_order, ordered_grams, similar_texts
from aliasmith.operators.skew import salted_join
from aliasmith.session import cut_lineage
from aliasmith.sources.manifests import latest, publish, read_version

BLOCK = "citizenship"
# Fixed value: the weighted similarity from which the rule calls two names a match.
MATCH_THRESHOLD = 0.8
# Entities of a name that go through a join in one row.
UIDS_PER_ROW = 256


@dataclass(frozen=True)
class NameIndex:
    """A watch list prepared for matching; all tables are materialised once.

    aliases: uid, citizenship, person_type, name; one row per entity and valid name.
    names:   citizenship, name, last, first, first_grams; distinct names of a block.
    lasts:   last, grams; distinct last names.
    grams:   gram, gram_id; the global gram order.
    """

    aliases: DataFrame
    names: DataFrame
    lasts: DataFrame
    grams: DataFrame


def _with_parts(names: DataFrame) -> DataFrame:
    return names.withColumn("last", last_name(F.col("name"))).withColumn("first", first_name(F.col("name")))


def build_index(aliases: DataFrame) -> NameIndex:
    """Prepare ``uid, citizenship, person_type, name`` rows for matching."""
    rows = cut_lineage(valid_names(aliases).select("uid", BLOCK, "person_type", "name").distinct())
    parts = _with_parts(rows.select(BLOCK, "name").distinct())
    words = cut_lineage(parts.select(F.explode(F.array("last", "first")).alias("word")).distinct())
    grams = cut_lineage(gram_order(words, "word"))
    word_grams = cut_lineage(ordered_grams(words, "word", grams))
    firsts = word_grams.select(F.col("word").alias("first"), F.col("grams").alias("first_grams"))
    lasts = word_grams.select(F.col("word").alias("last"), "grams").join(
        parts.select("last").distinct(), "last", "left_semi"
    )
    return NameIndex(rows, cut_lineage(parts.join(firsts, "first")), cut_lineage(lasts), grams)


def publish_index(index: NameIndex, root: str) -> int:
    """Writes the tables of an index below ``root`` and publishes them as its next version."""
    folder = f"indexes/{uuid.uuid4().hex}"
    for name, table in vars(index).items():
        table.write.parquet(f"{root}/{folder}/{name}")
    return publish(index.aliases.sparkSession, f"{root}/versions", lambda _: {"folder": folder})


def open_index(spark: SparkSession, root: str, version: int | None = None) -> NameIndex:
    """A published version of an index, by default the latest."""
    number = latest(spark, f"{root}/versions") if version is None else version
    if number is None:
        raise ValueError(f"there is no index in {root}")
    folder = f"{root}/{read_version(spark, f'{root}/versions', number)['folder']}"
    return NameIndex(*[spark.read.parquet(f"{folder}/{name}") for name in NameIndex.__dataclass_fields__])


def block_pairs(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every query name with every valid name of its block; heavy blocks are split.

    This is the whole comparison of one or a few names with their block. For many
    names use ``similar_names``, which forms only the pairs that can match.
    """
    asked = queries.select(F.col("name").alias("string1"), BLOCK)
    offered = valid_names(aliases).select("uid", BLOCK, "person_type", F.col("name").alias("string2"))
    return salted_join(offered, asked, [BLOCK]).select("string1", "string2", "uid", "person_type", BLOCK)


def similar_names(queries: DataFrame, index: NameIndex, min_similarity: float, held: DataFrame | None = None) -> DataFrame:
    """Distinct ``string1, string2, citizenship`` with full-name n-gram similarity at least the minimum.

    The last name weighs 0.7 and the first 0.3, so a match needs a last-name similarity of
    ``(min - 0.3) / 0.7`` and, given that, a first-name similarity of ``(min - 0.7 *
    last) / 0.3``. Both are exact prefix joins: first over the distinct last names, then
    within equal block and last name over the first names. A minimum up to 0.7 bounds
    the last name only, and one up to 0.3 bounds neither: the whole block is compared.
    ``held (citizenship, string2, ...)`` goes with the listed names through the joins, which are then its
    rows and not those of ``index``, and adds its columns to the result.
    """
    asked = valid_names(queries).select("name", BLOCK).distinct()
    last_floor = (min_similarity - FIRST_WEIGHT) / LAST_WEIGHT - EPSILON
    first_floor = (min_similarity - LAST_WEIGHT) / FIRST_WEIGHT - EPSILON
    more = [] if held is None else [c for c in held.columns if c not in (BLOCK, "string2")]
    if last_floor <= 0:
        pairs = _similar_in_blocks(asked, index, min_similarity)
        return pairs if held is None else pairs.join(held, [BLOCK, "string2"])
    parts = cut_lineage(_with_parts(asked))
    words = parts.select(F.explode(F.array("last", "first")).alias("word")).distinct()
    word_grams = cut_lineage(ordered_grams(words, "word", index.grams))
    asked_lasts = word_grams.join(parts.select(F.col("last").alias("word")).distinct(), "word", "left_semi")
    lasts = similar_texts(
        asked_lasts.select(F.col("word").alias("last1"), F.col("grams").alias("grams1")),
        index.lasts.select(F.col("last").alias("last2"), F.col("grams").alias("grams2")),
        last_floor,
    ).withColumnRenamed("similarity", "last_similarity")
    # Read several times, to count the pairs of a block and last name and to form them.
    lasts = cut_lineage(lasts)
    firsts = word_grams.select(F.col("word").alias("first"), F.col("grams").alias("grams1"))
    left = (
        parts.join(firsts, "first")
        .select(F.col("name").alias("string1"), BLOCK, F.col("last").alias("last1"), "grams1")
        .repartition(4 * queries.sparkSession.sparkContext.defaultParallelism, "last1")
        .join(lasts, "last1")
        .drop("last1")
    )
    right = index.names.select(
        F.col("name").alias("string2"), BLOCK, F.col("last").alias("last2"), F.col("first_grams").alias("grams2")
    )
    if held is not None:
        right = cut_lineage(right.join(held, [BLOCK, "string2"]))
    needed = (min_similarity - LAST_WEIGHT * F.col("last_similarity")) / FIRST_WEIGHT - EPSILON
    if first_floor > 0:
        found = similar_texts(left, right, first_floor, keys=[BLOCK, "last2"], left_threshold=needed)
    else:
        found = salted_join(right, left, [BLOCK, "last2"]).withColumn("similarity", dice(F.col("grams1"), F.col("grams2")))
    weighted = full_name(F.col("similarity"), F.col("last_similarity"))
    return found.select(
        "string1", "string2", BLOCK, explode_if(weighted, lambda s: s >= min_similarity).alias("similarity"), *more
    )


def _similar_in_blocks(asked: DataFrame, index: NameIndex, min_similarity: float) -> DataFrame:
    offered = index.names.select(BLOCK, F.col("name").alias("string2"))
    pairs = salted_join(offered, asked.withColumnRenamed("name", "string1"), [BLOCK])
    scored = pair_features(pairs, phonetic=False).withColumnRenamed("ngram", "similarity")
    return scored.where(F.col("similarity") >= min_similarity).select("string1", "string2", BLOCK, "similarity")


def _code_keys(table: DataFrame, side: int) -> DataFrame:
    """One row per phonetic code of the last name; ``_codes`` holds them all."""
    codes = cut_lineage(table.select("last").distinct().withColumn("_code", double_metaphone(F.col("last"))))
    both = F.array_compact(F.array("_code.primary", "_code.alternate"))
    keys = codes.select("last", F.array_distinct(both).alias(f"_codes{side}"))
    placed = table.join(keys, "last").select("name", BLOCK, f"_codes{side}", F.explode(f"_codes{side}").alias("_key"))
    return placed.withColumnRenamed("name", f"string{side}")


def like_sounding_names(queries: DataFrame, index: NameIndex) -> DataFrame:
    """Distinct ``string1, string2, citizenship`` of a block whose last names share a phonetic code.

    For all other pairs the last names' phonetic similarity is at most 0.5, and that of the full
    names at most ``UNLIKE_PHONETIC``.
    """
    asked = _with_parts(valid_names(queries).select("name", BLOCK).distinct())
    one, two = _code_keys(asked, 1), _code_keys(index.names.select("name", BLOCK, "last"), 2)
    met = salted_join(two, one, [BLOCK, "_key"])
    # A pair meets once per shared code; it is kept at the least.
    at_least = F.array_min(F.array_intersect("_codes1", "_codes2")) == F.col("_key")
    return met.where(at_least).select("string1", "string2", BLOCK)


def match_by_rule(queries: DataFrame, index: NameIndex, min_similarity: float = MATCH_THRESHOLD) -> DataFrame:
    """Matches by weighted n-gram similarity: string1, string2, uid, citizenship, similarity."""
    pairs = similar_names(queries, index, min_similarity, entities(index))
    return pairs.select("string1", "string2", F.explode("uids").alias("uid"), BLOCK, "similarity")


def entities(index: NameIndex) -> DataFrame:
    """``citizenship, string2, uids``: the entities of each name of a block, a row per ``UIDS_PER_ROW`` or so.

    They go with the names through the joins, so that the pairs, which are far more, are not shuffled
    to meet them. A name of very many entities has several rows.
    """
    held = index.aliases.select(BLOCK, F.col("name").alias("string2"), "uid", "person_type")
    sizes = held.groupBy(BLOCK, "string2").agg(F.count("*").alias("_n")).where(F.col("_n") > UIDS_PER_ROW)
    rows = held.join(sizes, [BLOCK, "string2"], "left")
    part = F.pmod(F.xxhash64("uid", "person_type"), F.ceil(F.coalesce("_n", F.lit(1)) / UIDS_PER_ROW))
    return rows.groupBy(BLOCK, "string2", part.alias("_part")).agg(F.collect_list("uid").alias("uids")).drop("_part")


def match_by_model(
    queries: DataFrame,
    index: NameIndex,
    model: PipelineModel,
    ngram_floor: float = 0.0,
    features: Sequence[str] = FEATURES,
    unlike_floor: float = 0.0,
) -> DataFrame:
    """Matches by a trained model: string1, string2, uid, citizenship.

    The model sees one row per distinct pair of names in a block. ``ngram_floor`` is a
    proven lower bound of the n-gram feature of any pair the model accepts (see
    ``models.ngram_floor``): pairs below it are rejected without being formed.
    ``unlike_floor`` bounds it for pairs whose last names share no phonetic code: a model that only
    has this bound is asked about the pairs that share one and those above the bound. With
    neither, whole blocks are compared.
    ``features`` are those the model was trained on, in their order.
    """
    asked = valid_names(queries).select("name", BLOCK).distinct()
    if ngram_floor > FIRST_WEIGHT + EPSILON:
        candidates = similar_names(asked, index, ngram_floor - EPSILON).drop("similarity")
    elif unlike_floor > FIRST_WEIGHT + EPSILON:
        similar = similar_names(asked, index, unlike_floor - EPSILON).drop("similarity")
        candidates = similar.unionByName(like_sounding_names(asked, index)).distinct()
    else:
        offered = index.names.select(BLOCK, F.col("name").alias("string2"))
        candidates = salted_join(offered, asked.withColumnRenamed("name", "string1"), [BLOCK])
    scored = pair_features(candidates, phonetic="phonetic" in features)
    vectors = assemble_features(scored.select(*candidates.columns, *features), ignored=candidates.columns)
    scored = model.transform(vectors)
    accepted = scored.where(F.col("prediction") == 1.0).select("string1", "string2", BLOCK)
    held = index.aliases.select("uid", BLOCK, F.col("name").alias("string2"))
    return held.join(accepted, [BLOCK, "string2"]).select("string1", "string2", "uid", BLOCK)


def to_match_lines(matches: DataFrame) -> DataFrame:
    """Matches as messages ``name,uid,citizenship``."""
    return matches.select(F.concat_ws(",", "string2", "uid", BLOCK).alias("value"))
