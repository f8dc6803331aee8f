"""The preparation, training and matching jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StringType, StructField, StructType

from aliasmith.operators.aliases import clean_table, explode_aliases
from aliasmith.operators.datasets import LABEL_COLUMN, assemble_features
from aliasmith.operators.filters import drop_short_aliases, keep_categories, keep_natural_persons, valid_names
from aliasmith.operators.matching import (
    BLOCK,
    NameIndex,
    build_index,
    match_by_model,
    open_index,
    publish_index,
    to_match_lines,
)
from aliasmith.operators.models import UnsupportedAlgorithm, build_model, estimator, load_model, ngram_floor, save_model, unlike_floor
from aliasmith.operators.pairs import NameTable, false_pairs, held_names, name_table_of, training_features, true_pairs
from aliasmith.operators.profiles import FEATURES
from aliasmith.operators.sampling import balance_classes, union_labelled
from aliasmith.plans.config import JobConfigError, as_list, require
from aliasmith.session import cut_lineage, stored_alone, temporary_tables
from aliasmith.sources.files import WATCH_LIST, read_delimited, write_delimited
from aliasmith.sources.kafka import QUEUE, stream_messages, write_messages
from aliasmith.streaming.match_stream import match_stream, match_stream_refreshed

ALIAS_COLUMNS = ("aliases", "low_quality_aliases", "alternative_spelling")
FEATURE_TABLE = StructType(
    [
        StructField(c, StringType())
        for c in ("string1", "string2", "uid", "person_type", "citizenship", *FEATURES, LABEL_COLUMN)
    ]
)
IGNORED_COLUMNS = ("string1", "string2", "uid", "person_type", "citizenship")

# The setting names of existing configurations, of the forest and the regression,
# with the estimator argument and type of each.
_ALGORITHM_SETTINGS = {
    "RANDOMFOREST": {
        "randomforest.trees.number": ("trees", int),
        "randomforest.bins.max": ("bins", int),
        "randomforest.depth.max": ("depth", int),
        "randomforest.impurity": ("impurity", str),
        "randomforest.fs.strategy": ("subset", str),
        "randomforest.memory.max": ("memory", int),
    },
    "LOGREGRESS": {
        "logregression.iter.max": ("iterations", lambda v: int(float(v))),
        "logregression.regparam": ("regularization", float),
        "logregression.elasticnetparam": ("elastic_net", float),
        "logregression.family": ("family", str),
        "logregression.treshold": ("threshold", float),
    },
}


def prepare_watch_list(raw: DataFrame, citizenships: Sequence[str] | None = None) -> DataFrame:
    """Cleaned rows of natural persons whose alias lists hold only full names."""
    persons = keep_natural_persons(clean_table(raw))
    if citizenships is not None:
        persons = keep_categories(persons, BLOCK, citizenships)
    return drop_short_aliases(persons, ALIAS_COLUMNS)


def label_pairs(
    aliases: DataFrame, min_similarity: float, n_false: int, seed: int = 42, balance: bool = True
) -> DataFrame:
    """True and false pairs of one alias table with their labels, balanced if asked.

    The distinct names, which only false pairs need, are gone before true pairs are formed.
    """
    held, ids = held_names(aliases), []

    def unlike() -> DataFrame:
        names = name_table_of(held)
        ids.append(names.ids)
        return false_pairs(names, n_false, seed=seed).select("string1", "string2")

    others = stored_alone(held.sparkSession, unlike)
    named = held.where(F.col("name").isNotNull())
    matches = true_pairs(NameTable(named, None, ids[0]), min_similarity).select("string1", "string2")
    labelled = union_labelled(matches, others)
    return balance_classes(labelled, LABEL_COLUMN, ["string1", "string2"], seed) if balance else labelled


def labelled_features(watch_list: DataFrame, min_similarity: float, n_false: int, seed: int = 42) -> DataFrame:
    """From a watch list to the feature table a classifier is trained on."""
    aliases = valid_names(explode_aliases(watch_list))
    return training_features(label_pairs(aliases, min_similarity, n_false, seed))


def feature_file(watch_list: DataFrame, pairs: DataFrame) -> DataFrame:
    """The nine columns a training file has, from scored pairs ``string1, string2, label`` and features.

    The second name of a pair brings the entity: of several that hold it, the lowest.
    """
    aliases = valid_names(explode_aliases(watch_list))
    held = aliases.groupBy(F.col("name").alias("string2")).agg(F.min(F.struct("uid", "person_type", BLOCK)).alias("held"))
    return pairs.join(held, "string2", "left").select("string1", "string2", "held.*", *FEATURES, LABEL_COLUMN)


def prepare_job(spark: SparkSession, conf: Mapping[str, object]) -> DataFrame:
    """From a raw watch-list file to the feature file that ``train_job`` reads; returns its rows."""
    source, target = require(conf, "dataset.aliases.file", "dataset.local.classpath")
    least = float(conf.get("pairs.similarity.min", 0.3))
    n_false = int(conf.get("pairs.false.number", 3000))
    raw = read_delimited(spark, str(source), WATCH_LIST)
    prepared = cut_lineage(prepare_watch_list(raw, as_list(conf.get("dataset.citizenships")) or None))
    # Only natural persons are left.
    persons = prepared.withColumn("person_type", F.lit(None).cast("string"))
    rows = cut_lineage(feature_file(persons, labelled_features(persons, least, n_false)))
    write_delimited(rows, str(target), ";")
    return rows


def trained_features(conf: Mapping[str, object]) -> tuple[str, ...]:
    """The features a model with these settings is trained on, in the order of the feature file."""
    ignored = set(as_list(conf.get("dataset.columns.ignored")))
    return tuple(f for f in FEATURES if f not in ignored)


def train(features: DataFrame, conf: Mapping[str, object]) -> PipelineModel:
    """Train the configured algorithm on a feature table."""
    (algorithm,) = require(conf, "matching.ml.algorithm")
    classes = conf.get("randomforest.classes.number")
    if classes not in (None, "") and int(classes) != 2:
        raise JobConfigError(f"names match or do not match: two classes, not {classes}")
    chosen = _ALGORITHM_SETTINGS.get(str(algorithm).upper(), {})
    settings = {arg: kind(conf[key]) for key, (arg, kind) in chosen.items() if key in conf}
    try:
        stage = estimator(str(algorithm), settings)
    except UnsupportedAlgorithm as error:
        raise JobConfigError(str(error)) from None
    label = str(conf.get("dataset.columns.label", LABEL_COLUMN))
    ignored = [c for c in as_list(conf.get("dataset.columns.ignored")) if c in features.columns]
    vectors = assemble_features(features, label, ignored).withColumnRenamed(label, LABEL_COLUMN)
    return build_model(cut_lineage(vectors), [stage])


def train_job(spark: SparkSession, conf: Mapping[str, object]) -> PipelineModel:
    """Train from a ``;``-separated feature file and save the model, replacing an older one."""
    path, destination, _ = require(
        conf, "dataset.local.classpath", "matching.model.destination", "matching.ml.algorithm"
    )
    model = train(read_delimited(spark, str(path), FEATURE_TABLE, separator=";"), conf)
    save_model(model, str(destination))
    return model


def match_stream_job(
    spark: SparkSession,
    conf: Mapping[str, object],
    kafka: Mapping[str, object],
    messages: DataFrame | None = None,
    sink=None,
) -> DataStreamWriter:
    """Match messages of the input topic against a watch-list file; matches go to the output topic.

    ``messages`` and ``sink`` replace the topics, for other transports. With ``index.location``
    each micro-batch takes the newest index that ``index_job`` has published there; otherwise the
    watch list is read when the job starts. The writer is returned unstarted, so that the caller
    sets its trigger. ``queue.source`` names another connector of the topics, such as ``record_log``.
    """
    model_path, checkpoint = require(conf, "matching.model.destination", "checkpoint.location")
    source = str(conf.get("queue.source", QUEUE))
    if messages is None:
        (topic,) = require(conf, "input.topic")
        limit = conf.get("input.max.per.batch")
        messages = stream_messages(spark, str(topic), kafka, int(limit) if limit else None, source)
    if sink is None:
        (output,) = require(conf, "output.topic")

        def sink(matches: DataFrame, batch_id: int) -> None:
            write_messages(to_match_lines(matches), str(output), kafka, source)

    model = load_model(str(model_path))
    features = trained_features(conf)
    floor, apart = ngram_floor(model, features), unlike_floor(model, features)

    def matched(asked: DataFrame, index: NameIndex) -> DataFrame:
        return match_by_model(asked, index, model, floor, features, apart)

    root = conf.get("index.location")
    if root:
        return match_stream_refreshed(messages, str(root), open_index, matched, sink, str(checkpoint))
    index = _index_of_file(spark, conf)
    return match_stream(messages, lambda asked: matched(asked, index), sink, str(checkpoint))


def _index_of_file(spark: SparkSession, conf: Mapping[str, object]) -> NameIndex:
    (path,) = require(conf, "dataset.aliases.file")
    return build_index(explode_aliases(read_delimited(spark, str(path), WATCH_LIST)))


def index_job(spark: SparkSession, conf: Mapping[str, object]) -> int:
    """Publish the watch-list file as the next version of the index; running streams go over to it."""
    (root,) = require(conf, "index.location")
    with temporary_tables(spark):
        return publish_index(_index_of_file(spark, conf), str(root))
