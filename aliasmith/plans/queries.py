"""The registered queries: each runs an operator over the whole generated tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aliasmith.functions import text
from aliasmith.functions.alignment import ngram_alignment
from aliasmith.functions.jaro import jaro_winkler
from aliasmith.functions.ngrams import dice, ngram_similarity, skip_grams
from aliasmith.functions.phonetic import double_metaphone, phonetic_similarity
from aliasmith.functions.similarity import full_name, length_difference, levenshtein_similarity
from aliasmith.operators import aggregates, aliases, codelength, datasets, evaluate, filters, models, pairs
from aliasmith.operators import projections, sampling, stopwords
from aliasmith.operators.matching import (
    BLOCK,
    MATCH_THRESHOLD,
    block_pairs,
    build_index,
    match_by_model,
    match_by_rule,
)
from aliasmith.operators.metrics import StepCounts
from aliasmith.operators.name_store import add_to_store, open_store, store_matches, write_store
from aliasmith.operators.profiles import FEATURES, pair_features
from aliasmith.plans import jobs, tables
from aliasmith.session import cut_lineage, scratch_folder
from aliasmith.sources import files, kafka, record_log
from aliasmith.streaming.match_stream import folder_sink, match_stream, once, parse_messages, plain_matches

Query = Callable[[SparkSession, str], DataFrame]

SEED = 42
TRUE_PAIR_SIMILARITY = 0.5
MODEL_PAIR_SIMILARITY = 0.7
MATCH_REGULARIZATION = 0.1
ACCEPT_PROBABILITY = 0.9
FALSE_PAIRS = 600
SAMPLE_SIZE = 100
STOPWORDS = 20
SKETCH_ERROR = 0.005
ASKED = ("ofthe,and", "en")
PAIR_KEY = ["string1", "string2"]
EVENT_MESSAGE = "event_id bigint, who struct<user_id: bigint, event_type: string>, what struct<value: double>"

_registered: dict[str, Query] = {}


def query(function: Query) -> Query:
    _registered[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_registered)


def rounded(*names: str) -> list:
    return [F.round(F.col(n), 6).alias(n) for n in names]


# Sources and sinks


@query
def read_delimited(spark, sf_dir):
    """The watch list written as a delimited file and read back with its schema."""
    path = scratch_folder(spark, "watch-list")
    files.write_delimited(tables.watch_list(spark, sf_dir), path, null_mark="null")
    return files.read_delimited(spark, path, files.WATCH_LIST, null_mark="null")


@query
def alias_lines(spark, sf_dir):
    lines = tables.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    split = aliases.split_alias_lines(lines)
    return split.select(
        "doc_id", F.size("aliases").cast("bigint").alias("n_aliases"), F.array_join("aliases", ";").alias("aliases")
    )


@query
def json_values(spark, sf_dir):
    schema = T.StructType([T.StructField("k", T.LongType())])
    return kafka.json_values(tables.table(spark, sf_dir, "events").select("props"), schema, "props")


@query
def label_by_file_name(spark, sf_dir):
    """True and false pairs written to folders of that name, read and labelled by it."""
    folder = scratch_folder(spark, "pairs")
    labelled = cut_lineage(_labelled(spark, sf_dir))
    line = F.concat_ws(" : ", "string1", "string2").alias("value")
    labelled.where("label = 1").select(line).write.text(f"{folder}/true-pairs")
    labelled.where("label = 0").select(line).write.text(f"{folder}/false-pairs")
    return files.read_pair_files(spark, folder)


# Projections and filters


@query
def flatten_struct(spark, sf_dir):
    nested = tables.table(spark, sf_dir, "events").select(
        "event_id",
        F.struct("user_id", F.struct("event_type").alias("kind")).alias("who"),
        F.struct("value").alias("what"),
    )
    return projections.flatten_struct(nested)


@query
def cast_features(spark, sf_dir):
    return projections.cast_features(tables.table(spark, sf_dir, "customer"), "c_acctbal", ["c_name"])


@query
def filter_category_in(spark, sf_dir):
    return filters.keep_categories(tables.watch_list(spark, sf_dir), BLOCK, ["fr", "de"])


@query
def filter_natural(spark, sf_dir):
    return filters.keep_natural_persons(tables.watch_list(spark, sf_dir))


@query
def drop_short_aliases(spark, sf_dir):
    return filters.drop_short_aliases(tables.watch_list(spark, sf_dir), jobs.ALIAS_COLUMNS)


@query
def explode_aliases(spark, sf_dir):
    return aliases.explode_aliases(tables.watch_list(spark, sf_dir))


@query
def valid_names(spark, sf_dir):
    return tables.watch_names(spark, sf_dir)


@query
def multiword_aliases(spark, sf_dir):
    kept = filters.multiword_aliases(tables.alias_sets(spark, sf_dir))
    return kept.select("uid", F.array_join("aliases", ";").alias("aliases"))


@query
def similarity_band(spark, sf_dir):
    similarity = ngram_similarity(F.col("string1"), F.col("string2"))
    return tables.neighbour_pairs(spark, sf_dir).withColumn(
        "band", filters.similarity_band(similarity).cast("bigint")
    )


# Blocking and pair generation


@query
def blocked_pairs(spark, sf_dir):
    """One given name compared with its whole block."""
    first = spark.createDataFrame([ASKED], ["name", BLOCK])
    names = cut_lineage(tables.watch_names(spark, sf_dir))
    scored = pair_features(block_pairs(first, names), phonetic=False)
    return scored.select("string1", "string2", "uid", "person_type", BLOCK, *rounded("ngram", "jaro_winkler"))


@query
def candidate_count(spark, sf_dir):
    return aggregates.candidate_counts(
        tables.incoming_names(spark, sf_dir).distinct(), tables.watch_names(spark, sf_dir), BLOCK
    )


@query
def true_pairs(spark, sf_dir):
    found = pairs.true_pairs(tables.watch_names(spark, sf_dir), TRUE_PAIR_SIMILARITY)
    return found.select("string1", "string2", *rounded("similarity"))


def _false_pairs(spark, sf_dir):
    return pairs.false_pairs(tables.watch_names(spark, sf_dir), FALSE_PAIRS, seed=SEED)


@query
def false_pairs_banded(spark, sf_dir):
    found = _false_pairs(spark, sf_dir)
    return found.select("string1", "string2", F.col("band").cast("bigint").alias("band"), *rounded("similarity"))


def _labelled(spark, sf_dir):
    return jobs.label_pairs(tables.watch_names(spark, sf_dir), TRUE_PAIR_SIMILARITY, FALSE_PAIRS, SEED, balance=False)


@query
def label_union(spark, sf_dir):
    return _labelled(spark, sf_dir)


@query
def balanced_pairs(spark, sf_dir):
    return sampling.balance_classes(_labelled(spark, sf_dir), "label", PAIR_KEY, SEED)


@query
def match_threshold(spark, sf_dir):
    index = build_index(tables.watch_names(spark, sf_dir))
    found = match_by_rule(tables.incoming_names(spark, sf_dir), index, MATCH_THRESHOLD)
    return found.select("string1", "string2", "uid", BLOCK, *rounded("similarity"))


# Aggregates, orders, samples


@query
def token_frequency(spark, sf_dir):
    return aggregates.token_frequency(tables.text_table(spark, sf_dir, "documents").select("text"), "text")


@query
def category_counts(spark, sf_dir):
    return aggregates.category_counts(tables.watch_list(spark, sf_dir).select(BLOCK), BLOCK)


@query
def remove_stopwords(spark, sf_dir):
    documents = tables.text_table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = documents.select("doc_id", text.clean_text(F.col("text")).alias("text"))
    # As many words as asked for, so they may come to the driver.
    stop = [row.token for row in aggregates.most_frequent_tokens(cleaned, "text", STOPWORDS).collect()]
    return stopwords.remove_stopwords(cleaned, "text", stop)


@query
def remove_stopword_table(spark, sf_dir):
    """All tokens of the benchmark removed from the conversations, as a table of any size."""
    tokens = aggregates.token_frequency(tables.table(spark, sf_dir, "benchmark").select("text"), "text").select("token")
    turns = tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return stopwords.remove_stopwords(turns, "text", tokens)


@query
def seeded_shuffle(spark, sf_dir):
    return sampling.seeded_shuffle(tables.neighbour_pairs(spark, sf_dir), PAIR_KEY, SEED)


@query
def seeded_sample(spark, sf_dir):
    return sampling.seeded_sample(tables.watch_list(spark, sf_dir).select("uid", BLOCK), ["uid"], SAMPLE_SIZE, SEED)


@query
def hash_split(spark, sf_dir):
    split = sampling.hash_split(tables.neighbour_pairs(spark, sf_dir), PAIR_KEY, [0.7, 0.3], SEED)
    return split.withColumn("split", F.col("split").cast("bigint"))


@query
def hash_folds(spark, sf_dir):
    folds = sampling.hash_folds(tables.neighbour_pairs(spark, sf_dir), PAIR_KEY, 5, SEED)
    return folds.withColumn("fold", F.col("fold").cast("bigint"))


# Scalar functions


@query
def clean_text(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query
def clean_table(spark, sf_dir):
    return aliases.clean_table(tables.table(spark, sf_dir, "conversations"))


@query
def strip_special(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select("page_id", text.strip_special(F.col("html")).alias("html"))


@query
def name_parts(spark, sf_dir):
    names = aliases.explode_aliases(tables.watch_list(spark, sf_dir)).select("name").distinct()
    return names.select(
        "name", text.last_name(F.col("name")).alias("last"), text.first_name(F.col("name")).alias("first")
    )


@query
def parse_query_message(spark, sf_dir):
    return parse_messages(tables.incoming_messages(spark, sf_dir))


@query
def parse_label(spark, sf_dir):
    marked = F.when(F.col("toxic") == 1, "?").when(F.col("quality") == 1, " T").otherwise("F ")
    return tables.table(spark, sf_dir, "labels").select("doc_id", text.parse_label(marked).alias("label"))


# Similarities


def _pair_query(spark, sf_dir, **columns):
    return tables.neighbour_pairs(spark, sf_dir).select(
        "string1", "string2", *[F.round(c, 6).alias(n) for n, c in columns.items()]
    )


@query
def ngram_similarity_pairs(spark, sf_dir):
    return _pair_query(spark, sf_dir, similarity=ngram_similarity(F.col("string1"), F.col("string2")))


@query
def jaro_winkler_pairs(spark, sf_dir):
    return _pair_query(spark, sf_dir, similarity=jaro_winkler(F.col("string1"), F.col("string2")))


@query
def ngram_alignment_pairs(spark, sf_dir):
    return _pair_query(spark, sf_dir, similarity=ngram_alignment(F.col("string1"), F.col("string2")))


@query
def levenshtein_pairs(spark, sf_dir):
    return _pair_query(spark, sf_dir, similarity=levenshtein_similarity(F.col("string1"), F.col("string2")))


@query
def fullname_similarity(spark, sf_dir):
    one, two = F.col("string1"), F.col("string2")
    firsts = ngram_similarity(text.first_name(one), text.first_name(two))
    lasts = ngram_similarity(text.last_name(one), text.last_name(two))
    return _pair_query(spark, sf_dir, similarity=full_name(firsts, lasts))


@query
def vowel_consonant_diff(spark, sf_dir):
    one, two = F.col("string1"), F.col("string2")
    return tables.neighbour_pairs(spark, sf_dir).select(
        "string1",
        "string2",
        length_difference(text.vowels(one), text.vowels(two)).cast("bigint").alias("vowel_diff"),
        length_difference(text.consonants(one), text.consonants(two)).cast("bigint").alias("consonant_diff"),
    )


@query
def code_length_diff(spark, sf_dir):
    scored = codelength.code_length_difference(tables.neighbour_pairs(spark, sf_dir))
    return scored.select("string1", "string2", *rounded("code_length_diff"))


@query
def skipgram_similarity(spark, sf_dir):
    """Consecutive turns of a conversation, by the word pairs they share."""
    turns = tables.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", skip_grams(text.clean_text(F.col("text"))).alias("grams")
    )
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("grams").alias("next_grams"))
    similarity = dice(F.col("grams"), F.col("next_grams"))
    return turns.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(similarity, 6).alias("similarity")
    )


@query
def soundex_match(spark, sf_dir):
    one, two = F.soundex(text.last_name(F.col("string1"))), F.soundex(text.last_name(F.col("string2")))
    return tables.neighbour_pairs(spark, sf_dir).select(
        "string1", "string2", one.alias("code1"), two.alias("code2"), (one == two).alias("matches")
    )


@query
def phonetic_codes(spark, sf_dir):
    names = tables.watch_names(spark, sf_dir)
    parts = F.array(text.last_name(F.col("name")), text.first_name(F.col("name")))
    words = names.select(F.explode(parts).alias("word")).distinct()
    return words.select("word", double_metaphone(F.col("word")).alias("code")).select("word", "code.*")


@query
def phonetic_similarity_pairs(spark, sf_dir):
    """Neighbouring names by the codes of their last names, coded once per distinct word."""
    found = tables.neighbour_pairs(spark, sf_dir).select(
        "*", text.last_name(F.col("string1")).alias("last1"), text.last_name(F.col("string2")).alias("last2")
    )
    found = cut_lineage(found)
    words = found.select(F.explode(F.array("last1", "last2")).alias("word")).distinct()
    codes = words.select("word", double_metaphone(F.col("word")).alias("code"))
    coded = found.join(codes.toDF("last1", "code1"), "last1").join(codes.toDF("last2", "code2"), "last2")
    return coded.select(
        "string1", "string2", F.round(phonetic_similarity(F.col("code1"), F.col("code2")), 6).alias("similarity")
    )


@query
def pair_features_ngram_jaro(spark, sf_dir):
    scored = pair_features(tables.neighbour_pairs(spark, sf_dir), phonetic=False)
    return scored.select("string1", "string2", *rounded("ngram", "jaro_winkler"))


@query
def pair_features_all(spark, sf_dir):
    scored = pair_features(tables.neighbour_pairs(spark, sf_dir))
    return scored.select("string1", "string2", *rounded(*FEATURES))


# Datasets


@query
def training_features(spark, sf_dir):
    lines = pairs.to_labelled_lines(_labelled(spark, sf_dir))
    scored = pairs.training_features(pairs.read_labelled_lines(lines), phonetic=False)
    return scored.select("string1", "string2", "label", *rounded("ngram", "jaro_winkler"))


def _assembled(spark, sf_dir):
    return datasets.assemble_features(
        tables.return_features(spark, sf_dir), "label", ["l_orderkey", "l_linenumber"]
    )


def _vector_columns(df, n):
    values = vector_to_array("features")
    return df.select(
        "l_orderkey", "l_linenumber", "label", *[F.get(values, F.lit(i)).alias(f"feature{i}") for i in range(n)]
    )


@query
def assemble_features(spark, sf_dir):
    return _vector_columns(_assembled(spark, sf_dir), 3)


@query
def slice_features(spark, sf_dir):
    return _vector_columns(datasets.slice_features(_assembled(spark, sf_dir), [0, 2]), 2)


@query
def quantile_bins(spark, sf_dir):
    lines = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return datasets.discretize_exact(lines, "l_extendedprice", "bin", 10)


@query
def bucketize(spark, sf_dir):
    lines = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return datasets.bucketize(lines, [0.0, 10.0, 20.0, 45.0], "l_quantity", "bin")


@query
def approximate_bins(spark, sf_dir):
    lines = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return datasets.discretize(lines, "l_extendedprice", "bin", 10)


@query
def sketch_bins(spark, sf_dir):
    """Edges of bins from stored sketches of each return flag, and whether their ranks are as exact as promised."""
    lines = tables.table(spark, sf_dir, "lineitem")
    sketches = cut_lineage(datasets.quantile_sketches(lines, "l_extendedprice", ["l_returnflag"]))
    shares = [i / 10 for i in range(1, 10)]
    edges = datasets.sketch_quantiles(sketches, shares)
    errors = datasets.rank_errors(lines, "l_extendedprice", edges, shares)
    return errors.select("probability", "n", (F.col("error") <= SKETCH_ERROR).alias("within"))


# Metrics


@query
def auc_hard_labels(spark, sf_dir):
    return evaluate.auc_hard_labels(tables.scored_documents(spark, sf_dir)).select(*rounded("auc"))


@query
def auc_scored(spark, sf_dir):
    return evaluate.auc_scored(tables.scored_documents(spark, sf_dir)).select(*rounded("auc"))


@query
def accuracy(spark, sf_dir):
    return evaluate.accuracy(tables.scored_documents(spark, sf_dir)).select(*rounded("accuracy"))


@query
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(tables.scored_documents(spark, sf_dir))


# Models


def _feature_vectors(spark, sf_dir):
    labelled = jobs.label_pairs(tables.watch_names(spark, sf_dir), MODEL_PAIR_SIMILARITY, FALSE_PAIRS, SEED)
    scored = pairs.training_features(labelled)
    return cut_lineage(datasets.assemble_features(scored, "label", PAIR_KEY))


def _train_and_test(spark, sf_dir):
    return sampling.train_test_split(_feature_vectors(spark, sf_dir), PAIR_KEY, [0.7, 0.3], SEED)


def _trained(spark, sf_dir, stage):
    """Test pairs with their label and the prediction of a model trained on the others."""
    train, test = _train_and_test(spark, sf_dir)
    model = models.build_model(train, [stage])
    return model.transform(test).select("string1", "string2", "label", "prediction")


@query
def train_random_forest(spark, sf_dir):
    return _trained(spark, sf_dir, models.random_forest())


@query
def train_logistic(spark, sf_dir):
    return _trained(spark, sf_dir, models.logistic_regression())


@query
def train_naive_bayes(spark, sf_dir):
    return _trained(spark, sf_dir, models.naive_bayes())


@query
def train_linear_svm(spark, sf_dir):
    return _trained(spark, sf_dir, models.linear_svm())


@query
def train_svm_gradient_descent(spark, sf_dir):
    """Weights and intercept of the linear SVM with L1 regularization."""
    model = models.svm_by_gradient_descent(_feature_vectors(spark, sf_dir))
    names = [*FEATURES, "intercept"]
    values = [*model.weights.tolist(), model.intercept]
    return spark.createDataFrame(list(zip(names, map(float, values))), "term string, weight double")


@query
def cross_validate(spark, sf_dir):
    """Mean accuracy over the folds, per regularization of a logistic regression."""
    vectors = sampling.hash_folds(_feature_vectors(spark, sf_dir), PAIR_KEY, 3, SEED)
    stage = models.logistic_regression()
    weights = [0.0, 0.01, 0.1]
    grid = ParamGridBuilder().addGrid(stage.regParam, weights).build()
    fitted = models.cross_validate(cut_lineage(vectors), grid, [stage], 3)
    rows = list(zip(weights, map(float, fitted.avgMetrics)))
    return spark.createDataFrame(rows, "regularization double, accuracy double")


@query
def evaluate_setup(spark, sf_dir):
    train, test = _train_and_test(spark, sf_dir)
    score = evaluate.evaluate_setup(train, test, [models.random_forest()])
    return spark.createDataFrame([(float(score),)], "auc double")


@query
def feature_alone(spark, sf_dir):
    train, test = _train_and_test(spark, sf_dir)
    return evaluate.evaluate_features(train, test, [models.logistic_regression()], FEATURES, alone=True)


@query
def feature_ablation(spark, sf_dir):
    train, test = _train_and_test(spark, sf_dir)
    return evaluate.evaluate_features(train, test, [models.logistic_regression()], FEATURES, alone=False)


@query
def match_batch(spark, sf_dir):
    """Names of pages matched by a regression trained on the watch list's own pairs.

    It tells similar names of one entity from names of others that are not similar, so it
    can be sure; the least n-gram similarity it accepts bounds the search.
    """
    names = cut_lineage(tables.watch_names(spark, sf_dir))
    prepared = pairs.name_table(names)
    alike = pairs.true_pairs(prepared, MODEL_PAIR_SIMILARITY).select("string1", "string2")
    unlike = pairs.false_pairs(prepared, FALSE_PAIRS, seed=SEED).where("band < 3").select("string1", "string2")
    labelled = sampling.balance_classes(sampling.union_labelled(alike, unlike), "label", PAIR_KEY, SEED)
    vectors = datasets.assemble_features(pairs.training_features(labelled), "label", PAIR_KEY)
    stage = models.logistic_regression(regularization=MATCH_REGULARIZATION, threshold=ACCEPT_PROBABILITY)
    model = models.build_model(cut_lineage(vectors), [stage])
    index = build_index(names)
    floor = models.ngram_floor(model, FEATURES)
    return match_by_model(tables.incoming_names(spark, sf_dir), index, model, floor)


# Streams


def _run_stream(spark, writer):
    running = writer.trigger(availableNow=True).start()
    try:
        running.awaitTermination()
    finally:
        running.stop()


def _message_stream(spark, messages):
    """``messages`` put into a folder of text files and read back as a stream."""
    folder = scratch_folder(spark, "messages")
    messages.write.text(folder)
    return spark.readStream.text(folder)


@query
def stream_lines(spark, sf_dir):
    target = scratch_folder(spark, "lines")
    stream = parse_messages(_message_stream(spark, tables.incoming_messages(spark, sf_dir)))
    writer = stream.writeStream.format("parquet").option("path", target)
    _run_stream(spark, writer.option("checkpointLocation", scratch_folder(spark, "lines-state")))
    return spark.read.parquet(target)


@query
def stream_json_flat(spark, sf_dir):
    schema = T.StructType.fromDDL(EVENT_MESSAGE)
    messages = _event_messages(spark, sf_dir).select("value")
    target = scratch_folder(spark, "events")
    stream = kafka.json_values(_message_stream(spark, messages), schema)
    writer = stream.writeStream.format("parquet").option("path", target)
    _run_stream(spark, writer.option("checkpointLocation", scratch_folder(spark, "events-state")))
    return spark.read.parquet(target)


def _record_log(spark):
    return {"log.dir": scratch_folder(spark, "queue"), "auto.offset.reset": "earliest"}


def _event_messages(spark, sf_dir):
    nested = F.struct("event_id", F.struct("user_id", "event_type").alias("who"), F.struct("value").alias("what"))
    return tables.table(spark, sf_dir, "events").select("event_id", F.to_json(nested).alias("value"))


@query
def queue_range(spark, sf_dir):
    """The offsets of a topic up to its ends before more was written: the messages of even events."""
    params = _record_log(spark)
    messages = _event_messages(spark, sf_dir)
    later = F.col("event_id") % 2 == 1
    kafka.write_messages(messages.where(~later), "events", params, record_log.SOURCE)
    until = record_log.topic_ends(params["log.dir"], "events").items()
    kafka.write_messages(messages.where(later), "events", params, record_log.SOURCE)
    found = kafka.read_messages(spark, "events", until, params, record_log.SOURCE)
    return kafka.json_values(found, T.StructType.fromDDL(EVENT_MESSAGE))


@query
def queue_stream(spark, sf_dir):
    """From topic to topic in limited batches and back; the same rows as ``stream_json_flat``."""
    params = _record_log(spark)
    messages = cut_lineage(_event_messages(spark, sf_dir))
    kafka.write_messages(messages, "in", params, record_log.SOURCE)
    limit = messages.count() // 3 + 1
    stream = kafka.stream_messages(spark, "in", params, limit, record_log.SOURCE)
    writer = kafka.stream_to_topic(stream, "out", params, scratch_folder(spark, "queue-state"), record_log.SOURCE)
    running = writer.start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    until = record_log.topic_ends(params["log.dir"], "out").items()
    found = kafka.read_messages(spark, "out", until, params, record_log.SOURCE)
    return kafka.json_values(found, T.StructType.fromDDL(EVENT_MESSAGE))


@query
def stream_match(spark, sf_dir):
    """The rule match of a stream of messages; the same rows as ``match_threshold``."""
    index = build_index(tables.watch_names(spark, sf_dir))
    target = scratch_folder(spark, "matches")
    writer = match_stream(
        _message_stream(spark, tables.incoming_messages(spark, sf_dir)),
        lambda asked: match_by_rule(asked, index, MATCH_THRESHOLD),
        folder_sink(target),
        scratch_folder(spark, "matches-state"),
    )
    _run_stream(spark, writer)
    found = spark.read.parquet(target)
    return found.select("string1", "string2", "uid", BLOCK, *rounded("similarity"))


def _watch_store(spark, sf_dir):
    root = scratch_folder(spark, "name-store")
    write_store(tables.watch_names(spark, sf_dir), root, MATCH_THRESHOLD)
    return open_store(spark, root)


@query
def match_store(spark, sf_dir):
    """The rule match against a stored watch list, half of which came as a delta; as ``match_threshold``."""
    root = scratch_folder(spark, "name-store")
    listed = cut_lineage(tables.watch_names(spark, sf_dir))
    later = F.pmod(F.xxhash64("uid"), F.lit(2)) == 1
    write_store(listed.where(~later), root, MATCH_THRESHOLD)
    add_to_store(listed.where(later), root)
    asked = cut_lineage(tables.incoming_names(spark, sf_dir).distinct())
    found = store_matches(asked, open_store(spark, root))
    return found.select(F.col("name").alias("string1"), "string2", "uid", BLOCK, *rounded("similarity"))


@query
def match_metrics(spark, sf_dir):
    """How many names were asked and how many matches found, counted while the matches are written."""
    counts, target = StepCounts(), scratch_folder(spark, "matches")
    asked = cut_lineage(tables.incoming_names(spark, sf_dir).distinct())
    store_matches(asked, _watch_store(spark, sf_dir), watch=counts).write.parquet(target)
    rows = counts.get()
    return spark.range(1).select(F.lit(rows["asked0"]).cast("bigint").alias("n_asked"), F.lit(rows["matches"]).cast("bigint").alias("n_matches"))


@query
def stream_match_plain(spark, sf_dir):
    """The match as a streaming plan into a plain sink; the same rows as ``match_threshold``."""
    target = scratch_folder(spark, "matches")
    stream = _message_stream(spark, tables.incoming_messages(spark, sf_dir))
    matches = plain_matches(stream, _watch_store(spark, sf_dir))
    writer = matches.writeStream.format("parquet").option("path", target)
    _run_stream(spark, writer.option("checkpointLocation", scratch_folder(spark, "matches-state")))
    return spark.read.parquet(target).select("string1", "string2", "uid", BLOCK, *rounded("similarity"))


@query
def stream_match_once(spark, sf_dir):
    """Messages that are delivered twice, the second time after a restart; the same rows as ``match_threshold``.

    A message gives the same matches whenever it comes, so its key is kept and not those of its matches,
    which are many more. An entity that lists a name twice in a block stands in the store once.
    """
    folder, target, state = (scratch_folder(spark, name) for name in ("messages", "matches", "matches-state"))
    arrived = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("value"), F.lit(3600)))
    messages = cut_lineage(tables.incoming_messages(spark, sf_dir).select("value", arrived.alias("arrived")))
    root = scratch_folder(spark, "name-store")
    write_store(tables.watch_names(spark, sf_dir).dropDuplicates(["uid", BLOCK, "name"]), root, MATCH_THRESHOLD)
    store = open_store(spark, root)
    for _ in ("first", "again"):
        messages.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(messages.schema).parquet(folder).withColumn("message", F.sha2("value", 256))
        matches = plain_matches(once(stream, ["message"], "arrived", "1 day").select("value"), store)
        writer = matches.writeStream.format("parquet").option("path", target)
        _run_stream(spark, writer.option("checkpointLocation", state))
    return spark.read.parquet(target).select("string1", "string2", "uid", BLOCK, *rounded("similarity"))
