import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import brute
from aliasmith.operators import pairs
from aliasmith.operators.aliases import explode_aliases
from aliasmith.operators.matching import build_index, match_by_model, match_by_rule, to_match_lines
from aliasmith.operators.models import load_model, ngram_floor
from aliasmith.operators.profiles import FEATURES
from aliasmith.plans import jobs
from aliasmith.plans.config import JobConfigError, as_list, read_properties, require
from aliasmith.session import SHUFFLE_CLEANUP, shared_dir, stored
from aliasmith.sources import files, kafka, record_log
from aliasmith.streaming.match_stream import folder_sink, match_stream, parse_messages

TRAIN = {
    "matching.ml.algorithm": "RandomForest",
    "dataset.columns.ignored": ",".join(jobs.IGNORED_COLUMNS),
    "dataset.columns.label": "label",
    "randomforest.trees.number": "5",
    "randomforest.depth.max": "4",
}


def watch_list(spark):
    names = brute.names(240, seed=21)
    rows = [
        (str(i), names[4 * i], "gb" if i % 3 else "fr", "i", ";".join(names[4 * i + 1 : 4 * i + 4]), "", None)
        for i in range(60)
    ]
    return spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for r in rows], files.WATCH_LIST)


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("jobs")
    files.write_delimited(watch_list(spark), str(folder / "aliases"))
    conf = {
        **TRAIN,
        "pairs.similarity.min": "0.2",
        "pairs.false.number": "60",
        "dataset.local.classpath": str(folder / "features"),
        "matching.model.destination": str(folder / "model"),
        "dataset.aliases.file": str(folder / "aliases"),
        "checkpoint.location": str(folder / "state"),
    }
    jobs.prepare_job(spark, conf)
    jobs.train_job(spark, conf)
    return folder, conf


def drain(writer):
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()


def messages(spark, folder):
    folder.mkdir()
    asked = brute.names(30, seed=22) + brute.names(240, seed=21)[:10]
    (folder / "a.txt").write_text("".join(f'"{n}";{"gb" if i % 2 else "fr"}\n' for i, n in enumerate(asked)))
    return spark.readStream.text(str(folder)), spark.read.text(str(folder))


def test_configuration_is_checked(spark):
    with pytest.raises(JobConfigError, match="empty"):
        jobs.train_job(spark, {})
    with pytest.raises(JobConfigError, match="matching.model.destination"):
        jobs.train_job(spark, {"dataset.local.classpath": "x", "matching.ml.algorithm": "LOGREGRESS"})
    with pytest.raises(JobConfigError, match="empty"):
        jobs.match_stream_job(spark, {}, {})
    assert require({"a": 1}, "a") == [1]
    assert as_list("a, b,") == ["a", "b"] and as_list(["x"]) == ["x"]
    assert read_properties("# c\na.b=1\n\nc = x=y\n") == {"a.b": "1", "c": "x=y"}


def test_the_feature_file_has_the_columns_of_a_training_file(spark, trained):
    folder, conf = trained
    rows = files.read_delimited(spark, conf["dataset.local.classpath"], jobs.FEATURE_TABLE, separator=";").collect()
    assert rows and {r.label for r in rows} == {"1.0", "0.0"}
    known = {r.uid: r for r in watch_list(spark).collect()}
    for r in rows:
        held = known[r.uid]
        assert r.citizenship == held.citizenship and r.string2 in [held.name, *held.aliases.split(";")]
        assert 0.0 <= float(r.ngram) <= 1.0


def test_ignored_features_are_left_out_when_matching(spark, trained, tmp_path):
    folder, conf = trained
    ignored = ",".join([*jobs.IGNORED_COLUMNS, "phonetic"])
    conf = {**conf, "dataset.columns.ignored": ignored, "matching.model.destination": str(tmp_path / "model")}
    assert jobs.trained_features(conf) == ("ngram", "jaro_winkler")
    assert jobs.train_job(spark, conf).stages[-1].numFeatures == 2
    stream, _ = messages(spark, tmp_path / "in")
    target = str(tmp_path / "out")
    conf["checkpoint.location"] = str(tmp_path / "state")
    drain(jobs.match_stream_job(spark, conf, {}, messages=stream, sink=folder_sink(target)))
    assert spark.read.parquet(target).count() > 0


def test_jobs_run_from_a_file_of_settings(spark, trained, tmp_path, capsys):
    from aliasmith.__main__ import main

    _, conf = trained
    conf = {**conf, "matching.model.destination": str(tmp_path / "model")}
    (tmp_path / "settings").write_text("".join(f"{k}={v}\n" for k, v in conf.items()))
    assert main(["train", str(tmp_path / "settings")]) == 0
    load_model(str(tmp_path / "model"))
    (tmp_path / "empty").write_text("")
    assert main(["prepare", str(tmp_path / "empty")]) == 1 and "empty" in capsys.readouterr().err
    assert main(["drop"]) == 2


def test_more_than_two_classes_are_refused(spark, trained):
    _, conf = trained
    with pytest.raises(JobConfigError, match="two classes"):
        jobs.train_job(spark, {**conf, "randomforest.classes.number": "3"})


def test_unsupported_algorithm_is_a_configuration_error(spark, trained):
    _, conf = trained
    with pytest.raises(JobConfigError, match="not supported"):
        jobs.train_job(spark, {**conf, "matching.ml.algorithm": "PERCEPTRON"})


def test_logistic_regression_takes_its_settings(spark):
    features = jobs.labelled_features(watch_list(spark), 0.2, 60)
    conf = {"matching.ml.algorithm": "LOGREGRESS", "logregression.treshold": "0.7", "logregression.iter.max": "9.0"}
    model = jobs.train(features, {**conf, "dataset.columns.ignored": "string1,string2"}).stages[-1]
    assert model.getThreshold() == 0.7 and model.getMaxIter() == 9


def test_prepare_watch_list(spark):
    raw = spark.createDataFrame(
        [("1", "Müller,Jo", "de", "i", "Mül-ler,J;x", None, ""), ("2", "ACME", "de", "e", "", "", ""), ("3", "A,B", "us", "i", "", "", "")],
        files.WATCH_LIST,
    )
    (row,) = jobs.prepare_watch_list(raw, ["de"]).collect()
    assert (row.uid, row.name, row.aliases) == ("1", "muller,jo", "muller,j")


def test_stream_job_gives_the_batch_matches(spark, trained, tmp_path):
    folder, conf = trained
    stream, batch = messages(spark, tmp_path / "in")
    target = str(tmp_path / "out")
    drain(jobs.match_stream_job(spark, conf, {}, messages=stream, sink=folder_sink(target)))
    model = load_model(conf["matching.model.destination"])
    aliases = explode_aliases(files.read_delimited(spark, str(folder / "aliases"), files.WATCH_LIST))
    expected = match_by_model(parse_messages(batch), build_index(aliases), model, ngram_floor(model, FEATURES))
    found = spark.read.parquet(target).select(expected.columns).collect()
    assert found and sorted(found) == sorted(expected.collect())


def test_stream_job_from_topic_to_topic(spark, trained, tmp_path):
    folder, conf = trained
    _, batch = messages(spark, tmp_path / "in")
    params = {"log.dir": str(tmp_path / "queue"), "auto.offset.reset": "earliest"}
    kafka.write_messages(batch, "names", params, record_log.SOURCE)
    conf = {**conf, "queue.source": record_log.SOURCE, "input.topic": "names", "output.topic": "matches"}
    drain(jobs.match_stream_job(spark, {**conf, "checkpoint.location": str(tmp_path / "state")}, params))
    until = record_log.topic_ends(params["log.dir"], "matches").items()
    found = kafka.read_messages(spark, "matches", until, params, record_log.SOURCE).collect()
    model = load_model(conf["matching.model.destination"])
    aliases = explode_aliases(files.read_delimited(spark, str(folder / "aliases"), files.WATCH_LIST))
    expected = match_by_model(parse_messages(batch), build_index(aliases), model, ngram_floor(model, FEATURES))
    assert found and sorted(found) == sorted(to_match_lines(expected).collect())


def test_micro_batches_leave_no_tables_behind(spark, tmp_path):
    made = []

    def matcher(asked):
        made.append(asked.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("///", "/"))
        assert Path(made[-1]).exists()
        return asked

    stream, _ = messages(spark, tmp_path / "in")
    target = str(tmp_path / "out")
    drain(match_stream(stream, matcher, folder_sink(target), str(tmp_path / "state")))
    assert spark.read.parquet(target).count() > 0
    assert made and not any(Path(folder).exists() for folder in made)


def test_rule_stream_gives_the_batch_matches(spark, trained, tmp_path):
    index = build_index(explode_aliases(watch_list(spark)))
    stream, batch = messages(spark, tmp_path / "in")
    target = str(tmp_path / "out")
    drain(match_stream(stream, lambda q: match_by_rule(q, index, 0.8), folder_sink(target), str(tmp_path / "state")))
    expected = match_by_rule(parse_messages(batch), index, 0.8)
    found = spark.read.parquet(target).select(expected.columns).collect()
    assert found and sorted(found) == sorted(expected.collect())


def test_false_pairs_leave_no_tables_when_true_pairs_are_formed(spark, monkeypatch):
    shared = Path(shared_dir(spark).removeprefix("file:"))
    before, kept = set(shared.iterdir()), []
    formed = jobs.true_pairs

    def watched(table, least):
        kept.extend(p.name.split("-")[0] for p in set(shared.iterdir()) - before)
        return formed(table, least)

    monkeypatch.setattr(jobs, "true_pairs", watched)
    rows = [(str(i // 5), name) for i, name in enumerate(brute.names(60, seed=9))]
    table = spark.createDataFrame(rows, "uid string, name string")
    labelled = jobs.label_pairs(table, 0.3, 30, balance=False).collect()
    assert sorted(kept) == ["alone", "table"]
    whole = jobs.union_labelled(pairs.true_pairs(table, 0.3).drop("similarity"), pairs.false_pairs(table, 30, seed=42).select("string1", "string2"))
    assert sorted(labelled) == sorted(whole.collect())


def test_shuffles_of_a_stored_table_go_with_its_query(spark):
    def shuffles():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in files.split("\n") if "/shuffle_" in f}

    before = shuffles()
    table = stored(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count())
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before
    assert table.count() == 100
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"
