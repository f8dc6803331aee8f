"""Streams against stored watch lists: refresh, plain plans, repetitions, counts."""

import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import brute
from aliasmith.operators.aggregates import candidate_counts
from aliasmith.operators.filters import valid_names
from aliasmith.operators.matching import block_pairs, build_index, match_by_rule, open_index, publish_index
from aliasmith.operators.metrics import StepCounts, batch_counts, compare_with_blocks, stream_counts
from aliasmith.operators.name_store import add_to_store, open_store, store_matches, write_store
from aliasmith.streaming.match_stream import folder_sink, match_stream, match_stream_refreshed, once, plain_matches

ALIASES = "uid string, citizenship string, person_type string, name string"
NAMES = brute.names(60, seed=5)
START = datetime(2026, 1, 1)


def listed(spark, names, first=0):
    return spark.createDataFrame([(str(first + i), "xx", "i", n) for i, n in enumerate(names)], ALIASES)


def drain(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def send(spark, folder, names, at=START):
    rows = [(f'"{n}";xx', at + timedelta(seconds=i), f"m{i}") for i, n in enumerate(names)]
    spark.createDataFrame(rows, "value string, arrived timestamp, message string").coalesce(1).write.mode("append").parquet(folder)


def read(spark, folder):
    return spark.readStream.schema("value string, arrived timestamp, message string").parquet(folder)


@pytest.mark.parametrize("kind", ["store", "index"])
def test_a_version_that_appears_between_two_batches_matches_later_messages_only(spark, tmp_path, kind):
    root, inbox, target, state = (str(tmp_path / name) for name in ("list", "in", "out", "state"))
    old, new = NAMES[0], NAMES[1]

    def published(names, removed=()):
        if kind == "index":
            return publish_index(build_index(listed(spark, names)), root)
        if not removed:
            return write_store(listed(spark, names), root)
        gone = spark.createDataFrame([(uid,) for uid in removed], "uid string")
        return add_to_store(listed(spark, names, 10), root, gone)

    def run():
        if kind == "index":
            match = lambda asked, index: match_by_rule(asked, index, 0.99).select("string1")
            opener = open_index
        else:
            match = lambda asked, store: store_matches(asked, store, 0.99).select(F.col("name").alias("string1"))
            opener = open_store
        drain(match_stream_refreshed(read(spark, inbox), root, opener, match, folder_sink(target), state))
        rows = spark.read.parquet(target).select("batch_id", "string1").collect()
        return sorted((r.batch_id, r.string1) for r in rows)

    assert published([old]) == 1
    send(spark, inbox, [old, new])
    assert run() == [(0, old)]
    assert published([new], ["0"]) == 2
    send(spark, inbox, [old, new])
    assert run() == [(0, old), (1, new)]
    # The first two batches are repeated after their commits were lost: each takes its own version again.
    published([old, new], ["10"])
    shutil.rmtree(f"{state}/commits")
    send(spark, inbox, [old])
    assert run()[:2] == [(0, old), (1, new)]


def test_plain_stream_gives_the_batch_matches_without_code_per_batch(spark, tmp_path):
    root, inbox, target = (str(tmp_path / name) for name in ("list", "in", "out"))
    write_store(listed(spark, NAMES), root, per_split=5)
    store = open_store(spark, root)
    send(spark, inbox, [*NAMES[:20], "nobody", "x,"])
    matches = plain_matches(read(spark, inbox), store)
    assert matches.isStreaming and matches.columns[:2] == ["arrived", "message"]
    drain(matches.writeStream.format("parquet").option("path", target).option("checkpointLocation", str(tmp_path / "state")))
    got = sorted((r.string1, r.string2, r.uid) for r in spark.read.parquet(target).collect())
    wanted = sorted((q, n, str(i)) for q in NAMES[:20] for i, n in enumerate(NAMES) if brute.full_dice(q, n) >= 0.8)
    assert got == wanted and len(wanted) >= 20


def test_repeated_messages_match_once_and_late_ones_are_dropped(spark, tmp_path):
    root, inbox, target, state = (str(tmp_path / name) for name in ("list", "in", "out", "state"))
    write_store(listed(spark, NAMES[:5]), root)
    store = open_store(spark, root)

    def run():
        stream = once(plain_matches(read(spark, inbox), store), ["message", "uid"], "arrived", "1 hour")
        drain(stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", state))
        return sorted(r.message for r in spark.read.parquet(target).collect() if r.string1 == r.string2)

    send(spark, inbox, NAMES[:3])
    assert run() == ["m0", "m1", "m2"]
    send(spark, inbox, NAMES[:4])  # delivered again, with one more
    assert run() == ["m0", "m1", "m2", "m3"]
    send(spark, inbox, [NAMES[4]], START + timedelta(hours=5))  # moves the watermark; m0 again, with a new time
    assert run() == ["m0", "m0", "m1", "m2", "m3"]
    send(spark, inbox, NAMES[:5], START)  # older than the watermark
    assert run() == ["m0", "m0", "m1", "m2", "m3"]


def test_counts_of_one_pass_equal_the_counts_of_a_second(spark):
    aliases, asked = listed(spark, NAMES), listed(spark, NAMES[:7]).select("name", "citizenship").union(
        spark.createDataFrame([("a,b", "yy"), ("single", "xx")], "name string, citizenship string")
    )
    counts = StepCounts()
    found = compare_with_blocks(asked, aliases, 0.8, counts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    expected = candidate_counts(valid_names(asked), valid_names(aliases), "citizenship").agg(F.sum("n_pairs")).first()[0]
    assert counts.get() == {"candidates": expected, "matches": len(rows)} and expected == block_pairs(valid_names(asked), aliases).count()
    # The pairs are formed once: one join of the two sides, besides that of the few split keys.
    assert plan.count("CollectMetrics candidates") == 1
    assert {(r.string1, r.string2) for r in rows} == {
        (q, n) for q in NAMES[:7] for n in NAMES if brute.full_dice(q, n) >= 0.8
    }
    with pytest.raises(ValueError):
        counts(found, "matches")


def test_counts_of_micro_batches(spark, tmp_path):
    root, inbox = str(tmp_path / "list"), str(tmp_path / "in")
    write_store(listed(spark, NAMES), root)
    send(spark, inbox, [*NAMES[:6], "nobody"])
    matches = plain_matches(read(spark, inbox), open_store(spark, root), watch=stream_counts)
    target = str(tmp_path / "out")
    query = drain(matches.writeStream.format("parquet").option("path", target).option("checkpointLocation", str(tmp_path / "state")))
    (rows,) = batch_counts(query)
    assert rows["asked0"] == 6 and rows["matches"] == spark.read.parquet(target).count()
    assert rows["candidates0"] >= rows["matches"]


def test_a_micro_batch_is_planned_like_a_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('"meyer,anna";de\n')
    settings, names = [], []

    def matcher(asked):
        settings.append(asked.sparkSession.conf.get("spark.sql.adaptive.enabled"))
        return asked

    stream = spark.readStream.text(str(tmp_path / "in"))
    writer = match_stream(stream, matcher, lambda df, _: names.extend(map(tuple, df.collect())), str(tmp_path / "state"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert settings == ["true"] and names == [("meyer,anna", "de")]


@pytest.fixture
def few_tables(spark, tmp_path):
    """Tables of a watch list with a name twice in one entity and many times over, and pages that ask for it."""
    texts = [(1, "x smith, anna likes jones, bob.", "en"), (2, "smith, anna met smith, anne.", "en"), (2, "smyth, anna", "en"), (3, None, None)]
    spark.createDataFrame(texts, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (2, 0), (2, 1)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    pages = [("https://a.org/en/1", "smith, anna and jones, bobby"), ("https://a.org/en/2", "smith, anna"), ("https://a.org/de/2", "smith, anna"), (None, None)]
    spark.createDataFrame(pages, "url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    return str(tmp_path)


def test_messages_that_come_twice_keep_their_own_keys_and_not_those_of_their_matches(spark, few_tables, monkeypatch):
    from aliasmith.plans import queries

    seen, real = [], queries.once
    monkeypatch.setattr(queries, "once", lambda df, keys, *more: seen.append((df.columns, keys)) or real(df, keys, *more))
    found = sorted(map(tuple, queries.stream_match_once(spark, few_tables).collect()))
    assert [keys for _, keys in seen] == [["message"]] * 2 and all("string2" not in columns for columns, _ in seen)
    assert found == sorted(map(tuple, queries.match_threshold(spark, few_tables).distinct().collect()))
    assert {(a, b, uid) for a, b, uid, _, _ in found} >= {("smith,anna", "smith,anna", "1"), ("smith,anna", "smith,anna", "2")}
