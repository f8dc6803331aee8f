"""Language identification by character models, with calibrated rejection.

The counts of all grams in all labelled texts are summed by Spark. Continuation counts, discounts
and back-off weights of every language come from them by ``groupBy`` and joins, and the model is
written to the shared folder as sorted shards of hashed keys, whose number follows from the rows.
Nothing is left out, and only the names of the languages and the shards' ranges come to the
driver. Tasks that score read the shards one after the other, once for many characters, and keep
as many as ``_HELD_ROWS`` allows; the folder must be in a file system that pyarrow reaches.
Reference values for the confidence and for rejection come from all labelled texts, which are
scored by the models; Spark sums whole numbers, so that the result does not depend on the order.

A text gets the language in which its mean cross-entropy is lowest, of equal ones the first by
code point. The score is the chance of that language, at the temperature at which the mean
score of the labelled sample is its share of right answers. A text is rejected if it has no
letter, or if its cross-entropy is more than ``rejection`` of the way from the one that a share
``QUANTILE`` of the labelled texts of its language do not exceed to that of characters drawn evenly.

Defined results: a null text and a text without letters are ``und`` with score 0 and rejected;
without any labelled text all are ``und``; a language of the models without a text to score has
the limit of characters drawn evenly; rows are kept as often as they occur; other columns
are kept by the filter and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aliasmith.llm.batches import record_batch, slices
from aliasmith.llm.charmodel import ORDER, GramCounts, Model, Shard, has_letter, keys_of
from aliasmith.llm.token_store import open_folder
from aliasmith.session import stored

UNDETERMINED = "und"
REJECTION = 0.5
QUANTILE = 0.95
_ROWS = 1024
_SCORED_ROWS, _SCORED_BYTES = 2048, 1 << 22
_SHARD_ROWS = 1 << 18
_HELD_ROWS = 1 << 22
_TEMPERATURES = 2.0 ** np.arange(-10, 3)
# Cross-entropies are counted in steps, and chances summed in units, of this part of one.
_STEPS = 1 << 10
_UNITS = 1 << 20


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null without an id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


@dataclass(frozen=True)
class Identifier:
    """``highest``: by language, the cross-entropy up to which its labelled texts count as usual."""

    model: Model
    highest: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None], rejection: float) -> tuple[list[str], list[float], list[bool]]:
        languages, scores, rejected = [], [], []
        plain = [text or "" for text in texts]
        if not self.model.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
        sizes, entropies = self.model.entropies(plain)
        best = entropies.argmin(axis=1)
        chances = posterior(sizes, entropies, self.temperature)
        limits = self.highest + rejection * np.maximum(-self.model.floor - self.highest, 0.0)
        for i, text in enumerate(plain):
            if not has_letter(text):
                languages.append(UNDETERMINED)
                scores.append(0.0)
                rejected.append(True)
                continue
            k = best[i]
            languages.append(self.model.languages[k])
            scores.append(float(chances[i, k]))
            rejected.append(bool(entropies[i, k] > limits[k]))
        return languages, scores, rejected


def posterior(sizes: np.ndarray, entropies: np.ndarray, temperature: float) -> np.ndarray:
    logs = -entropies * (sizes * temperature)[:, None]
    chances = np.exp(logs - logs.max(axis=1, keepdims=True))
    return chances / chances.sum(axis=1, keepdims=True)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` over all labelled texts ``(text, lang)``."""
    types = {"lang": pa.string(), "gram": pa.string(), "n": pa.int64()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = GramCounts()

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, grams, numbers in counts.rows():
                yield record_batch({"lang": [lang] * len(grams), "gram": grams, "n": numbers}, types)

        for batch in slices(batches, _ROWS):
            by_language: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_language.setdefault(lang, []).append(text)
            for lang, texts in by_language.items():
                counts.add(lang, texts)
            if counts.full:
                counts.merge()
                if counts.full:
                    yield from emptied()
        yield from emptied()

    partial = labelled.select(F.col("text").cast("string"), "lang").mapInArrow(count, "lang string, gram string, n bigint")
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _levels(counts: DataFrame) -> list[DataFrame]:
    """``(lang, gram, n)`` of grams of 1 to ``ORDER`` characters; the shorter count the characters they stand after."""
    found = [counts]
    for _ in range(ORDER - 1):
        ending = F.substring("gram", 2, ORDER).alias("gram")
        found.insert(0, stored(found[0].groupBy("lang", ending).agg(F.count("*").alias("n")), "gram-counts"))
    return found


def _entries(levels: list[DataFrame], floor: float) -> DataFrame:
    """``(lang, gram, context, value)``: what every known gram and context adds, see ``charmodel``."""
    entries, chances = None, None
    for size, level in enumerate(levels, 1):
        once, twice = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discount = F.least(F.lit(0.9), F.greatest(F.lit(0.1), once / F.greatest(once + 2 * twice, F.lit(1))))
        # One row per language.
        discounts = F.broadcast(level.groupBy("lang").agg(discount.alias("discount")))
        cut = level.withColumn("context", F.substring("gram", 1, size - 1))
        contexts = cut.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        back = (F.col("discount") * F.col("kinds") / F.col("total")).alias("back")
        contexts = stored(contexts.join(discounts, "lang").select("lang", "context", "total", "discount", back), "contexts")
        known = cut.join(F.broadcast(contexts) if size == 1 else contexts, ["lang", "context"])
        if chances is None:
            known = known.withColumn("lower", F.lit(floor))
        else:
            lower = chances.select("lang", F.col("gram").alias("ending"), F.col("chance").alias("lower"))
            known = known.withColumn("ending", F.substring("gram", 2, size)).join(lower, ["lang", "ending"])
        own = F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total")
        left = F.col("back") * F.col("lower")
        chances = stored(known.select("lang", "gram", (own + left).alias("chance"), F.log((own + left) / left).alias("value")), "chances")
        grams = chances.select("lang", "gram", F.lit(False).alias("context"), "value")
        backs = contexts.select("lang", F.col("context").alias("gram"), F.lit(True).alias("context"), F.log("back").alias("value"))
        entries = grams.unionAll(backs) if entries is None else entries.unionAll(grams).unionAll(backs)
    return entries


_loaded: dict[str, Shard] = {}


@dataclass(frozen=True)
class StoredShard:
    """A file of rows sorted by key, and its first and last key."""

    address: str
    first: int
    last: int
    rows: int

    def load(self) -> Shard:
        """The rows; a task keeps shards of one model while there is room."""
        if self.address in _loaded:
            return _loaded[self.address]
        files, path = open_folder(self.address)
        table = pq.read_table(path, filesystem=files, columns=["key", "lang", "value"], partitioning=None)
        shard = Shard(*(table.column(c).to_numpy() for c in ("key", "lang", "value")))
        folder = self.address.rsplit("/", 1)[0]
        if any(address.rsplit("/", 1)[0] != folder for address in _loaded):
            _loaded.clear()
        if sum(len(s.keys) for s in _loaded.values()) + self.rows <= _HELD_ROWS:
            _loaded[self.address] = shard
        return shard


def _shards(entries: DataFrame, languages: list[str]) -> list[StoredShard]:
    """The entries with hashed keys, sorted, in files that each hold a range of keys."""
    place = {name: i for i, name in enumerate(languages)}
    types = {"key": pa.int64(), "lang": pa.int32(), "value": pa.float64()}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = np.array(batch.column(1).to_pylist(), object)
            kinds = np.array([2 * len(gram) for gram in grams], np.int64) + np.array(batch.column(2).to_pylist(), np.int64)
            keys = np.zeros(len(grams), np.int64)
            for kind in np.unique(kinds):
                keys[kinds == kind] = keys_of(grams[kinds == kind].tolist(), bool(kind % 2))
            numbers = [place[name] for name in batch.column(0).to_pylist()]
            yield record_batch({"key": keys, "lang": numbers, "value": batch.column(3).to_pylist()}, types)

    keyed = stored(entries.mapInArrow(hashed, "key bigint, lang int, value double"), "entries")
    fewest = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = max(fewest, -(-keyed.count() // _SHARD_ROWS))
    model = stored(keyed.repartitionByRange(files, "key").sortWithinPartitions("key", "lang"), "language-model")
    ranges = model.groupBy(F.col("_metadata.file_path").alias("address")).agg(
        F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("rows")
    )
    return sorted((StoredShard(*row) for row in ranges.collect()), key=lambda shard: shard.first)


def fit(labelled: DataFrame, *, quantile: float = QUANTILE) -> Identifier:
    """From ``labelled (text, lang)``; rows without text or language are left out."""
    known = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("text").cast("string"), "lang")
    return _calibrated(model_of(stored(gram_counts(known), "gram-counts")), known, quantile)


def model_of(counts: DataFrame) -> Model:
    """The model of ``gram_counts``, in the shared folder."""
    levels = _levels(counts)
    languages = sorted((r.lang for r in levels[0].select("lang").distinct().collect()), key=lambda name: name.encode())
    floor = 1.0 / (levels[0].select("gram").distinct().count() + 1)
    shards = _shards(_entries(levels, floor), languages) if languages else []
    return Model(languages, shards, float(np.log(floor)))


def _scored(model: Model, known: DataFrame) -> DataFrame:
    """``(lang, step, n, hits, c0, c1, ...)``: labelled texts by language and step of their own cross-entropy.

    ``hits`` of the ``n`` are right, and ``c0`` and so on sum the confidence at each temperature.
    """
    held = known.sparkSession.sparkContext.broadcast(model)
    sums = ["n", "hits", *(f"c{i}" for i in range(len(_TEMPERATURES)))]
    types = {"lang": pa.int32(), "step": pa.int64(), **{name: pa.int64() for name in sums}}
    place = {name: i for i, name in enumerate(model.languages)}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _SCORED_ROWS, _SCORED_BYTES):
            sizes, entropies = held.value.entropies(batch.column(0).to_pylist())
            truth = np.array([place.get(name, -1) for name in batch.column(1).to_pylist()], np.int64)
            usable = (truth >= 0) & (sizes > 1)
            truth, sizes, entropies = truth[usable], sizes[usable], entropies[usable]
            step = np.ceil(entropies[np.arange(len(truth)), truth] * _STEPS).astype(np.int64)
            chances = [posterior(sizes, entropies, t).max(axis=1, initial=0) for t in _TEMPERATURES]
            columns = [np.ones(len(truth), np.int64), entropies.argmin(axis=1) == truth, *(np.rint(c * _UNITS) for c in chances)]
            keys, row = np.unique(np.stack([truth, step], axis=1), axis=0, return_inverse=True)
            out = {"lang": keys[:, 0], "step": keys[:, 1]}
            for name, column in zip(sums, columns, strict=True):
                out[name] = np.zeros(len(keys), np.int64)
                np.add.at(out[name], row.ravel(), column.astype(np.int64))
            yield record_batch(out, types)

    schema = ", ".join(f"{name} {'int' if name == 'lang' else 'bigint'}" for name in types)
    return known.mapInArrow(score, schema).groupBy("lang", "step").agg(*[F.sum(name).alias(name) for name in sums])


def _calibrated(model: Model, known: DataFrame, quantile: float) -> Identifier:
    if not model.languages:
        return Identifier(model, np.zeros(0), 1.0)
    table = stored(_scored(model, known), "scored")
    # A language has one row for each step at most, however many texts there are.
    upto = Window.partitionBy("lang").orderBy("step")
    shares = table.withColumn("upto", F.sum("n").over(upto)).withColumn("of", F.sum("n").over(Window.partitionBy("lang")))
    usual = shares.where(F.col("upto") >= F.ceil(F.col("of") * F.lit(quantile))).groupBy("lang").agg(F.min("step").alias("step"))
    highest = np.full(len(model.languages), -model.floor)
    for row in usual.collect():
        highest[row.lang] = row.step / _STEPS
    sums = [F.sum(name) for name in table.columns[2:]]
    texts, hits, *confidence = (int(value or 0) for value in table.agg(*sums).first())
    if not texts:
        return Identifier(model, highest, 1.0)
    # The temperature at which the mean confidence comes nearest to the share of right answers.
    expected = (hits + 1) / (texts + 2)
    gaps = [abs(total / _UNITS / texts - expected) for total in confidence]
    return Identifier(model, highest, float(_TEMPERATURES[int(np.argmin(gaps))]))


def identified(docs: DataFrame, identifier: Identifier, rejection: float = REJECTION) -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)``; only the text is looked at."""
    held = docs.sparkSession.sparkContext.broadcast(identifier)
    types = {"doc_id": pa.int64(), "lang_pred": pa.string(), "score": pa.float64(), "rejected": pa.bool_()}

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _SCORED_ROWS, _SCORED_BYTES):
            found = held.value.predict(batch.column(1).to_pylist(), rejection)
            columns = (batch.column(0).to_pylist(), *found)
            yield record_batch(dict(zip(types, columns, strict=True)), types)

    columns = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return columns.mapInArrow(predict, "doc_id bigint, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, identifier: Identifier, rejection: float = REJECTION) -> DataFrame:
    """The rows of ``docs``, with all columns, that are not rejected."""
    held = docs.sparkSession.sparkContext.broadcast(identifier)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _SCORED_ROWS, _SCORED_BYTES):
            _, _, rejected = held.value.predict(batch.column(at).to_pylist(), rejection)
            yield batch.filter(pa.array([not r for r in rejected], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """The labelled rows whose remainder is not 2; the others are held out."""
    return docs.where(remainder(F.col("doc_id")) != 2)
