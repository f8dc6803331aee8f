"""Benchmark decontamination by a prefix-filtered set join.

A window is a run of item words (all of them, if the item has fewer than ``window``). For a
window to lie in a document all its words must, so the prefix of a window that the filter
needs is a single word, and the rarest one in the corpus selects the fewest places. The
join meets a document's word with the windows whose rarest word it is, keeps the places where
the window fits between the document's ends, and compares word by word.

Two passes read the texts: one counts in how many documents the benchmark's words occur, one
finds the places of the rarest words. What a task needs to know of the benchmark is a table
of ``1 << SLOT_BITS`` bytes whatever its size; words that fall into a taken slot by chance are
dropped by the joins that follow. Windows, words and places are joined by shuffles, which
adaptive execution splits where a word is frequent.

Defined results: null and empty texts have no words; an item without words has no window;
equal items each count; rows that agree in id and text have the same result; other columns are
not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aliasmith.llm.batches import record_batch, slices, utf8
from aliasmith.session import stored

WINDOW = 10
SLOT_BITS = 22
# Words are runs of bytes that are digits, small letters or outside ASCII.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_ROWS = 2048
_COUNTED_WORDS = 200_000


def byte_words(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8; lower-casing bytes changes A to Z only."""
    return _WORD.findall(text.lower())


def text_key() -> list[Column]:
    """What tells documents apart: the id and 64 bits of the text."""
    return [F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_text")]


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item_id, words)``: the distinct windows of each item."""
    types = {"item_id": pa.int64(), "words": pa.list_(pa.string())}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _ROWS):
            out: dict[str, list] = {"item_id": [], "words": []}
            for item, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = [w.decode() for w in byte_words(text)]
                size = min(window, len(words))
                if not size:
                    continue
                for found in {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}:
                    out["item_id"].append(item)
                    out["words"].append(list(found))
            yield record_batch(out, types)

    columns = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string"))
    return columns.mapInArrow(cut, "item_id bigint, words array<string>")


def _taken_slots(words: DataFrame) -> bytes:
    """One byte per slot, 1 where a word of the table falls; at most ``1 << SLOT_BITS`` numbers arrive here."""
    slot = F.crc32(F.col("word").cast("binary")).bitwiseAND((1 << SLOT_BITS) - 1)
    taken = bytearray(1 << SLOT_BITS)
    for batch in words.select(slot.alias("slot")).distinct().toArrow().to_batches():
        for number in batch.column(0).to_pylist():
            taken[number] = 1
    return bytes(taken)


def document_counts(docs: DataFrame, words: DataFrame) -> DataFrame:
    """``(word, n_docs)`` over all documents, for the words of a table ``(word)``."""
    taken = docs.sparkSession.sparkContext.broadcast(_taken_slots(words))
    types = {"word": pa.string(), "n_docs": pa.int64()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, mask = taken.value, (1 << SLOT_BITS) - 1
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = {"word": [w.decode() for w in counts], "n_docs": list(counts.values())}
            counts.clear()
            return record_batch(out, types)

        for batch in slices(batches, _ROWS):
            for text in utf8(batch.column(0)):
                counts.update([w for w in set(byte_words(text)) if table[crc32(w) & mask]])
            if len(counts) > _COUNTED_WORDS:
                yield flush()
        yield flush()

    partial = docs.select(F.col("text").cast("string")).mapInArrow(count, "word string, n_docs bigint")
    summed = partial.groupBy("word").agg(F.sum("n_docs").alias("n_docs"))
    return words.join(summed, "word", "left").fillna(0, ["n_docs"])


def anchored_windows(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """``(window_id, words, anchor, offset)``: distinct windows by their rarest word.

    A window with a word that no document has is left out.
    """
    distinct = windows.select("window_id", "words").distinct()
    places = stored(distinct.select("window_id", F.posexplode("words").alias("offset", "word")), "window-words")
    counted = stored(document_counts(docs, places.select("word").distinct()), "word-counts")
    rarest = places.join(counted, "word").groupBy("window_id").agg(
        F.min(F.struct("n_docs", "word", "offset")).alias("rarest")
    )
    found = distinct.join(rarest.where(F.col("rarest.n_docs") > 0), "window_id")
    return found.select("window_id", "words", F.col("rarest.word").alias("anchor"), F.col("rarest.offset").alias("offset"))


def _places(docs: DataFrame, anchors: DataFrame, window: int) -> DataFrame:
    """Per document one row with its number of words, and one row per place of an anchor word."""
    taken = docs.sparkSession.sparkContext.broadcast(_taken_slots(anchors.select(F.col("anchor").alias("word"))))
    types = {
        "doc_id": pa.int64(),
        "_text": pa.int64(),
        "n_words": pa.int64(),
        "anchor": pa.string(),
        "place": pa.int64(),
        "before": pa.int32(),
        "around": pa.list_(pa.string()),
    }

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, mask = taken.value, (1 << SLOT_BITS) - 1
        for batch in slices(batches, _ROWS):
            out: dict[str, list] = {name: [] for name in types}

            def put(*values, out=out) -> None:
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)

            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True)
            for doc_id, digest, text in keys:
                words = byte_words(text)
                put(doc_id, digest, len(words), None, None, None, None)
                met = {w for w in set(words) if table[crc32(w) & mask]}
                if met:
                    for i, word in enumerate(words):
                        if word in met:
                            start = max(0, i - window + 1)
                            around = [w.decode() for w in words[start : i + window]]
                            put(doc_id, digest, None, word.decode(), i, i - start, around)
            yield record_batch(out, types)

    schema = "doc_id bigint, _text bigint, n_words bigint, anchor string, place bigint, before int, around array<string>"
    return docs.select(*text_key(), F.col("text").cast("string")).mapInArrow(find, schema)


def window_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, _text, n_words)`` per document, and ``(doc_id, _text, start, end, item_id)`` per occurrence."""
    windows = item_windows(items, window)
    windows = stored(windows.withColumn("window_id", F.sha2(F.concat_ws(" ", "words"), 256)), "windows")
    anchored = stored(anchored_windows(windows, docs), "anchored-windows")
    places = stored(_places(docs, anchored, window), "places")
    start, size = F.col("before") - F.col("offset"), F.size("words")
    fits = (start >= 0) & (start + size <= F.size("around"))
    joined = places.where(F.col("anchor").isNotNull()).join(anchored, "anchor").where(fits)
    same = F.slice("around", F.greatest(start, F.lit(0)) + 1, size) == F.col("words")
    begin = F.col("place") - F.col("offset")
    hits = joined.where(same).select(
        "doc_id", "_text", begin.alias("start"), (begin + size).alias("end"), "window_id"
    )
    with_items = hits.distinct().join(windows.select("window_id", "item_id"), "window_id")
    return places.where(F.col("anchor").isNull()).select("doc_id", "_text", "n_words"), with_items.drop("window_id")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, _text, n_words, n_hit, item_ids)`` per document; ``item_ids`` in text order."""
    sizes, found = window_hits(docs, items, window)
    hits = stored(found, "hits")
    keys = ["doc_id", "_text"]
    # The words inside any occurrence: each span counts from where the earlier ones end.
    earlier = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select(*keys, "start", "end").distinct()
    spans = spans.withColumn("_reached", F.greatest("start", F.coalesce(F.max("end").over(earlier), F.lit(0))))
    n_hit = spans.groupBy(*keys).agg(F.sum(F.greatest(F.col("end") - F.col("_reached"), F.lit(0))).alias("n_hit"))
    item_ids = hits.select(*keys, F.col("item_id").cast("string").alias("item")).distinct().groupBy(*keys).agg(
        F.sort_array(F.collect_list("item")).alias("item_ids")
    )
    per_text = n_hit.alias("h").join(item_ids.alias("i"), _same("h", "i")).select(
        "h.doc_id", "h._text", "n_hit", "item_ids"
    )
    joined = sizes.alias("d").join(per_text.alias("t"), _same("d", "t"), "left")
    return joined.select(
        "d.doc_id",
        "d._text",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def _same(one: str, two: str) -> Column:
    return (F.col(f"{one}._text") == F.col(f"{two}._text")) & F.col(f"{one}.doc_id").eqNullSafe(F.col(f"{two}.doc_id"))


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any benchmark window."""
    hit = contamination(docs, items, window).where(F.col("n_hit") > 0).select(
        F.col("doc_id").alias("_hit_id"), F.col("_text").alias("_hit_text")
    )
    hit = stored(hit.distinct(), "contaminated")
    digest = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(hit, (digest == F.col("_hit_text")) & F.col("doc_id").eqNullSafe(F.col("_hit_id")), "left_anti")
