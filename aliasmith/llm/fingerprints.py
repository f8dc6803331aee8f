"""Fingerprints of documents, and how alike a document is to an edit of it and to its neighbour.

The neighbour of a document is the next one in descending order of the id; the last one's is
the first. Texts are shuffled once, by ranges of that order, and each task goes through its
range with one document in hand. The ends of the ranges, one document each, are joined
afterwards.

Defined results: a null text counts as empty; a null id comes last in the order; rows with the
same id are ordered by a hash of their text; a document alone in the table is its own
neighbour; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aliasmith.llm.batches import record_batch, slices
from aliasmith.llm.piecewise import fingerprint, likeness
from aliasmith.session import stored

_ROWS = 1024
_RESULT = {
    "doc_id": pa.int64(),
    "n_chars": pa.int64(),
    "edited_sha256": pa.string(),
    "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(),
    "near_next": pa.float64(),
}
_RESULT_SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
# The first and the last document of a task's range, kept for the join of the ends.
_TYPES = _RESULT | {"role": pa.string(), "range": pa.int32(), "text": pa.string()}


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of the next one."""
    replaced = len(text) // 3
    return text[: len(text) - replaced] + following[:replaced]


def _compared(doc_id, text: str, own: str, next_text: str, next_print: str) -> tuple:
    change = edited(text, next_text)
    data = change.encode()
    changed = own if change == text else fingerprint(data)
    return (
        doc_id,
        len(text),
        sha256(data).hexdigest(),
        own,
        changed,
        likeness(own, changed),
        likeness(own, next_print),
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, held = TaskContext.get().partitionId(), None
    nothing = (None,) * (len(_RESULT) - 1)
    for batch in slices(batches, _ROWS):
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = fingerprint(text.encode())
            if held is None:
                rows.append((doc_id, *nothing, "first", number, text))
            else:
                rows.append((*_compared(*held, text, own), None, number, None))
            held = (doc_id, text, own)
        yield record_batch(dict(zip(_TYPES, zip(*rows, strict=True), strict=True)), _TYPES)
    if held is not None:
        yield record_batch({k: [v] for k, v in zip(_TYPES, (held[0], *nothing, "last", number, held[1]), strict=True)}, _TYPES)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, next_text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            rows.append(_compared(doc_id, text, fingerprint(text.encode()), next_text, fingerprint(next_text.encode())))
        if rows:
            yield record_batch(dict(zip(_RESULT, zip(*rows, strict=True), strict=True)), _RESULT)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs (doc_id, text)``: a row per document, see ``_RESULT``."""
    columns = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie").desc()]
    dealt = columns.withColumn("tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"{_RESULT_SCHEMA}, role string, range int, text string"
    walked = stored(dealt.drop("tie").mapInArrow(_walk, schema), "fingerprints")
    # One row per task from here on: which range follows which, the first one after the last.
    first = walked.where(F.col("role") == "first").select("range", F.col("text").alias("next_text"))
    everything = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead("range").over(Window.orderBy("range")), F.first("range").over(everything))
    follows = first.select("range", following.alias("next"))
    last = walked.where(F.col("role") == "last").select("range", "doc_id", "text").join(follows, "range")
    ends = last.join(first.withColumnRenamed("range", "next"), "next").select("doc_id", "text", "next_text")
    inner = walked.where(F.col("role").isNull()).select(*_RESULT)
    return inner.unionByName(ends.mapInArrow(_finish, _RESULT_SCHEMA))
