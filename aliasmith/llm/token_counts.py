"""Token counts of documents, with the count at every prefix.

``prefix_counts`` stores the whole program of a text: one number per character. It answers
how many tokens any prefix has and how long a prefix a budget of tokens allows, without
encoding again. ``token_counts`` keeps only what a limit asks for.

Work is done where a text is read; nothing is shuffled. Defined results: a null text counts as
empty and has no tokens; a text holding a special token's string counts it as one token,
as the vocabulary's library does; rows are kept as often as they occur; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aliasmith.llm.batches import record_batch, slices
from aliasmith.llm.bytepairs import BytePairs

LIMIT = 1024
_ROWS = 2048


@cache
def _pairs(path: str) -> BytePairs:
    """One per worker and vocabulary."""
    return BytePairs(path)


def _texts(column: pa.Array) -> list[str]:
    return [text or "" for text in column.to_pylist()]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit, fit_chars)``.

    ``fit_chars`` is how many characters the longest prefix within the limit has.
    """
    types = {
        "doc_id": pa.int64(),
        "n_bytes": pa.int64(),
        "n_tokens": pa.int64(),
        "over_limit": pa.bool_(),
        "fit_chars": pa.int64(),
    }

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _pairs(vocabulary)
        for batch in slices(batches, _ROWS):
            texts = _texts(batch.column(1))
            counts = pairs.count_all(texts)
            fits = [len(t) if n <= limit else pairs.longest_prefix(t, limit) for t, n in zip(texts, counts, strict=True)]
            out = {
                "doc_id": batch.column(0).to_pylist(),
                "n_bytes": [len(t) if t.isascii() else len(t.encode()) for t in texts],
                "n_tokens": counts,
                "over_limit": [n > limit for n in counts],
                "fit_chars": fits,
            }
            yield record_batch(out, types)

    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(count, schema)


def prefix_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, counts)``: entry ``i`` is the number of tokens of the first ``i`` characters."""
    types = {"doc_id": pa.int64(), "counts": pa.list_(pa.int32())}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _pairs(vocabulary)
        for batch in slices(batches, 64):
            out = {
                "doc_id": batch.column(0).to_pylist(),
                "counts": [pairs.prefixes(text) for text in _texts(batch.column(1))],
            }
            yield record_batch(out, types)

    columns = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return columns.mapInArrow(count, "doc_id bigint, counts array<int>")


def tokens_of_prefix(counts: Column, characters: Column) -> Column:
    """The number of tokens of a prefix, from stored counts; a longer prefix is the whole text."""
    return F.get(counts, F.least(characters.cast("int"), F.size(counts) - 1))


def longest_within(counts: Column, budget: Column) -> Column:
    """How many characters the longest prefix within a budget of tokens has, from stored counts."""
    within = F.transform(counts, lambda c, i: F.when(c <= budget, i).otherwise(F.lit(0)))
    return F.array_max(within)
