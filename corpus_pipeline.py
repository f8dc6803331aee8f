"""The corpus pipeline: stages from documents to stored token ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aliasmith.llm.decontaminate import decontaminated
from aliasmith.llm.language import accepted, fit
from aliasmith.llm.mixing import mixed_documents, plan_mix
from aliasmith.llm.near_duplicates import deduplicated
from aliasmith.llm.tables import table
from aliasmith.llm.token_store import stored_checksums, write_tokens
from aliasmith.llm.vocabularies import WORD_PAIRS, vocabulary
from aliasmith.session import ARROW_ROWS, ship_package, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Documents that a Python task gets at once; Spark's own number would be some 70 MB of text in each
# task, and as much in its executor.
BATCH_ROWS = 1024


def prepare(spark: SparkSession) -> None:
    """What the stages need of the session."""
    ship_package(spark)
    spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is identified, by models of all that have a label."""
    prepare(spark)
    return accepted(docs, fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the first by id."""
    prepare(spark)
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without any window of a benchmark item."""
    prepare(spark)
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a document taken twice is two rows."""
    prepare(spark)
    return mixed_documents(docs, plan_mix(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents written as token ids; one row for each, read back from the files."""
    prepare(spark)
    return stored_checksums(write_tokens(docs, vocabulary(WORD_PAIRS)), docs)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token ids", token_ids),
]

# Language models and token ids are not SQL; the tests hold each stage against a brute-force
# version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
