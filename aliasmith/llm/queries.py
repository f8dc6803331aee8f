"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aliasmith.llm import oracles
from aliasmith.llm.collocations import collocations
from aliasmith.llm.decontaminate import contamination
from aliasmith.llm.fingerprints import fingerprints
from aliasmith.llm.language import fit, identified, remainder, training_rows
from aliasmith.llm.licenses import labels_of, license_scan
from aliasmith.llm.manifest import folded, joined_digest, proofs, row_digest, siblings, write_manifest
from aliasmith.llm.mixing import mix_counts, plan_mix
from aliasmith.llm.near_duplicates import near_duplicates
from aliasmith.llm.pii import KINDS, counted, listed, personal_data
from aliasmith.llm.site_lines import page_text, without_boilerplate
from aliasmith.llm.tables import table
from aliasmith.llm.token_counts import token_counts
from aliasmith.llm.token_store import stored_checksums, write_tokens
from aliasmith.llm.url_templates import host_and_path, judged
from aliasmith.llm.vocabularies import BYTE_PAIRS, WORD_PAIRS, vocabulary


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the rules, else by its path template.

    A path ends in the number of the document the page was made from. Its label is the
    page's: bad if the quality is 0 or the document is toxic.
    """
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    number = F.regexp_extract(host_and_path(F.col("url"))[1], r"([0-9]+)[^0-9]*$", 1).try_cast("bigint")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    labelled = pages.select("page_id", number.alias("doc_id")).join(labels.select("doc_id", bad), "doc_id")
    return judged(pages, labelled.select("page_id", "bad"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of all documents takes from each, at weights 5, 2, 1 by source."""
    return mix_counts(plan_mix(table(spark, sf_dir, "documents")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and the longest prefix within the limit."""
    return token_counts(table(spark, sf_dir, "documents"), vocabulary(BYTE_PAIRS))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of an edit of it, and their likeness."""
    return fingerprints(table(spark, sf_dir, "documents"))


def op5_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page without the lines that are boilerplate of its host."""
    host = host_and_path(F.col("url"))[0]
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), page_text(F.col("html")).alias("text"))
    return without_boilerplate(pages)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans, and those the method adds."""
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[counted(F.col("base"), kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
        F.size(F.concat("base", "added")).cast("bigint").alias("n_spans"),
    )


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token ids and read back through the key index."""
    docs = table(spark, sf_dir, "documents")
    return stored_checksums(write_tokens(docs, vocabulary(WORD_PAIRS)), docs)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of the benchmark found in every document."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, group and number of links of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by models of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    found = identified(docs, fit(training_rows(docs)))
    return found.select("doc_id", held_out, "lang_pred", "score", "rejected")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle proof of every document, checked on rows of which some have been changed."""
    docs = table(spark, sf_dir, "documents")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.col("n_chars").cast("decimal(20,0)")
    claimed = row_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars + F.when(changed, 1).otherwise(0), F.col("text"))
    leaf = row_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    manifest = write_manifest(
        docs,
        leaf,
        group=F.col("lang"),
        order=[F.col("doc_id")],
        keep={"doc_id": F.col("doc_id"), "claimed": F.when(changed, claimed).otherwise(leaf)},
    )
    found = proofs(manifest).select(
        F.col("kept.doc_id").alias("doc_id"),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        joined_digest(siblings(F.col("path"))).alias("proof_sha256"),
        folded(F.col("kept.claimed"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and, with edits allowed, license notices in every document."""
    starts = F.transform("base", lambda s: s.first_word)
    return license_scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels_of(F.col("base")).alias("base_labels"),
        labels_of(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s.likeness)), F.lit(0.0)).alias("score"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language by the share of their parts that they make up."""
    return collocations(table(spark, sf_dir, "documents")).drop("words")


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_url_templates, op2_mix_sources, op3_token_counts, op4_fingerprints, op5_site_lines, op6_pii, op7_token_store, op8_decontaminate, op9_near_duplicates, op10_language_id, op11_merkle_manifest, op12_license_scan, op13_collocations)
    return {query.__name__: query for query in found}


def llm_oracles() -> dict[str, str]:
    return dict(oracles.SQL)
