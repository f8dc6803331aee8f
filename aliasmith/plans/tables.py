"""The matching tables, derived from the generated parquet tables.

Documents serve as the watch list: every ``last, first`` mention in the whole cleaned
text of a document is a name of that entity, and every single word in a table cell is a
short alias. Pages, in the language their address names, bring the names to match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aliasmith.functions.text import LIST_SEPARATOR, clean_text, natural_order
from aliasmith.operators.aliases import explode_aliases
from aliasmith.operators.filters import valid_names
from aliasmith.operators.matching import BLOCK
from aliasmith.session import TEXT_PARTITIONS

# How a name or a short alias is written in text (from the start of a
# word, each word as a whole), what makes a name a low-quality alias, the length of a
# long form, and the language in an address.
MENTION = r"(?<![a-z])[a-z]++, ?[a-z]++|\| [a-z]++"
LOW_QUALITY = r"^[a-z]{1,2},|,[a-z]{1,2}$"
LONG_FORM = 16
PAGE_LANGUAGE = r"^https?://[^/]+/([a-z]+)/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with long texts, dealt over as many partitions as the setting asks for, if it is there.

    Without the setting the splits of the files decide, which is right for many files.
    """
    partitions = spark.conf.get(TEXT_PARTITIONS, None)
    df = table(spark, sf_dir, name)
    return df.repartition(int(partitions)) if partitions else df


def mentions(text: Column) -> Column:
    """All mentions in a text, in order: ``last,first`` or a single word."""
    found = F.regexp_extract_all(clean_text(text), F.lit(MENTION), F.lit(0))
    return F.transform(
        found,
        lambda m: F.replace(F.replace(m, F.lit(", "), F.lit(",")), F.lit("| "), F.lit("")),
    )


def watch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = text_table(spark, sf_dir, "documents").select("doc_id", "lang", mentions(F.col("text")).alias("found"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rest = F.slice(F.col("found"), 2, F.size("found"))

    def listed(keep) -> Column:
        return F.array_join(F.filter(rest, keep), LIST_SEPARATOR)

    def low(a: Column) -> Column:
        return a.rlike(LOW_QUALITY)

    def long(a: Column) -> Column:
        return F.length(a) >= LONG_FORM

    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("uid"),
        F.get("found", F.lit(0)).alias("name"),
        F.col("lang").alias(BLOCK),
        F.when(F.col("quality") == 1, "i").when(F.col("quality") == 0, "e").alias("person_type"),
        listed(lambda a: ~low(a) & ~long(a)).alias("aliases"),
        listed(low).alias("low_quality_aliases"),
        listed(lambda a: ~low(a) & long(a)).alias("alternative_spelling"),
    )


def watch_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All valid names of the watch list, one row each."""
    return valid_names(explode_aliases(watch_list(spark, sf_dir)))


def alias_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per entity the array of its aliases, written ``first last``."""
    lists = F.split(F.col("aliases"), LIST_SEPARATOR)
    return watch_list(spark, sf_dir).select("uid", F.transform(lists, natural_order).alias("aliases"))


def incoming_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to match: every ``last, first`` mention in a page, with the page's language."""
    pages = text_table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", PAGE_LANGUAGE, 1).alias(BLOCK), F.explode(mentions(F.col("html"))).alias("name")
    )
    return valid_names(pages).select("name", BLOCK)


def incoming_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct names to match as ``"name";country`` messages."""
    names = incoming_names(spark, sf_dir).distinct()
    quoted = F.concat(F.lit('"'), F.col("name"), F.lit('"'))
    return names.select(F.concat_ws(LIST_SEPARATOR, quoted, BLOCK).alias("value"))


def neighbour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of names that follow each other in a document; linear in the text."""
    names = F.filter(mentions(F.col("text")), lambda m: m.contains(","))
    documents = text_table(spark, sf_dir, "documents").select(names.alias("names"))
    pairs = F.zip_with(
        "names",
        F.slice("names", 2, F.size("names")),
        lambda a, b: F.struct(a.alias("string1"), b.alias("string2")),
    )
    complete = F.filter(pairs, lambda p: p.string2.isNotNull())
    return documents.select(F.inline(complete)).distinct()


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a quality label, a length score and a prediction by length."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return documents.join(labels, "doc_id").select(
        "doc_id",
        F.col("quality").cast("double").alias("label"),
        F.col("n_chars").cast("double").alias("score"),
        (F.col("n_chars") >= 1000).cast("double").alias("prediction"),
    )


def return_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a numeric feature table; the label says whether a line was returned."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_discount",
        "l_tax",
        (F.col("l_returnflag") == "R").cast("double").alias("label"),
    )
