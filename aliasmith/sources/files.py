"""Delimited and line files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from aliasmith.functions.text import TABLE_SEPARATOR
from aliasmith.operators.aliases import split_alias_lines

CORRUPT = "_corrupt_record"

WATCH_LIST = StructType(
    [
        StructField(name, StringType())
        for name in (
            "uid",
            "name",
            "citizenship",
            "person_type",
            "aliases",
            "low_quality_aliases",
            "alternative_spelling",
        )
    ]
)


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: StructType,
    separator: str = TABLE_SEPARATOR,
    header: bool = True,
    encoding: str = "UTF-8",
    null_mark: str = "",
    keep_corrupt: bool = False,
) -> DataFrame:
    """A delimited file with a given schema; malformed lines may be kept in a column.

    A field that equals ``null_mark`` is null.
    """
    if keep_corrupt:
        schema = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    return (
        spark.read.schema(schema)
        .option("sep", separator)
        .option("header", header)
        .option("encoding", encoding)
        .option("nullValue", null_mark)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )


def write_delimited(
    df: DataFrame, path: str, separator: str = TABLE_SEPARATOR, header: bool = True, null_mark: str = ""
) -> None:
    writer = df.write.mode("overwrite").option("sep", separator).option("header", header)
    writer.option("nullValue", null_mark).csv(path)


def read_alias_lines(spark: SparkSession, path: str) -> DataFrame:
    """One array of aliases per line of a ``|``-separated file."""
    return split_alias_lines(spark.read.text(path))


def read_raw_fields(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """One array of fields per line of a ``|``-separated file in an older encoding."""
    reader = spark.read.schema("value string").option("encoding", encoding)
    lines = reader.option("sep", "\x01").option("quote", "").csv(path)
    return split_alias_lines(lines).withColumnRenamed("aliases", "fields")


def _absolute(spark: SparkSession, folder: str) -> str:
    """The folder with its file system, as file paths are reported."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _one_slash(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:/")


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """``word`` from a file with one word per line; blank lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where(F.col("word") != "")


def write_raw_fields(fields: DataFrame, path: str, column: str = "fields") -> None:
    """Arrays of fields as ``|``-separated lines."""
    fields.select(F.array_join(column, TABLE_SEPARATOR).alias("value")).write.mode("overwrite").text(path)


def read_pair_files(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of pair files, labelled by the word ``true`` or ``false`` in the file name.

    Only the path below ``folder`` counts; a file with neither word is skipped. A folder
    stands for a file of that name: Spark writes a table as a folder of parts.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(folder)
    # Paths in the metadata are encoded, and a plus sign in them is a plus sign.
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    root = _one_slash(F.lit(_absolute(spark, folder)))
    below = F.substr(_one_slash(path), F.length(root) + 1)
    label = F.when(below.contains("true"), F.lit(1.0)).when(below.contains("false"), F.lit(0.0))
    return lines.select("value", label.alias("label")).where(F.col("label").isNotNull())
