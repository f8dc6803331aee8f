"""Lines that are boilerplate of their site: those on more than a share of the host's pages.

A line, without blanks around it, counts once per page. Of the lines above the share a host
has at most its mean number of lines per page divided by the share, so they fit in one array per
host. Counting is combined before it is shuffled; the join with the pages deals every host
out over ``SPLITS`` tasks.

Defined results: a null text is one empty line; a null host is a host of its own; rows that repeat
are pages of their own; empty lines are kept and not counted; a host of fewer pages than
one by the ratio loses every line, unless ``fewest_pages`` is raised; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aliasmith.llm.words import BLANKS
from aliasmith.session import stored

RATIO = 0.1
# Pages that must hold a line, and that a host must have; 1 leaves the ratio alone to decide.
FEWEST_PAGES = 1
SPLITS = 16
# Tags that end a line of a page.
LINE_END = r"(</(?:p|div|li|ul|nav|article|head|title|style|script|h[1-6])>|<br>)"


def page_text(html: Column) -> Column:
    """The page with a line break after each tag that ends a block."""
    return F.regexp_replace(html, LINE_END, "$1\n")


def _code(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANKS)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def boilerplate(pages: DataFrame, ratio: float = RATIO, fewest_pages: int = FEWEST_PAGES) -> DataFrame:
    """``(host, codes)``: the hosts with boilerplate and the hashes of their lines; ``pages (page_id, host, text)``."""
    totals = pages.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= fewest_pages)
    full = F.filter(_lines(F.col("text")), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0)
    once = F.array_distinct(F.transform(full, _code))
    counts = pages.select("host", F.explode(once).alias("code")).groupBy("host", "code").agg(F.count("*").alias("n"))
    counts = counts.where(F.col("n") >= fewest_pages).withColumnRenamed("host", "_host")
    joined = counts.join(totals, F.col("_host").eqNullSafe(F.col("host")))
    frequent = joined.where(F.col("n") > F.col("pages") * F.lit(float(ratio)))
    return stored(frequent.groupBy("host").agg(F.collect_list("code").alias("codes")), "boilerplate")


def without_boilerplate(pages: DataFrame, ratio: float = RATIO, fewest_pages: int = FEWEST_PAGES) -> DataFrame:
    """``(page_id, host, n_lines, n_dropped, text)`` per page; the kept lines in their order."""
    codes = boilerplate(pages, ratio, fewest_pages).select(
        F.col("host").alias("_host"), "codes", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))).alias("_part")
    )
    rows = pages.select("page_id", "host", _lines(F.col("text")).alias("lines"))
    part = F.pmod(F.xxhash64("page_id", F.get("lines", F.size("lines") - 1)), F.lit(SPLITS)).cast("int")
    rows = rows.withColumn("part", part)
    joined = rows.join(codes, F.col("host").eqNullSafe(F.col("_host")) & (F.col("part") == F.col("_part")), "left")
    known = F.coalesce("codes", F.array().cast("array<bigint>"))
    kept = F.filter("lines", lambda line: ~F.array_contains(F.col("known"), _code(line)))
    found = joined.withColumn("known", known).select("page_id", "host", "lines", kept.alias("kept"))
    return found.select(
        "page_id",
        "host",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("bigint").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )
