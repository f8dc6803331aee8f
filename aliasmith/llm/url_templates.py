"""URL filters: rules first, then path templates learned per host.

Paths are generalised into templates, all with DataFrame operations:

* digits in a segment become ``#``; paths are as deep as they are, and a level of the tree costs work
  only for the paths that reach it, and a job only if a host has paths there that could be joined;
* from the root down, the children of a node become ``*`` where there are many kinds of them;
* from the leaves up, a branch is merged with its siblings of the same shape, as ``*``, unless its
  share of bad labels differs from theirs (two-proportion test).

A template is rejected if its share of bad labels, smoothed towards its host's and that towards
the share of all, is above ``REJECT_ABOVE``.

Everything but the last join sees one row per host and generalised path. That join spreads
templates over pages; adaptive execution splits a host path that holds very many of them.

Defined results: a null url, and one without ``://``, has an empty host and path; rows that repeat
are judged alike; without labels nothing is rejected; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aliasmith.llm.words import lower_ascii
from aliasmith.session import stored

MANY_KINDS = 12
KINDS_PER_PAGE = 0.1
SIMILAR_BELOW = 1.96
SMOOTHING = 5.0
REJECT_ABOVE = 0.5
WILDCARD = "*"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A to Z lower-cased, and path without query and fragment; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``verdict``; null if none does.

    A rule fits its host and all hosts below it, and every path that begins with its path.
    """
    fitting = []
    for rule in rules:
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.struct(
            F.lit(len(rule.text)).alias("length"), F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict")
        )
        fitting.append(F.when(fits, found))
    return F.array_max(F.array(*fitting)) if fitting else F.lit(None)


def whole_path(path: Column) -> Column:
    """All segments of a path with digits as ``#``."""
    plain = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(plain, lambda s: F.regexp_replace(s, "[0-9]+", "#"))


def _starred(depth: int) -> Column:
    """The template with the segment at a depth replaced by the wildcard."""
    return F.transform("template", lambda s, i: F.when(i == depth, WILDCARD).otherwise(s))


def _with_star(table: DataFrame, chosen: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """``table`` with the wildcard at a depth in the rows whose keys are in ``chosen``."""
    marked = table.join(chosen.withColumn("_star", F.lit(True)), keys, "left")
    template = F.when(F.col("_star"), _starred(depth)).otherwise(F.col("template"))
    return stored(marked.withColumn("template", template).select("host", "shape", "template", "n", "labels", "bad"), "templates")


def _generalised(table: DataFrame, depth: int) -> DataFrame:
    """Wildcards at a depth, which all rows reach, under the nodes that have many kinds of children."""
    node = F.slice("template", 1, depth)
    placed = table.withColumn("node", node)
    kinds = placed.groupBy("host", "node", F.get("template", F.lit(depth)).alias("kind")).agg(F.sum("n").alias("n"))
    nodes = kinds.groupBy("host", "node").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
    many = (F.col("kinds") >= MANY_KINDS) & (F.col("kinds") > F.col("n") * KINDS_PER_PAGE)
    return _with_star(placed, nodes.where(many).select("host", "node"), ["host", "node"], depth)


def _merged(table: DataFrame, depth: int) -> DataFrame:
    """Wildcards at a depth, which all rows reach, for branches that resemble the rest of their siblings."""
    branches = table.groupBy("host", "template").agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad"))
    branches = branches.withColumn("shared", _starred(depth))
    whole = branches.groupBy("host", "shared").agg(
        F.count("*").alias("branches"), F.sum("labels").alias("all_labels"), F.sum("bad").alias("all_bad")
    )
    labels, bad = F.col("labels"), F.col("bad")
    others, others_bad = F.col("all_labels") - labels, F.col("all_bad") - bad
    pooled = F.col("all_bad") / F.col("all_labels")
    spread = pooled * (1 - pooled) * (1 / labels + 1 / others)
    gap = F.abs(bad / labels - others_bad / others)
    same = (labels == 0) | (others == 0) | (spread == 0) | (gap < F.sqrt(spread) * SIMILAR_BELOW)
    alike = branches.join(whole.where(F.col("branches") > 1), ["host", "shared"]).where(F.coalesce(same, F.lit(True)))
    return _with_star(table, alike.select("host", "template"), ["host", "template"], depth)


def _levels(table: DataFrame) -> tuple[int, int]:
    """Above which depths a node can have many kinds, and a branch a sibling.

    Children of many kinds need as many shapes of the host that are longer than the node's depth;
    siblings are of one length, so they need two shapes of it.
    """
    lengths = table.groupBy("host", F.size("shape").alias("length")).agg(F.count("*").alias("shapes"))
    longer = Window.partitionBy("host").orderBy(F.desc("length"))
    reaching = lengths.withColumn("reaching", F.sum("shapes").over(longer))
    row = reaching.agg(
        F.max(F.when(F.col("reaching") >= MANY_KINDS, F.col("length"))),
        F.max(F.when(F.col("shapes") > 1, F.col("length"))),
    ).first()
    return row[0] or 0, row[1] or 0


def _wildcards(table: DataFrame) -> DataFrame:
    """Down and up again over the levels; each level rewrites only the rows that reach it."""
    size = F.size("template")
    down, up = _levels(table)
    complete, deeper = [], table
    for depth in range(down):
        complete.append(deeper.where(size == depth))
        deeper = _generalised(deeper.where(size > depth), depth)
    # What is shorter than a segment or longer than any pair of siblings is done.
    done = [deeper.where((size == 0) | (size > up)), *[rows for n, rows in enumerate(complete) if n == 0 or n > up]]
    for depth in reversed(range(up)):
        joining = complete[depth + 1] if depth + 1 < down else deeper.where(size == depth + 1)
        rising = joining if depth == up - 1 else rising.unionByName(joining)
        rising = _merged(rising, depth)
    return stored(reduce(DataFrame.unionByName, done if up == 0 else [*done, rising]), "templates")


def templates(labelled: DataFrame) -> DataFrame:
    """``(host, shape, template, bad_share)`` from ``labelled (host, path, bad)``, ``bad`` null where not known."""
    table = labelled.groupBy("host", whole_path(F.col("path")).alias("shape")).agg(
        F.count("*").alias("n"),
        F.count("bad").alias("labels"),
        F.coalesce(F.sum(F.col("bad").cast("bigint")), F.lit(0)).alias("bad"),
    )
    table = stored(table.withColumn("template", F.col("shape")), "templates")
    table = _wildcards(table)
    every = table.agg((F.sum("bad") + 1) / (F.sum("labels") + 2)).first()[0] or 0.0
    hosts = table.groupBy("host").agg(F.sum("labels").alias("host_labels"), F.sum("bad").alias("host_bad"))
    found = table.groupBy("host", "template").agg(F.sum("labels").alias("all_labels"), F.sum("bad").alias("all_bad"))
    host_share = (F.col("host_bad") + F.lit(float(every) * SMOOTHING)) / (F.col("host_labels") + SMOOTHING)
    share = (F.col("all_bad") + host_share * SMOOTHING) / (F.col("all_labels") + SMOOTHING)
    rated = found.join(hosts, "host").select("host", "template", share.alias("bad_share"))
    return stored(table.join(rated, ["host", "template"]).select("host", "shape", "template", "bad_share"), "rated")


def judged(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, bad_share)`` for ``pages (page_id, url)``.

    ``labels (page_id, bad)`` covers some pages; a page with several labels is bad if one says so.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = labels.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    rated = templates(parsed.join(known, "page_id", "left").select("host", "path", "bad"))
    rated = rated.withColumnRenamed("host", "_host")
    shaped = parsed.withColumn("_shape", whole_path(F.col("path")))
    joined = shaped.join(rated, (F.col("host") == F.col("_host")) & (F.col("_shape") == F.col("shape")))
    rule = best_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("bad_share") > REJECT_ABOVE, "block").otherwise("allow")
    return joined.withColumn("_rule", rule).select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), learned).alias("verdict"),
        F.array_join("template", "/").alias("template"),
        "bad_share",
    )
