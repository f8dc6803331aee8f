"""Connected components by passing the smallest label along links, in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aliasmith.session import stored


def components(links: DataFrame) -> DataFrame:
    """``(node, comp)`` for every node of ``links (a, b)``; ``comp`` is the smallest node of the component.

    In each round a node takes the smallest label among its neighbours and then the label of
    that label, so that long chains shorten by half. Labels only fall; when a round
    changes none, all links join equal labels.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        hooked = labels.join(around.withColumnRenamed("a", "node"), "node").select(
            "node", "comp", F.least("comp", "near").alias("new")
        )
        target = labels.select(F.col("node").alias("new"), F.col("comp").alias("far"))
        jumped = hooked.join(target, "new", "left").select(
            "node", F.col("comp").alias("old"), F.least("new", F.coalesce("far", "new")).alias("comp")
        )
        jumped = stored(jumped, "labels")
        labels = jumped.select("node", "comp")
        if jumped.where(F.col("comp") != F.col("old")).isEmpty():
            return labels
