"""Times the headline queries and prints one JSON line.

Each query is forced with the ``noop`` sink; the time includes the stages it materialises.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from aliasmith.plans import tables
from aliasmith.plans.queries import all_queries
from aliasmith.session import local_session, ship_package

HEADLINES = (
    "token_frequency",
    "remove_stopwords",
    "valid_names",
    "candidate_count",
    "blocked_pairs",
    "ngram_similarity_pairs",
    "jaro_winkler_pairs",
    "levenshtein_pairs",
    "pair_features_all",
    "true_pairs",
    "false_pairs_banded",
    "balanced_pairs",
    "match_threshold",
    "stream_match",
    "quantile_bins",
    "auc_scored",
    "train_random_forest",
    "match_batch",
)


# Queries whose work is a number of candidate pairs: where to count them.
PAIRS = {
    "ngram_similarity_pairs": "neighbours",
    "jaro_winkler_pairs": "neighbours",
    "levenshtein_pairs": "neighbours",
    "pair_features_all": "neighbours",
}


def counted(result: DataFrame) -> int:
    """Runs a query to its end and counts its rows on the way."""
    seen = Observation()
    observed = result.observe(seen, F.count(F.lit(1)).alias("rows"))
    observed.write.format("noop").mode("overwrite").save()
    return seen.get["rows"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    spark = local_session("bench", cpus)
    ship_package(spark)
    queries = all_queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    neighbours = tables.neighbour_pairs(spark, sf_dir).count()
    seconds, rows, rates, failed = {}, {}, {}, {}
    for name in wanted.split(",") if wanted else HEADLINES:
        started = time.perf_counter()
        try:
            rows[name] = counted(queries[name](spark, sf_dir))
        except Exception as error:  # the figures of the other queries are kept
            failed[name] = str(error).splitlines()[0][:200]
            print(f"{name} failed: {error}", file=sys.stderr, flush=True)
            continue
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]} s, {rows[name]} rows", file=sys.stderr, flush=True)
        if name in PAIRS:
            rates[name] = round(neighbours / seconds[name])
    line = {
        "metric": "total wall time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cores": cpus,
        "result_rows": rows,
        "failed": failed,
        "candidate_pairs": {"neighbours": neighbours},
        "pairs_per_second": rates,
        "input_rows": {
            table: spark.read.parquet(f"{sf_dir}/{table}.parquet").count() for table in ("documents", "pages", "lineitem")
        },
    }
    print(json.dumps(line), flush=True)
    spark.stop()
    empty = [name for name, n in rows.items() if not n]
    if empty or failed:
        sys.exit(f"no rows: {', '.join([*empty, *failed])}")


if __name__ == "__main__":
    main()
