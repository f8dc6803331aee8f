"""Runs a job from a file of settings: ``python -m aliasmith prepare|train|index|match FILE``.

Settings of the message queue are those of the file that begin with ``kafka.``.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession

from aliasmith.plans import jobs
from aliasmith.plans.config import JobConfigError, read_properties
from aliasmith.session import ship_package


def main(arguments: list[str]) -> int:
    if len(arguments) != 2 or arguments[0] not in ("prepare", "train", "index", "match"):
        print(__doc__, file=sys.stderr)
        return 2
    job, path = arguments
    conf = read_properties(Path(path).read_text(encoding="utf-8"))
    spark = SparkSession.builder.appName(f"aliasmith {job}").getOrCreate()
    ship_package(spark)
    try:
        if job == "prepare":
            jobs.prepare_job(spark, conf)
        elif job == "train":
            jobs.train_job(spark, conf)
        elif job == "index":
            jobs.index_job(spark, conf)
        else:
            queue = {k: v for k, v in conf.items() if k.startswith("kafka.")}
            jobs.match_stream_job(spark, conf, queue).start().awaitTermination()
    except JobConfigError as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
