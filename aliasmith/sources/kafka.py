"""Message queues: everything after the connector works on a string column ``value``.

``source`` names the connector: the queue's own, or ``record_log``, a queue in a shared folder.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from aliasmith.operators.projections import flatten_struct
from aliasmith.sources import record_log

# Fixed value: the name of the queue's connector.
QUEUE = "kafka"

# Client settings that the connector sets itself and refuses.
_REFUSED = (
    "auto.offset.reset",
    "enable.auto.commit",
    "key.deserializer",
    "value.deserializer",
    "key.serializer",
    "value.serializer",
    "interceptor.classes",
)


def connector_options(params: Mapping[str, object]) -> dict[str, str]:
    """Client settings with the ``kafka.`` prefix the connector asks for, without those it refuses."""
    plain = {k.removeprefix("kafka."): str(v) for k, v in params.items()}
    return {f"kafka.{k}": v for k, v in plain.items() if k not in _REFUSED}


def starting_offsets(params: Mapping[str, object]) -> dict[str, str]:
    """Where a stream starts: what ``auto.offset.reset`` asks for is an option of the source."""
    reset = params.get("auto.offset.reset", params.get("kafka.auto.offset.reset"))
    return {"startingOffsets": str(reset)} if reset in ("earliest", "latest") else {}


def offset_ranges(topic: str, until: Iterable[tuple[int, int]]) -> dict[str, str]:
    """Batch options for ``(partition, until)`` ranges that start at offset 0; only these partitions are read."""
    ends = {str(partition): end for partition, end in until}
    starts = dict.fromkeys(ends, 0)
    assigned = json.dumps({topic: sorted(map(int, ends))})
    return {"assign": assigned, "startingOffsets": json.dumps({topic: starts}), "endingOffsets": json.dumps({topic: ends})}


def _connector(spark: SparkSession, source: str) -> str:
    if source == record_log.SOURCE:
        spark.dataSource.register(record_log.RecordLog)
    return source


def read_messages(
    spark: SparkSession,
    topic: str,
    until: Iterable[tuple[int, int]],
    params: Mapping[str, object],
    source: str = QUEUE,
) -> DataFrame:
    reader = spark.read.format(_connector(spark, source)).options(**connector_options(params), **offset_ranges(topic, until))
    return message_text(reader.load())


def stream_messages(
    spark: SparkSession,
    topic: str,
    params: Mapping[str, object],
    max_per_batch: int | None = None,
    source: str = QUEUE,
) -> DataFrame:
    reader = spark.readStream.format(_connector(spark, source))
    reader = reader.options(**connector_options(params), **starting_offsets(params))
    reader = reader.option("subscribe", topic)
    if max_per_batch is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_per_batch)
    return message_text(reader.load())


def message_text(messages: DataFrame) -> DataFrame:
    return messages.select(F.col("value").cast("string").alias("value"))


def json_values(messages: DataFrame, schema: StructType, column: str = "value") -> DataFrame:
    """JSON messages as flat columns of the given schema; unreadable ones give nulls."""
    parsed = messages.select(F.from_json(F.col(column), schema).alias("message")).select("message.*")
    return flatten_struct(parsed)


def write_messages(lines: DataFrame, topic: str, params: Mapping[str, object], source: str = QUEUE) -> None:
    writer = lines.select("value").write.format(_connector(lines.sparkSession, source)).mode("append")
    writer.options(**connector_options(params)).option("topic", topic).save()


def stream_to_topic(
    lines: DataFrame, topic: str, params: Mapping[str, object], checkpoint: str, source: str = QUEUE
) -> DataStreamWriter:
    writer = lines.select("value").writeStream.format(_connector(lines.sparkSession, source))
    writer = writer.options(**connector_options(params))
    return writer.option("topic", topic).option("checkpointLocation", checkpoint)
