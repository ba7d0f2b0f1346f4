"""Kafka source and sink of the transform.

Needs Spark's Kafka connector on the class path (``--packages`` or ``--jars``). Options
are built apart from the reader so that they can be checked without a broker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.contract import INPUT_TOPIC, MICROBATCH_INTAKE, OUTPUT_TOPIC
from tidemark.streaming.execute import Sink


def source_options(bootstrap: str, topic: str = INPUT_TOPIC, mode: str = "microbatch",
                   max_offsets: int | None = MICROBATCH_INTAKE, starting_offsets: str = "latest") -> dict[str, str]:
    """Reader options; intake is bounded in micro-batch mode only.

    ``maxOffsetsPerTrigger`` may not be set in real-time mode.
    """
    if mode not in ("microbatch", "rtm"):
        raise ValueError(f"{mode!r} is no mode: real-time is 'rtm', batches are 'microbatch'")
    options = {"kafka.bootstrap.servers": bootstrap, "subscribe": topic, "startingOffsets": starting_offsets}
    if mode == "microbatch" and max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def kafka_event_source(spark: SparkSession, bootstrap: str, topic: str = INPUT_TOPIC, mode: str = "microbatch",
                       max_offsets: int | None = MICROBATCH_INTAKE, starting_offsets: str = "latest") -> DataFrame:
    """Stream of the topic's record values, from the latest offsets on."""
    options = source_options(bootstrap, topic, mode, max_offsets, starting_offsets)
    return spark.readStream.format("kafka").options(**options).load().select("value")


def batch_options(bootstrap: str, topic: str, min_partitions: int | None = None) -> dict[str, str]:
    """Reader options; Spark cuts topic partitions up to reach ``min_partitions`` tasks."""
    options = {"kafka.bootstrap.servers": bootstrap, "subscribe": topic,
               "startingOffsets": "earliest", "endingOffsets": "latest"}
    return {**options, "minPartitions": str(min_partitions)} if min_partitions else options


def kafka_batch_source(spark: SparkSession, bootstrap: str, topic: str, min_partitions: int | None = None) -> DataFrame:
    """All retained records of a topic, for analytics over a finished run.

    ``recv_ts`` is the record's time in epoch seconds. Only a topic with
    ``message.timestamp.type=LogAppendTime`` holds the broker's arrival time; otherwise the
    producer has set it, and ``e2e_ms`` lacks the way to the broker.
    """
    records = spark.read.format("kafka").options(**batch_options(bootstrap, topic, min_partitions)).load()
    return records.selectExpr("value", "unix_micros(timestamp) / 1000000D AS recv_ts")


def keyed_kafka_sink(bootstrap: str, topic: str = OUTPUT_TOPIC) -> Sink:
    """At-least-once sink for (key, value) records; duplicates follow a recovery."""
    return Sink("kafka", {"kafka.bootstrap.servers": bootstrap, "topic": topic})
