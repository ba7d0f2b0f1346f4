"""Queries that run the transform as a stream over replayed files, to the end of the input.

Kafka and real-time mode need a broker, so they have no query here; their options and
limits are covered by tests.
"""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.cluster import scratch_path
from tidemark.contract import OUTPUT_EVENT
from tidemark.functions.records import decode
from tidemark.operators import recovery, transform
from tidemark.plans import testbed as B
from tidemark.plans.transform_queries import ORACLES as TRANSFORM_ORACLES
from tidemark.plans.testbed import fixture_out_ts
from tidemark.sources.replay import RECORD, replay_stream
from tidemark.streaming.execute import file_sink, run, run_microbatch as start_microbatch


def _stream_once(spark: SparkSession, source: str, target: str, checkpoint: str, max_files: int | None = None) -> None:
    """Transform what the source holds and is not yet checkpointed, into the keyed sink."""
    stream = transform.transform_events(replay_stream(spark, source, max_files_per_trigger=max_files), fixture_out_ts())
    start_microbatch(stream, file_sink(target), checkpoint, available_now=True).awaitTermination()


def _delivered(spark: SparkSession, target: str) -> DataFrame:
    records = spark.read.schema(RECORD).parquet(target)
    return records.select("key", decode("value", OUTPUT_EVENT).alias("e")).select("key", "e.*")


def _paths(spark: SparkSession, name: str) -> tuple[str, str, str]:
    return tuple(scratch_path(spark, f"{name}-{part}") for part in ("source", "target", "checkpoint"))


def run_microbatch(spark: SparkSession, sf: str) -> DataFrame:
    """The transform as a micro-batch query into a keyed sink."""
    source, target, checkpoint = _paths(spark, "microbatch")
    B.raw_records(spark, sf).write.parquet(source)
    _stream_once(spark, source, target, checkpoint)
    return _delivered(spark, target)


def mode_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """The same, started by the name of its mode."""
    source, target, checkpoint = _paths(spark, "dispatch")
    B.raw_records(spark, sf).write.parquet(source)
    stream = transform.transform_events(replay_stream(spark, source), fixture_out_ts())
    run(stream, "microbatch", file_sink(target), checkpoint, available_now=True).awaitTermination()
    return _delivered(spark, target)


def bounded_file_intake(spark: SparkSession, sf: str) -> DataFrame:
    """Eight source files, taken at most three at a time."""
    source, target, checkpoint = _paths(spark, "bounded")
    B.raw_records(spark, sf).repartition(8).write.parquet(source)
    _stream_once(spark, source, target, checkpoint, max_files=3)
    return _delivered(spark, target)


def keyed_event_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Records delivered per key."""
    return run_microbatch(spark, sf).groupBy("key").agg(
        F.count("*").alias("records"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


def resume_from_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    """Stopped after half of the records; the rest arrive, and the query resumes."""
    source, target, checkpoint = _paths(spark, "resume")
    raw = B.raw_records(spark, sf).withColumn("half", F.pmod(F.xxhash64("value"), F.lit(2)))
    raw.filter("half = 0").drop("half").write.parquet(source)
    _stream_once(spark, source, target, checkpoint)
    raw.filter("half = 1").drop("half").write.mode("append").parquet(source)
    _stream_once(spark, source, target, checkpoint)
    return _delivered(spark, target)


def delivery_at_least_once(spark: SparkSession, sf: str) -> DataFrame:
    """The second of three batches is written, then fails before it is committed, and is replayed.

    The sink appends, as a topic does: the restarted query delivers that batch again and
    loses none.
    """
    source, target, checkpoint = _paths(spark, "replayed")
    third = F.get_json_object("value", "$.event_id").cast("bigint") % 3
    failed = []

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("append").parquet(target)
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("lost between write and commit")

    def start() -> StreamingQuery:
        stream = transform.transform_events(replay_stream(spark, source), fixture_out_ts())
        return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    for part in range(3):
        B.raw_records(spark, sf).filter(third == part).write.mode("append").parquet(source)
        query = start()
        try:
            query.awaitTermination()
        except StreamingQueryException:
            if failed != [part]:
                raise
            start().awaitTermination()
    if failed != [1]:
        raise RuntimeError("no batch failed")
    return recovery.duplicate_records(
        _delivered(spark, target).withColumns({"engine": B.two_runs(), "recv_ts": F.col("out_ts")}))


QUERIES = {
    f.__name__: f
    for f in (
        run_microbatch, mode_dispatch, bounded_file_intake, keyed_event_sink, resume_from_checkpoint,
        delivery_at_least_once,
    )
}

_KEYED = TRANSFORM_ORACLES["transform_events"]

ORACLES = {
    "run_microbatch": _KEYED,
    "mode_dispatch": _KEYED,
    "bounded_file_intake": _KEYED,
    "keyed_event_sink": f"""SELECT key, count(*) AS records, min(event_id) AS first_event,
        max(event_id) AS last_event FROM ({_KEYED}) GROUP BY key""",
    "resume_from_checkpoint": _KEYED,
    "delivery_at_least_once": f"""WITH {B.LATENCY_SQL},
        facts AS (SELECT engine, count(*) AS n, count(CASE WHEN event_id % 3 = 1 THEN 1 END) AS again FROM rec GROUP BY engine)
        SELECT engine, n + again AS total_records, again AS duplicate_records, again AS duplicated_ids,
          {B.fixed('100 * again::DOUBLE / (n + again)::DOUBLE', 3)} AS duplicate_rate_pct FROM facts""",
}
