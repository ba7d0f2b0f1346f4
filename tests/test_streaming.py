"""The transform as a stream: batch equals stream, resuming, and the limits of real-time mode."""

import importlib.util
import json
import os
import time

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.contract import OUTPUT_EVENT
from tidemark.functions.records import decode
from tidemark.operators import generate, transform
from tidemark.plans.testbed import fixture_out_ts
from tidemark.sources.replay import RECORD, replay_stream
from tidemark.streaming import execute
from tidemark.streaming.execute import Sink, file_sink, run, run_microbatch, run_realtime
from tidemark.streaming.realtime import set_realtime_trigger

_PROBE = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools", "realtime_probe.py")
_spec = importlib.util.spec_from_file_location("realtime_probe", _PROBE)
realtime_probe = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(realtime_probe)


def decoded(df):
    return df.select("key", decode("value", OUTPUT_EVENT).alias("e")).select("key", "e.*")


def paths(tmp_path):
    return [str(tmp_path / n) for n in ("source", "target", "checkpoint")]


def stream(spark, source, **options):
    return transform.transform_events(replay_stream(spark, source, **options), fixture_out_ts())


def test_batch_and_stream_agree(spark, tmp_path):
    source, target, checkpoint = paths(tmp_path)
    records = generate.events_to_kafka_records(generate.synthetic_events(spark, 3000)).unionByName(
        spark.createDataFrame([("1", "not json"), ("2", None), (None, '{"event_type":"purchase","amount":5.0}')], RECORD))
    records.write.parquet(source)
    run(stream(spark, source), "microbatch", file_sink(target), checkpoint, available_now=True).awaitTermination()
    batch = decoded(transform.transform_events(records, fixture_out_ts()))
    streamed = decoded(spark.read.schema(RECORD).parquet(target))
    assert batch.exceptAll(streamed).count() == 0 and batch.count() == streamed.count() > 900


def test_intake_is_bounded_per_batch(spark, tmp_path):
    source, target, checkpoint = paths(tmp_path)
    generate.events_to_kafka_records(generate.synthetic_events(spark, 500, partitions=5)).write.parquet(source)
    query = run_microbatch(stream(spark, source, max_files_per_trigger=2), file_sink(target), checkpoint, available_now=True)
    query.awaitTermination()
    batches = [b for b in execute.batch_durations(query) if b["rows"]]
    assert [b["rows"] for b in batches] == [200, 200, 100]
    assert all("triggerExecution" in b for b in batches)


def test_resume_loses_and_repeats_nothing(spark, tmp_path):
    source, target, checkpoint = paths(tmp_path)
    events = generate.events_to_kafka_records(generate.synthetic_events(spark, 1000).filter("event_type = 'purchase' AND amount > 0"))
    first, second = events.randomSplit([0.5, 0.5], seed=3)
    first.write.parquet(source)
    run_microbatch(stream(spark, source), file_sink(target), checkpoint, available_now=True).awaitTermination()
    before = spark.read.schema(RECORD).parquet(target).count()
    second.write.mode("append").parquet(source)
    run_microbatch(stream(spark, source), file_sink(target), checkpoint, available_now=True).awaitTermination()
    after = spark.read.schema(RECORD).parquet(target)
    assert 0 < before < after.count() == events.count()
    assert decoded(after).select("event_id").distinct().count() == events.count()


def test_resume_after_a_failed_batch(spark, tmp_path):
    """A bad record stops the query; with the record readable again it goes on where it was."""
    source, target, checkpoint = paths(tmp_path)
    good = [("1", json.dumps({"event_id": i, "user_id": 1, "event_type": "purchase", "amount": 5.0, "ts": 1.0})) for i in range(5)]
    spark.createDataFrame(good, RECORD).write.parquet(source)

    def start(on_error):
        records = transform.transform_events(replay_stream(spark, source), F.lit(1.0), on_error=on_error)
        return run_microbatch(records, file_sink(target), checkpoint, available_now=True)

    start("fail").awaitTermination()
    spark.createDataFrame([("1", "not json")], RECORD).write.mode("append").parquet(source)
    with pytest.raises(Exception):
        start("fail").awaitTermination()
    start("null").awaitTermination()
    assert spark.read.schema(RECORD).parquet(target).count() == 5


def test_wall_clock_latency_of_a_stream(spark, tmp_path):
    source, target, checkpoint = paths(tmp_path)
    now = time.time()
    values = [("1", json.dumps({"event_id": i, "user_id": 1, "event_type": "purchase", "amount": 5.0, "ts": now})) for i in range(20)]
    spark.createDataFrame(values, RECORD).write.parquet(source)
    records = transform.transform_events(replay_stream(spark, source))
    run_microbatch(records, file_sink(target), checkpoint, available_now=True).awaitTermination()
    lags = decoded(spark.read.schema(RECORD).parquet(target)).selectExpr("out_ts - ts AS lag").collect()
    assert len(lags) == 20 and all(0 <= r.lag < 300 for r in lags)


def test_streaming_plan_has_no_exchange(spark, tmp_path):
    source, target, checkpoint = paths(tmp_path)
    generate.events_to_kafka_records(generate.synthetic_events(spark, 50)).write.parquet(source)
    query = run_microbatch(stream(spark, source), file_sink(target), checkpoint, available_now=True)
    query.awaitTermination()
    text = query._jsq.toString() and query._jsq.explainInternal(False)
    assert "Exchange" not in text and "Python" not in text


def test_unknown_mode(spark, tmp_path):
    source, target, checkpoint = paths(tmp_path)
    generate.events_to_kafka_records(generate.synthetic_events(spark, 5)).write.parquet(source)
    with pytest.raises(ValueError, match="is no mode"):
        run(stream(spark, source), "continuous", file_sink(target), checkpoint)


# --- real-time mode ------------------------------------------------------------------


@pytest.fixture
def aqe_off(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


class MemorySource:
    """The JVM's in-memory low-latency source: stands in for a topic."""

    def __init__(self, spark):
        self.jvm = spark._jvm
        encoder = self.jvm.org.apache.spark.sql.Encoders.STRING()
        self.stream = self.jvm.org.apache.spark.sql.execution.streaming.LowLatencyMemoryStream.apply(
            spark._jsparkSession, 1, encoder)
        self.df = DataFrame(self.stream.toDF(), spark)

    def add(self, *values):
        items = self.jvm.java.util.ArrayList()
        for v in values:
            items.add(v)
        self.stream.addData(self.jvm.scala.jdk.javaapi.CollectionConverters.asScala(items).toSeq())


def test_realtime_query_runs_and_delivers():
    """In a process of its own, whose console is the sink."""
    records = realtime_probe.measure(events=30, rate=50.0, timeout=240)
    assert [r["event_id"] for r in records] == [i for i in range(30) if i % 3 != 1]
    assert {(r["key"], r["amount_with_tax"], r["country"]) for r in records} == {("7", 22.38, "ES")}
    assert all(-0.01 < r["out_ts"] - r["ts"] < 10 for r in records)


def test_realtime_trigger_is_attached(spark, tmp_path):
    writer = replay_stream_of(spark, tmp_path).writeStream.format("console")
    assert set_realtime_trigger(writer, "5 seconds") is writer


def replay_stream_of(spark, tmp_path):
    source = str(tmp_path / "records")
    generate.events_to_kafka_records(generate.synthetic_events(spark, 5)).write.parquet(source)
    return replay_stream(spark, source)


@pytest.mark.parametrize("trigger", ["1 second", "4999 milliseconds", "soon", "5"])
def test_realtime_trigger_has_a_minimum(spark, tmp_path, trigger):
    with pytest.raises(ValueError):
        run_realtime(replay_stream_of(spark, tmp_path), Sink("console"), str(tmp_path / "c"), trigger)


def test_realtime_needs_a_checkpoint(spark, tmp_path):
    with pytest.raises(ValueError, match="checkpoint"):
        run(replay_stream_of(spark, tmp_path), "rtm", Sink("console"), "")


def refusal(start) -> str:
    """What Spark answers to a query it does not admit, at start or in its first batch."""
    try:
        query = start()
        try:
            query.awaitTermination(30)
        finally:
            query.stop()
    except Exception as error:
        return str(error)
    return ""


def test_realtime_rejects_file_sources(aqe_off, tmp_path):
    message = refusal(lambda: run_realtime(replay_stream_of(aqe_off, tmp_path), Sink("console"), str(tmp_path / "c")))
    assert "INPUT_STREAM_NOT_SUPPORTED" in message


def test_realtime_rejects_file_sinks(aqe_off, tmp_path):
    source = MemorySource(aqe_off)
    message = refusal(lambda: run_realtime(source.df, file_sink(str(tmp_path / "out")), str(tmp_path / "c")))
    assert "UNSUPPORTED_DATASOURCE" in message


def test_realtime_rejects_the_memory_sink(aqe_off, tmp_path):
    source = MemorySource(aqe_off)
    message = refusal(lambda: run_realtime(source.df, Sink("memory"), str(tmp_path / "c"), name="rtm_memory"))
    assert "REAL_TIME_MODE" in message


def test_realtime_rejects_python_functions(aqe_off, tmp_path):
    source = MemorySource(aqe_off)
    stamped = source.df.select(F.udf(lambda v: v)("value").alias("value"))
    message = refusal(lambda: run_realtime(stamped, Sink("console"), str(tmp_path / "c")))
    assert "REAL_TIME_MODE" in message


def test_realtime_rejects_append_mode(aqe_off, tmp_path):
    source = MemorySource(aqe_off)
    writer = source.df.writeStream.format("console").outputMode("append").option("checkpointLocation", str(tmp_path / "c"))
    message = refusal(lambda: set_realtime_trigger(writer, "5 seconds").start())
    assert "OUTPUT_MODE_NOT_SUPPORTED" in message


def test_realtime_rejects_stateful_operators(aqe_off, tmp_path):
    source = MemorySource(aqe_off)
    counted = source.df.groupBy("value").count()
    message = refusal(lambda: run_realtime(counted, Sink("console"), str(tmp_path / "c")))
    assert "REAL_TIME_MODE" in message
