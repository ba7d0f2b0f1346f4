"""Run artifacts: files in, files out."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.contract import RUN_SUMMARY
from tidemark.operators import compare
from tidemark.operators.latency import run_summary
from tidemark.sources import kafka, replay, runs

SUMMARY = {
    "engine": "run-p6", "topic": "output-events", "kept_records": 3, "seen_records": 5, "window_seconds": 285,
    "warmup_seconds": 15, "throughput_eps": 3334.5,
    "pipeline_ms": {"count": 3, "p50": 6.2, "p95": 8.1, "p99": 9.4, "max": 20.0, "mean": 6.5},
    "e2e_ms": {"count": 3, "p50": None, "p95": None, "p99": None, "max": None, "mean": None},
}
LOG = "[consumer] seen=5 kept=3 (steady)\n\n=== SUMMARY ===\n" + json.dumps(SUMMARY, indent=2) + "\n[consumer] wrote files\n"


def latencies(spark):
    rows = [(e, 1750684800.1234565, str(i), 1750684800.0, 1750684800.05, 50.0005, 123.4565) for e in "ab" for i in range(3)]
    return spark.createDataFrame(rows, "engine string, recv_ts double, event_id string, ts double, out_ts double, "
                                       "pipeline_ms double, e2e_ms double")


def test_latency_csv_has_fixed_decimals_and_header(spark, tmp_path):
    path = str(tmp_path / "csv")
    runs.latency_sink(latencies(spark), path)
    file = next(f for f in os.listdir(f"{path}/engine=a") if f.endswith(".csv"))
    lines = open(f"{path}/engine=a/{file}").read().splitlines()
    assert lines[0] == "recv_ts,event_id,ts,out_ts,pipeline_ms,e2e_ms"
    recv, _, ts, _, pipeline, _ = lines[1].split(",")
    assert (ts, pipeline) == ("1750684800.000000", f"{50.0005:.3f}") and recv == f"{1750684800.1234565:.6f}"
    assert runs.latency_records(spark, path).count() == 6


def test_latency_csv_survives_odd_stamps(spark, tmp_path):
    odd = latencies(spark).limit(1).withColumns({"ts": F.lit(float("nan")), "pipeline_ms": F.lit(float("inf"))})
    runs.latency_sink(odd, str(tmp_path / "odd"))
    row = runs.latency_records(spark, str(tmp_path / "odd")).first()
    assert row.ts != row.ts and row.pipeline_ms == float("inf") and row.out_ts == 1750684800.05
    far = latencies(spark).limit(1).withColumns({"recv_ts": F.lit(1e30), "e2e_ms": F.lit(float("-inf"))})
    runs.latency_sink(far, str(tmp_path / "far"))
    row = runs.latency_records(spark, str(tmp_path / "far")).first()
    assert row.recv_ts == 1e30 and row.e2e_ms == float("-inf")


def test_flat_latency_files_stay_two_runs(spark, tmp_path):
    head = "recv_ts,event_id,ts,out_ts,pipeline_ms,e2e_ms\n"
    (tmp_path / "x_latency.csv").write_text(head + "3.0,1,1.0,2.0,1000.0,2000.0\n,2,1.0,2.0,1.0,1.0\n")
    (tmp_path / "y-p6_latency.csv").write_text(head + "4.0,,1.0,2.0,1000.0,3000.0\n")
    got = sorted((r.engine, r.recv_ts, r.e2e_ms) for r in runs.read_latency_files(spark, str(tmp_path / "*_latency.csv")).collect())
    assert got == [("x", 3.0, 2000.0), ("y-p6", 4.0, 3000.0)]


def test_latency_parquet_keeps_doubles(spark, tmp_path):
    path = str(tmp_path / "parquet")
    runs.latency_sink(latencies(spark), path, "parquet")
    back = runs.latency_records(spark, path, "parquet")
    columns = ("engine", "recv_ts", "pipeline_ms")
    assert back.select(*columns).exceptAll(latencies(spark).select(*columns)).count() == 0


def test_latency_sink_does_not_shuffle(spark, tmp_path):
    """A run of any size stays spread over the tasks that hold it."""
    path = str(tmp_path / "spread")
    runs.latency_sink(latencies(spark).filter("engine = 'a'").repartition(3), path, "parquet")
    assert len([f for f in os.listdir(f"{path}/engine=a") if f.endswith(".parquet")]) == 3


def test_summary_round_trip(spark, tmp_path):
    summary = spark.createDataFrame([SUMMARY, {**SUMMARY, "engine": "other run+1"}], RUN_SUMMARY)
    path = str(tmp_path / "summaries")
    runs.write_summaries(summary, path)
    back = runs.read_summaries(spark, f"{path}/*_summary.json")
    assert {r.label for r in back.collect()} == {"run-p6", "other run+1"}
    assert back.drop("label").exceptAll(summary).count() == 0 and back.count() == 2


def test_pretty_printed_summary_file(spark, tmp_path):
    (tmp_path / "run-p6_summary.json").write_text(json.dumps(SUMMARY, indent=2))
    row = runs.read_summaries(spark, str(tmp_path / "*_summary.json")).first()
    assert row.label == "run-p6" and row.pipeline_ms["p99"] == 9.4 and row.e2e_ms["p50"] is None


def test_summary_in_a_log(spark, tmp_path):
    (tmp_path / "run-p6_consumer.log").write_text(LOG)
    (tmp_path / "empty_consumer.log").write_text("no summary here\n")
    (tmp_path / "broken_consumer.log").write_text("{ not json }\n")
    logs = runs.read_logs(spark, str(tmp_path / "*_consumer.log"))
    got = runs.log_summary_extract(logs).collect()
    assert [(r.label, r.kept_records, r.throughput_eps) for r in got] == [("run-p6", 3, 3334.5)]


def test_summary_file_is_preferred(spark, tmp_path):
    (tmp_path / "a_summary.json").write_text(json.dumps({**SUMMARY, "topic": "file"}))
    for label in ("a", "b"):
        (tmp_path / f"{label}_consumer.log").write_text(LOG)
    (tmp_path / "c_consumer.log").write_text("nothing")
    logs = runs.read_logs(spark, str(tmp_path / "*_consumer.log"))
    files = runs.read_summaries(spark, str(tmp_path / "*_summary.json"))
    got = {r.label: r.topic for r in runs.summary_prefer(files, logs).collect()}
    assert got == {"a": "file", "b": "output-events"}
    wanted = spark.createDataFrame([("b",), ("c",)], "label string")
    assert [r.label for r in runs.summary_prefer(files, logs, wanted).collect()] == ["b"]


def test_stats_of_several_engines(spark, tmp_path):
    head = "epoch,container,cpu_pct,mem_used_mb,mem_pct\n"
    (tmp_path / "a_stats.csv").write_text(head + "1,x,1.0,2.0,3.0\n2,x,,2.0,3.0\n3,x,1.0,n/a,3.0\n")
    (tmp_path / "b_stats.csv").write_text(head + "1,y,4.0,5.0,\n")
    got = sorted(tuple(r) for r in runs.read_container_stats(spark, str(tmp_path / "*_stats.csv")).collect())
    assert got == [(1, "x", 1.0, 2.0, 3.0, "a"), (1, "y", 4.0, 5.0, None, "b")]


def test_label_listing_reads_no_content(spark, tmp_path):
    for name in ("b_consumer.log", "a_consumer.log", "a_top.txt"):
        (tmp_path / name).write_text("x")
    files = runs.list_files(spark, str(tmp_path / "*"))
    assert [r.label for r in compare.label_listing(files).collect()] == ["a", "b"]
    assert [r.label for r in compare.label_listing(files, "_top.txt").collect()] == ["a"]


def test_replay_formats(spark, tmp_path):
    records = spark.createDataFrame([("1", '{"event_id":1}'), ("2", '{"event_id":2}')], "key string, value string")
    for fmt in ("parquet", "json"):
        records.write.format(fmt).save(str(tmp_path / fmt))
        assert replay.replay_source(spark, str(tmp_path / fmt), fmt).exceptAll(records).count() == 0
    records.select("value").write.text(str(tmp_path / "text"))
    assert replay.replay_source(spark, str(tmp_path / "text"), "text").count() == 2


# --- Kafka options -------------------------------------------------------------------


def test_kafka_intake_is_bounded_in_microbatch_mode_only():
    micro = kafka.source_options("broker:9092")
    assert micro["maxOffsetsPerTrigger"] == "200000" and micro["startingOffsets"] == "latest"
    assert kafka.source_options("broker:9092", max_offsets=2_000_000)["maxOffsetsPerTrigger"] == "2000000"
    assert "maxOffsetsPerTrigger" not in kafka.source_options("broker:9092", mode="rtm")
    assert micro["subscribe"] == "input-events" and micro["kafka.bootstrap.servers"] == "broker:9092"
    with pytest.raises(ValueError):
        kafka.source_options("broker:9092", mode="batch")


def test_a_topic_is_read_in_as_many_tasks_as_asked_for():
    assert kafka.batch_options("broker:9092", "output-events", 400)["minPartitions"] == "400"
    assert "minPartitions" not in kafka.batch_options("broker:9092", "output-events")


def test_kafka_sink_options():
    sink = kafka.keyed_kafka_sink("broker:9092")
    assert sink.format == "kafka" and dict(sink.options) == {"kafka.bootstrap.servers": "broker:9092", "topic": "output-events"}


def test_kafka_needs_its_connector(spark):
    """The connector is not part of Spark's own jars: the reader says so."""
    with pytest.raises(Exception, match="(?i)kafka"):
        kafka.kafka_event_source(spark, "broker:9092")
    with pytest.raises(Exception, match="(?i)kafka"):
        kafka.kafka_batch_source(spark, "broker:9092", "output-events")


def test_records_to_summary_file(spark, tmp_path):
    runs.write_summaries(run_summary(latencies(spark), 120, 0), str(tmp_path / "s"))
    back = runs.read_summaries(spark, str(tmp_path / "s" / "*_summary.json"))
    assert {(r.label, r.kept_records) for r in back.collect()} == {("a", 3), ("b", 3)}
    assert back.select(F.col("e2e_ms.max")).first()[0] == round(123.4565, 3)
