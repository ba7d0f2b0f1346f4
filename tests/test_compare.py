"""Comparison tables."""

import pytest

from tidemark.contract import RUN_SUMMARY
from tidemark.operators import compare as C
from tidemark.operators.latency import flatten_summary


def summary(engine, p50, p99, eps=100.0):
    stats = {"count": 10, "p50": p50, "p95": (p50 + p99) / 2, "p99": p99, "max": p99 * 2, "mean": p50}
    e2e = {k: v if k == "count" else v + 1 for k, v in stats.items()}
    return {"engine": engine, "topic": "t", "kept_records": 10, "seen_records": 12, "window_seconds": 1, "warmup_seconds": 1,
            "throughput_eps": eps, "pipeline_ms": stats, "e2e_ms": e2e}


@pytest.fixture
def summaries(spark):
    return spark.createDataFrame([summary("fast-p6", 6.0, 9.0), summary("slow-p6", 48.0, 78.0), summary("fast-p12eq", 7.0, 18.0)],
                                 RUN_SUMMARY)


@pytest.fixture
def totals(spark):
    return spark.createDataFrame([("fast-p6", 0.25, 1.5, 2000.0, 2500.0), ("other", 1.0, 1.0, 1.0, 1.0)],
                                 "engine string, cpu_mean double, cpu_peak double, mem_mean double, mem_peak double")


def test_latency_table_keeps_the_callers_order(summaries):
    rows = C.latency_table(summaries, ["slow-p6", "missing", "fast-p6", "slow-p6"]).collect()
    assert [(r.position, r.engine) for r in rows] == [(0, "slow-p6"), (2, "fast-p6")]
    assert (rows[0].pipeline_p50, rows[0].e2e_p99, rows[0].throughput_eps, rows[0].kept_records) == (48.0, 79.0, 100.0, 10)


def test_resource_and_cost_tables(summaries, totals):
    usage = {r.engine: r.cpu_mean for r in C.resource_table(summaries, totals).collect()}
    assert usage == {"fast-p6": 0.25, "slow-p6": 0.0, "fast-p12eq": 0.0}
    cost = {r.engine: r.vcpu for r in C.cost_table(summaries, totals).collect()}
    assert cost == {"fast-p6": 0.25, "slow-p6": 0.1, "fast-p12eq": 0.1}


def test_resource_backlog_table_keeps_labels_without_data(spark):
    labels = spark.createDataFrame([("b",), ("a",), ("c",)], "label string")
    pods = spark.createDataFrame([("a", 1, 1.0, 2.0, 3, 4)], "label string, samples long, mean_cpu_cores double, peak_cpu_cores double, "
                                 "mean_mem_mb long, peak_mem_mb long")
    backlog = spark.createDataFrame([("b", 9, 8, 7, 6)], "label string, max_backlog long, final_backlog long, in_rate long, out_rate long")
    rows = [tuple(r) for r in C.resource_backlog_table(labels, pods, backlog).collect()]
    assert rows == [("a", 1.0, 2.0, 3, 4, None, None, None, None), ("b", None, None, None, None, 9, 8, 7, 6), ("c",) + (None,) * 8]


def test_speedup(summaries):
    got = {(r.engine, r.metric): r.ratio for r in C.speedup_ratio(flatten_summary(summaries), "slow-p6").collect()}
    assert got[("fast-p6", "pipeline_p50")] == 8.0 and got[("slow-p6", "e2e_max")] == 1.0 and len(got) == 24
    assert C.speedup_ratio(flatten_summary(summaries), "unknown").count() == 0


def test_speedup_of_zero_is_null(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 2.0)], "engine string, x double")
    assert {r.engine: r.ratio for r in C.speedup_ratio(df, "b", ["x"]).collect()} == {"a": None, "b": 1.0}


def test_speedup_has_no_cross_join(summaries, plan):
    text = plan(C.speedup_ratio(flatten_summary(summaries), "slow-p6"))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scaling(summaries):
    rows = {r.engine: (r.p6, r.p12eq, r.ratio) for r in C.scaling_compare(flatten_summary(summaries)).collect()}
    assert rows == {"fast": (9.0, 18.0, 2.0), "slow": (78.0, None, None)}


def test_split_label(spark):
    df = spark.createDataFrame([("a-b-p12eq",), ("a-p6",), ("x-chaos",), ("plain",), ("p6",)], "l string")
    got = [tuple(r.s) for r in df.select(C.split_label(df.l).alias("s")).collect()]
    assert got == [("a-b", "p12eq"), ("a", "p6"), ("x", "chaos"), ("plain", ""), ("p6", "")]


def test_data_rate_sweep(spark):
    runs = spark.createDataFrame([(150, 100_000.0, 15.0), (1024, 100_000.0, 14.0), (1024, 100_000.0, 15.0)],
                                 "payload_bytes int, event_rate double, e2e_p50 double")
    got = {r.payload_bytes: (r.runs, r.mb_per_s, r.e2e_p50) for r in C.data_rate_sweep(runs, ["e2e_p50"]).collect()}
    assert got == {150: (1, 15.0, 15.0), 1024: (2, 102.4, 14.5)}


def test_throughput_equivalence(spark):
    runs = spark.createDataFrame([("ok", 99_900.0, 33_300.0), ("behind", 100_000.0, 20_000.0), ("idle", 0.0, 0.0)],
                                 "engine string, in_rate double, out_rate double")
    got = {r.engine: r.keeps_up for r in C.throughput_equivalence(runs).collect()}
    assert got == {"ok": True, "behind": False, "idle": False}
