"""Latency records, warm-up, percentiles, throughput and run summaries."""

import json
import math
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tidemark import cluster
from tidemark.operators import latency as L
from tidemark.operators.quantiles import bucket_counts, exact_quantiles


def percentile(values, q):
    """Linear interpolation at position q*(n-1)."""
    values = sorted(values)
    low = math.floor(q * (len(values) - 1))
    part = q * (len(values) - 1) - low
    return values[low] * (1 - part) + values[min(low + 1, len(values) - 1)] * part


def records(spark, rows):
    return spark.createDataFrame(rows, "engine string, recv_ts double, pipeline_ms double, e2e_ms double")


# --- parsing and latency -------------------------------------------------------------


@pytest.mark.parametrize("value, expected", [
    ('{"event_id":7,"ts":1.5,"out_ts":2.5}', ("7", 1.5, 2.5)),
    ('{"event_id":"a","ts":"1.5","out_ts":" 2 "}', ("a", 1.5, 2.0)),
    ('{"ts":1,"out_ts":2}', ("", 1.0, 2.0)),
    ('{"event_id":1,"ts":1.750684800123456E9,"out_ts":2}', ("1", 1750684800.123456, 2.0)),
    ('{"event_id":1,"out_ts":2}', None),
    ('{"event_id":1,"ts":null,"out_ts":2}', None),
    ('{"event_id":1,"ts":"soon","out_ts":2}', None),
    ('{"event_id":1,"ts":[1],"out_ts":2}', None),
    ("{'ts':1,'out_ts':2}", None),
    ('{"event_id":1,"ts":"1d","out_ts":2}', None),
    ('{"event_id":1,"ts":1,"out_ts":"2f"}', None),
    ('{"event_id":1,"ts":1,"out_ts":2} more', None),
    ('{"event_id":1,"ts":1,"out_ts":2}}', None),
    ('{"event_id":1,"ts":1,"out_ts":2}]}', None),
    ('{"event_id":1,"ts":1,"out_ts":2},{"ts":1,"out_ts":2}', None),
    ('[{"event_id":1,"ts":1,"out_ts":2}]', None),
    (' {"event_id":1,"ts":"-1e3","out_ts":".5"} ', ("1", -1000.0, 0.5)),
    ("7", None),
    ("not json", None),
    ("", None),
    (None, None),
])
def test_parse_output_events(spark, value, expected):
    df = spark.createDataFrame([("k", value, 9.0)], "key string, value string, recv_ts double")
    rows = L.parse_output_events(df).collect()
    assert [(r.event_id, r.ts, r.out_ts) for r in rows] == ([expected] if expected else [])
    assert all(r.recv_ts == 9.0 for r in rows)


def test_parse_reads_each_record_once(spark, plan):
    df = spark.createDataFrame([("k", "{}")], "key string, value string")
    assert plan(L.parse_output_events(df)).count("from_json(") == 1


def test_record_latency(spark):
    df = spark.createDataFrame([(10.0, 10.5, 11.0)], "ts double, out_ts double, recv_ts double")
    row = L.record_latency(df).first()
    assert (row.pipeline_ms, row.e2e_ms) == (500.0, 1000.0)
    stamped = L.record_latency(df.drop("recv_ts")).first()
    assert stamped.recv_ts > 1.7e9
    given = L.record_latency(df, F.lit(12.0)).first()
    assert given.e2e_ms == 2000.0


def test_warmup_bounds(spark):
    df = records(spark, [("a", 100.0 + t, t, t) for t in (0.0, 14.999, 15.0, 119.0, 120.0, 130.0)])
    kept = L.drop_warmup(df, 15, 120)
    assert sorted(r.recv_ts for r in kept.collect()) == [115.0, 219.0]
    tagged = L.tag_phase(df, 15, 120)
    assert tagged.count() == 4
    given = L.drop_warmup(df, 15, 120, start=90.0)
    assert sorted(r.recv_ts for r in given.collect()) == [114.999, 115.0]


def test_start_is_per_run_and_null_runs_are_kept(spark):
    df = records(spark, [("a", 100.0, 1.0, 1.0), ("a", 120.0, 1.0, 1.0), ("b", 500.0, 1.0, 1.0), ("b", 520.0, 1.0, 1.0),
                         (None, 50.0, 1.0, 1.0), (None, 70.0, 1.0, 1.0)])
    got = {(r.engine, r.recv_ts) for r in L.drop_warmup(df, 15, 100).collect()}
    assert got == {("a", 120.0), ("b", 520.0), (None, 70.0)}


# --- percentiles ---------------------------------------------------------------------


def skewed_values(rng, n):
    return [rng.choice([5.0, 5.5, 6.25]) if rng.random() < 0.4 else rng.lognormvariate(1.7, 1.2) for _ in range(n)]


CASES = {
    "skewed": lambda rng: skewed_values(rng, 4000),
    "constant": lambda rng: [3.25] * 500,
    "two values": lambda rng: [1.0] * 10 + [2.0] * 10,
    "single": lambda rng: [7.5],
    "pair": lambda rng: [1.0, 4.0],
    "negative": lambda rng: [rng.uniform(-50, 50) for _ in range(1500)],
    "tiny and huge": lambda rng: [10.0 ** rng.uniform(-12, 12) * rng.choice([-1, 1]) for _ in range(1500)],
    "adjacent doubles": lambda rng: [math.nextafter(5.0, 6.0), 5.0, math.nextafter(5.0, 4.0)] * 40,
    "narrow": lambda rng: [1e9 + rng.randrange(200) * 2.0**-20 for _ in range(3000)],
}


@pytest.mark.parametrize("ranked_rows, splits", [(200_000, 4096), (20, 4), (1, 3)])
def test_exact_quantiles_agree_with_sorting(spark, ranked_rows, splits):
    rng = random.Random(11)
    data = {name: make(rng) for name, make in CASES.items()}
    rows = [(name, float(v)) for name, values in data.items() for v in values]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows + [("skewed", None), ("nothing", None), ("skewed", float("nan"))], "g string, x double")
    probs = [0.0, 0.5, 0.95, 0.99, 1.0]
    got = {r.g: r for r in exact_quantiles(df.repartition(5), "x", ["g"], probs, ranked_rows, splits).collect()}
    assert set(got) == set(data)
    for name, values in data.items():
        assert got[name]["count"] == len(values) and got[name]["max"] == max(values)
        assert got[name]["mean"] == pytest.approx(math.fsum(values) / len(values), abs=1e-6, rel=1e-9)
        for q, value in zip(probs, got[name]["q"]):
            assert value == pytest.approx(percentile(values, q), rel=1e-12), (name, q)


def test_exact_quantiles_next_to_infinities(spark):
    values = [float("-inf")] * 30 + [float(v) for v in range(200)] + [float("inf")] * 20
    df = spark.createDataFrame([(v,) for v in values], "x double")
    row = exact_quantiles(df, "x", [], [0.1, 0.5, 0.99], ranked_rows=5, splits=4).first()
    assert row["q"][0] == float("-inf") and row["q"][1] == percentile(values, 0.5) and row["max"] == float("inf")


def test_exact_quantiles_of_null_groups_and_without_groups(spark):
    df = spark.createDataFrame([(None, "x", 1.0), (None, "x", 3.0), ("a", None, 5.0)], "g string, h string, x double")
    got = {(r.g, r.h): r["q"][0] for r in exact_quantiles(df, "x", ["g", "h"], [0.5]).collect()}
    assert got == {(None, "x"): 2.0, ("a", None): 5.0}
    assert exact_quantiles(df, "x", [], [0.5]).first()["q"] == [3.0]


def test_exact_quantiles_without_broadcast(spark, monkeypatch):
    """Too many groups to broadcast: the salted join gives the same answer."""
    rng = random.Random(5)
    rows = [(i % 50 if i % 3 else 0, rng.expovariate(0.1)) for i in range(6000)]
    df = spark.createDataFrame(rows, "g int, x double").repartition(6)
    expected = {r.g: r["q"] for r in exact_quantiles(df, "x", ["g"], [0.5, 0.99]).collect()}
    real, seen = cluster.join_small, []

    def salted(big, small, keys, condition=None, rows=None, **_):
        seen.append(keys)
        return real(big, small, keys, condition, max_rows=0, salts=5, rows=rows)

    monkeypatch.setattr("tidemark.operators.quantiles.join_small", salted)
    got = {r.g: r["q"] for r in exact_quantiles(df, "x", ["g"], [0.5, 0.99], ranked_rows=10, splits=8).collect()}
    assert got == expected and seen


def test_buffered_and_scalable_percentiles_agree(spark):
    rng = random.Random(3)
    rows = [(f"run{i % 3}" if i % 2 else "run0", v, i) for i, v in enumerate(skewed_values(rng, 6000))]
    df = spark.createDataFrame(rows, "engine string, ms double, i int")
    key = lambda r: r.engine
    small = sorted(L.latency_percentiles(df, "ms", method="buffered").collect(), key=key)
    large = sorted(L.latency_percentiles(df, "ms").collect(), key=key)
    narrowed = sorted(L.latency_percentiles_scalable(df, "ms", ranked_rows=50, splits=16).collect(), key=key)
    assert small == large == narrowed
    for r in L.latency_percentiles_scalable(df, "ms", method="approx").collect():
        exact = next(s for s in small if s.engine == r.engine)
        assert r["count"] == exact["count"] and r.p95 == pytest.approx(exact.p95, rel=0.02)
    with pytest.raises(ValueError):
        L.latency_percentiles_scalable(df, "ms", method="guess")


def test_percentiles_of_wall_clock_input_use_one_reading(spark):
    """A non-deterministic input is written once, not evaluated again for each pass."""
    df = L.record_latency(spark.range(3000).select(F.lit("a").alias("engine"), F.lit(1.0).alias("ts"),
                                                   F.lit(2.0).alias("out_ts")))
    assert cluster.stable(df) is not df
    row = L.latency_percentiles_scalable(df, "e2e_ms", ranked_rows=10, splits=8).first()
    assert row["count"] == 3000 and row.p50 <= row.p99 <= row.max


# --- summaries -----------------------------------------------------------------------


def test_run_summary(spark):
    values = [float(v) for v in range(1, 101)]
    df = records(spark, [("a", 1000.0 + i, v, v + 0.5) for i, v in enumerate(values)])
    row = L.run_summary(df, seconds=90, warmup_s=10).first()
    assert (row.engine, row.topic, row.seen_records, row.kept_records) == ("a", "output-events", 90, 80)
    assert (row.window_seconds, row.warmup_seconds, row.throughput_eps) == (80, 10, 1.0)
    kept = values[10:90]
    assert row.pipeline_ms["count"] == 80
    assert row.pipeline_ms["p50"] == round(percentile(kept, 0.5), 3)
    assert row.e2e_ms["p99"] == round(percentile(kept, 0.99) + 0.5, 3)
    assert row.e2e_ms["max"] == 90.5 and row.pipeline_ms["mean"] == 50.5


def test_run_with_only_warmup_and_run_without_records(spark):
    df = records(spark, [("a", 10.0, 1.0, 1.0), ("a", 10.5, 1.0, 1.0), ("b", 10.0, 1.0, 1.0), ("b", 70.0, 2.0, 3.0)])
    rows = {r.engine: r for r in L.empty_run_flag(
        L.run_summary(df, seconds=120, warmup_s=15, runs=["a", "b", "silent"])).collect()}
    assert rows["a"].empty_run and rows["silent"].empty_run and not rows["b"].empty_run
    assert (rows["a"].seen_records, rows["a"].kept_records, rows["a"].throughput_eps) == (2, 0, 0.0)
    assert rows["a"].pipeline_ms["count"] == 0 and rows["a"].pipeline_ms["p50"] is None
    assert rows["silent"].seen_records == 0
    assert rows["b"].e2e_ms["p95"] == 3.0 and rows["b"].e2e_ms["max"] == 3.0


def test_summary_of_no_records(spark):
    assert L.run_summary(records(spark, []), 120, 15).count() == 0
    assert L.run_summary(records(spark, []), 120, 15, runs=["x"]).first().kept_records == 0


def test_zero_window_does_not_divide_by_zero(spark):
    df = records(spark, [("a", 10.0, 1.0, 1.0)]).withColumn("kept", F.lit(True))
    assert L.throughput(df, 15, 15).first().throughput_eps == 1e9


def test_runs_of_any_size_are_not_buffered(spark, plan):
    df = records(spark, [("a", 1000.0 + i, float(i), float(i)) for i in range(100)])
    summary = L.run_summary(df, seconds=200, warmup_s=0)
    row = summary.first()
    assert row.pipeline_ms["p50"] == 49.5 and row.e2e_ms["p95"] == 94.05
    assert "percentile(" not in plan(summary)


def test_null_run_has_its_figures(spark):
    df = records(spark, [(e, 10.0 + i, float(i), float(i)) for i in range(20) for e in (None, "", "a")])
    rows = {r.engine: r for r in L.run_summary(df, seconds=100, warmup_s=0, runs=[None, "", "a", "b"]).collect()}
    assert set(rows) == {None, "", "a", "b"} and rows["b"].kept_records == 0
    assert all(rows[e].kept_records == rows[e].e2e_ms["count"] == 20 and rows[e].e2e_ms["p50"] == 9.5 for e in (None, "", "a"))


SCANS = """
import sys
sys.path.insert(0, sys.argv[3])
from tidemark.cluster import build_session
from tidemark.operators import latency
spark = build_session(master="local[2]", conf={
    "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "2",
    "spark.eventLog.enabled": "true", "spark.eventLog.dir": sys.argv[2], "spark.eventLog.compress": "false"})
records = spark.read.parquet(sys.argv[1])
latency.run_summary(records, 4000, 10, **eval(sys.argv[4])).collect()
spark.stop()
"""


@pytest.mark.parametrize("options, scans", [({}, 3), ({"start": 1000.0}, 2)])
def test_a_summary_scans_its_records_three_times(spark, tmp_path, options, scans):
    """By the records that tasks have read, from the event log of a session of its own."""
    rng = random.Random(7)
    rows = [(f"run{i % 3}", 1000.0 + i, v, v + rng.random()) for i, v in enumerate(skewed_values(rng, 3000))]
    records(spark, rows).write.parquet(str(tmp_path / "records"))
    (tmp_path / "events").mkdir()
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", SCANS, str(tmp_path / "records"), str(tmp_path / "events"), root, repr(options)],
                   check=True, capture_output=True, timeout=300)
    read = 0
    for file in (p for p in (tmp_path / "events").rglob("*") if p.is_file() and not p.name.startswith(".")):
        for line in file.read_text(errors="ignore").splitlines():
            if '"SparkListenerTaskEnd"' in line:
                read += json.loads(line)["Task Metrics"]["Input Metrics"]["Records Read"]
    assert read == scans * 3000


def test_bucket_counts_keep_what_is_left_out_apart(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 1.0, False), ("a", float("nan"), True), ("a", None, None), (None, 2.0, True)], "g string, x double, kept boolean")
    got = {(r['__k0'].g, r.b0 is None): (r.n, r.kept_n, r.lo) for r in bucket_counts(df, "x", ["g"], "kept").collect()}
    assert got == {("a", False): (1, 1, 1.0), ("a", True): (3, 1, None), (None, False): (1, 1, 2.0)}
