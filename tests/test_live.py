"""Measuring while a run lasts: phases, windows, parts of summaries, copies, counts, logs."""

import json
import random
import weakref

import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemark.contract import RUN_SUMMARY
from tidemark.operators import generate, latency, resources, summaries, transform
from tidemark.sources import runs
from tidemark.sources.replay import replay_stream
from tidemark.streaming import execute, measure

RECORDS = "engine string, event_id string, ts double, out_ts double, recv_ts double, pipeline_ms double, e2e_ms double"


def latency_rows(spark, n=600, seed=1):
    """Arrivals in order of time, of three runs, one of them null; a third of the rows are of the last one."""
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        recv = 1000.0 + k * 0.1
        late = draw.expovariate(1 / 20)
        rows.append((("a", None, "b")[min(2, k % 4)], str(k), recv - late / 1000, recv, recv, late, late + 1))
    return rows


class Replay:
    """Batches of latency records as a stream: one file each."""

    def __init__(self, spark, tmp_path, handle):
        self.spark, self.source, self.checkpoint, self.handle = spark, str(tmp_path / "source"), str(tmp_path / "checkpoint"), handle

    def add(self, *batches):
        for rows in batches:
            self.spark.createDataFrame(rows, RECORDS).coalesce(1).write.mode("append").parquet(self.source)
            stream = self.spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", 1).parquet(self.source)
            self.handle(stream, self.checkpoint)


def measured_by(spark, tmp_path, batches, seconds, warmup, salts=4):
    target = str(tmp_path / "target")

    def handle(stream, checkpoint):
        measured = measure.measure_stream(stream, seconds, warmup, salts=salts)
        execute.run_microbatch(measured, execute.file_sink(target), checkpoint, available_now=True).awaitTermination()

    Replay(spark, tmp_path, handle).add(*batches)
    return spark.read.parquet(target)


def test_live_phases_equal_the_batch(spark, tmp_path):
    """Every batch is a restart, so the start of a run comes from the state store."""
    rows = latency_rows(spark)
    found = measured_by(spark, tmp_path, [rows[:50], rows[50:300], rows[300:]], 40, 10)
    want = latency.tag_phase(spark.createDataFrame(rows, RECORDS), 10, 40)
    assert found.columns == want.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and 0 < want.filter("kept").count() < want.count() < 600


def test_start_is_that_of_the_first_batch(spark, tmp_path):
    def row(recv):
        return ("a", "1", 1.0, 1.0, recv, 0.0, 0.0)

    found = measured_by(spark, tmp_path, [[row(120.0), row(100.0), row(None), row(float("nan"))], [row(90.0), row(109.0), row(110.0), row(150.0)]], 50, 10, salts=2)
    assert sorted((r.recv_ts, r.kept) for r in found.collect()) == [(90.0, False), (100.0, False), (109.0, False), (110.0, True), (120.0, True)]


def test_a_run_without_times_has_no_start_yet(spark, tmp_path):
    def row(run, recv):
        return (run, "1", 1.0, 1.0, recv, 0.0, 0.0)

    found = measured_by(spark, tmp_path, [[row("a", None), row("b", 1.0)], [row("a", 5.0), row("a", 7.0)]], 50, 1)
    assert sorted((r.engine, r.recv_ts, r.kept) for r in found.collect()) == [("a", 5.0, False), ("a", 7.0, True), ("b", 1.0, False)]


def test_a_hot_run_is_dealt_over_its_salts(spark, tmp_path):
    seen = []
    rows = [("hot", str(k), 1.0, 1.0, 1.0 + k, 0.0, 0.0) for k in range(400)]

    def handle(stream, checkpoint):
        query = execute.run_microbatch(measure.measure_stream(stream, 1000, 0, salts=8), execute.file_sink(str(tmp_path / "t")), checkpoint, available_now=True)
        query.awaitTermination()
        seen.extend(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"])

    Replay(spark, tmp_path, handle).add(rows, rows)
    assert set(seen) == {8} and spark.read.parquet(str(tmp_path / "t")).count() == 800  # a start per salt, whatever the rows


@pytest.mark.parametrize("held_bytes", [1, 1 << 30])
def test_rows_held_back_until_the_start_is_known_are_not_in_memory(held_bytes):
    """Only one chunk at a time is there as a frame; the start is told by the last one."""
    class State:
        exists, got = False, None

        def update(self, value):
            self.got = value

    given, most = [], []

    def chunks():
        for k in range(40):
            rows = pd.DataFrame({"engine": "a", "event_id": [f"{k}-{i}" for i in range(50)] + [None], "recv_ts": [100.0 + k + i / 50 for i in range(50)] + [139.0 - k],
                                 "__begins": [False] * 50 + [True]})
            given.append(weakref.ref(rows))
            yield rows
            del rows
            most.append(sum(r() is not None for r in given))

    state = State()
    found = pd.concat(measure._phases(["engine", "event_id", "recv_ts"], 10.0, 30.0, held_bytes)(("a", 0), chunks(), state), ignore_index=True)
    assert state.got == (100.0,) and max(most) <= 2
    assert list(found.columns) == ["engine", "event_id", "recv_ts", "kept"]
    assert list(found["event_id"]) == [f"{k}-{i}" for k in range(30) for i in range(50)]
    assert list(found["kept"]) == [k >= 10 for k in range(30) for _ in range(50)]


def test_live_measure_wants_epoch_seconds(spark):
    with pytest.raises(ValueError, match="double"):
        measure.measure_stream(spark.createDataFrame([("a", 1)], "engine string, recv_ts bigint"), 1, 0)


# --- windows -------------------------------------------------------------------------


def test_windows_of_a_stream_with_late_rows(spark, tmp_path):
    target, late = str(tmp_path / "windows"), []
    schema = f"{RECORDS}, kept boolean"

    def row(recv, kept=True):
        return ("a", "1", 1.0, 1.0, recv, 0.0, 0.0, kept)

    source = str(tmp_path / "source")
    for rows in ([row(1.0, False), row(6.0), row(7.0)], [row(9.0), row(60.0)], [row(2.0), row(58.0), row(61.0)], [row(3.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = execute.run_batches(measure.window_counts(stream, "5 seconds", "10 seconds"), measure.progress_sink(target), str(tmp_path / "c"), "update")
        execute.drain(query)
        late.append(measure.late_rows(query))
    found = sorted(tuple(r) for r in measure.read_progress(spark, target).collect())
    # 2.0 and 3.0 come when 60.0 has closed their window; 58.0 is within ten seconds
    assert found == [("a", 0.0, 1, 0, 1, 0), ("a", 5.0, 3, 3, 4, 3), ("a", 55.0, 1, 1, 5, 4), ("a", 60.0, 2, 2, 7, 6)]
    assert late == [0, 0, 1, 1]


def test_windows_of_a_batch(spark):
    rows = spark.createDataFrame([("a", 0.5, True), ("a", 4.9, False), (None, 5.0, True), ("a", -0.1, True)], "engine string, recv_ts double, kept boolean")
    found = sorted(map(str, (tuple(r) for r in measure.window_counts(rows).collect())))
    assert found == sorted(map(str, [("a", -5.0, 1, 1), ("a", 0.0, 2, 1), (None, 5.0, 1, 1)]))


# --- parts of summaries ----------------------------------------------------------------


@pytest.fixture(scope="module")
def tagged(spark):
    rows = []
    draw = random.Random(5)
    for k in range(30_000):
        ms = draw.lognormvariate(3, 1)
        rows.append((("a", "b", None)[k % 7 % 3], str(k % 20_000), float(k), ms, ms + 2, k % 10 > 0))
    return spark.createDataFrame(rows, "engine string, event_id string, recv_ts double, pipeline_ms double, e2e_ms double, kept boolean").repartition(4).cache()


@pytest.mark.parametrize("split", ["event_id % 2", "recv_ts > 29000", "CAST(recv_ts AS INT) % 17", "engine IS NULL", "0"])
def test_merged_parts_equal_one_pass_within_the_errors(spark, tagged, tmp_path, split):
    parts = tagged.withColumn("p", F.expr(f"CAST({split} AS STRING)")).cache()
    for name in [r.p for r in parts.select("p").distinct().collect()]:
        summaries.write_part(summaries.summarise_part(parts.filter(F.col("p") == name).drop("p")), str(tmp_path / "s"), name)
    told = {r.engine: r for r in summaries.summary_from_parts(summaries.read_parts(spark, str(tmp_path / "s")), 300, 15).collect()}
    rows = tagged.collect()
    assert set(told) == {"a", "b", None}
    for engine, r in told.items():
        mine = [x for x in rows if x.engine == engine]
        kept = [x for x in mine if x.kept]
        assert (r.seen_records, r.kept_records, r.window_seconds) == (len(mine), len(kept), 285)
        assert r.span_s == max(x.recv_ts for x in mine) - min(x.recv_ts for x in mine)
        ids = len({x.event_id for x in mine})
        assert abs(r.distinct_ids - ids) <= summaries.IDS_ERROR * ids
        for c in ("pipeline_ms", "e2e_ms"):
            values = sorted(x[c] for x in kept)
            assert r[c]["count"] == len(values) and r[c]["max"] == round(values[-1], 3) and abs(r[c]["mean"] - sum(values) / len(values)) < 0.001
            for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
                below = sum(v < r[c][name] - 0.0005 for v in values)
                upto = sum(v <= r[c][name] + 0.0005 for v in values)
                slack = 2 * summaries.QUANTILE_ERROR * len(values) + 1  # twice: 30 comparisons at 99 of 100 each
                assert below - slack <= q * len(values) <= upto + slack


def test_merging_is_associative_on_counts(spark, tagged):
    halves = [summaries.summarise_part(tagged.filter(f"event_id % 2 = {k}")) for k in range(2)]
    again = summaries.merge_parts(summaries.merge_parts(halves[0].unionByName(halves[1])).unionByName(summaries.summarise_part(tagged.limit(0))))
    whole = summaries.summarise_part(tagged)
    exact = ["engine", "seen_records", "kept_records", "first_recv_ts", "last_recv_ts", "pipeline_ms_count", "pipeline_ms_max"]
    assert again.columns == whole.columns
    assert sorted(map(str, again.select(*exact).collect())) == sorted(map(str, whole.select(*exact).collect()))


def test_parts_replace_themselves(spark, tagged, tmp_path):
    for _ in range(2):
        summaries.write_part(summaries.summarise_part(tagged), str(tmp_path / "s"), 3)
    assert summaries.merge_parts(summaries.read_parts(spark, str(tmp_path / "s"))).agg(F.sum("seen_records")).first()[0] == 30_000


def test_a_run_that_kept_nothing(spark):
    rows = spark.createDataFrame([("a", "1", 1.0, 5.0, float("nan"), False), ("b", None, 1.0, None, 2.0, True)],
                                 "engine string, event_id string, recv_ts double, pipeline_ms double, e2e_ms double, kept boolean")
    told = {r.engine: r for r in summaries.summary_from_parts(summaries.summarise_part(rows), 300, 15).collect()}
    assert told["a"].kept_records == 0 and told["a"].pipeline_ms["count"] == 0 and told["a"].pipeline_ms["p50"] is None and told["a"].e2e_ms["mean"] is None
    assert told["b"].e2e_ms["p99"] == 2.0 and told["b"].pipeline_ms["p50"] is None and told["b"].distinct_ids == 1
    assert summaries.summary_from_parts(summaries.summarise_part(rows.limit(0)), 300, 15).collect() == []


def test_summary_columns_begin_like_the_exact_summary(spark, tagged):
    merged = summaries.summary_from_parts(summaries.summarise_part(tagged), 300, 15)
    assert merged.columns[:len(RUN_SUMMARY)] == RUN_SUMMARY.fieldNames()


# --- copies ----------------------------------------------------------------------------


def test_copies_are_removed_and_the_state_stays_bounded(spark, tmp_path):
    schema = "producer int, event_id bigint, at timestamp"
    source, target, sizes = str(tmp_path / "source"), str(tmp_path / "target"), []

    def batch(first, again=()):
        ids = [*range(first, first + 100), *again]
        rows = [(k % 2, k // 2, k) for k in ids] + ([(None, None, first)] * 2 if first == 0 else [])
        frame = spark.createDataFrame(rows, "producer int, event_id bigint, k bigint")
        frame.select("producer", "event_id", F.timestamp_seconds(F.col("k") + 1000).alias("at")).coalesce(1).write.mode("append").parquet(source)
        stream = measure.without_copies(spark.readStream.schema(schema).parquet(source), "at", "50 seconds")
        query = execute.run_microbatch(stream, execute.file_sink(target), str(tmp_path / "c"), available_now=True)
        query.awaitTermination()
        sizes.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])

    for k in range(12):
        batch(100 * k, again=[100 * k, 100 * k + 7, *range(100 * k - 20, 100 * k)] if k else [3, 3])
    found = [(r.producer, r.event_id) for r in spark.read.parquet(target).collect()]
    assert len(found) == len(set(found)) == 1201  # every id once, and one row without ids
    assert max(sizes) <= 260 and max(sizes[6:]) <= max(sizes[:6])


# --- counts of a pass --------------------------------------------------------------------


def damaged(spark):
    good = {"event_id": 1, "user_id": 2, "event_type": "purchase", "country": "us", "amount": 5.0, "ts": 1.0}
    values = [json.dumps(good), json.dumps({**good, "event_type": "click"}), json.dumps({**good, "amount": -1.0}), json.dumps({**good, "event_id": 1.0}),
              json.dumps({**good, "amount": "7"}), "not json", "", "   ", "[]", None, json.dumps({**good, "event_type": "add_to_cart", "country": None})]
    return spark.createDataFrame([("k", v) for v in values], "key string, value string")


def test_counts_equal_rejects_and_pass_rate(spark):
    raw = damaged(spark)
    counts = Observation("counts")
    rows = transform.transform_counted(raw, counts, F.lit(2.0)).collect()
    plain = transform.transform_events(raw, F.lit(2.0)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, plain))
    reasons = {r.reason: r["count"] for r in transform.rejects(raw).groupBy("reason").count().collect()}
    told = counts.get
    assert {k: told[f"rejected_{k}"] for k in ("null", "blank", "undecodable")} == {k: reasons.get(k, 0) for k in ("null", "blank", "undecodable")}
    assert told["received"] == 11 and told["decoded"] + sum(reasons.values()) == 11
    assert told["passed"] == len(rows) == resources.filter_pass_rate(transform.decode_events(raw)).first().passed


def test_counting_takes_one_scan_and_one_parse(spark, tmp_path, plan):
    damaged(spark).write.parquet(str(tmp_path / "raw"))
    text = plan(transform.transform_counted(spark.read.parquet(str(tmp_path / "raw")), Observation("one"), F.lit(2.0)))
    assert text.count("FileScan") == 1 and text.count("from_json") == 1 and "Exchange" not in text and "CollectMetrics" in text


def test_counts_of_a_stream_add_up_over_batches(spark, tmp_path):
    source = str(tmp_path / "source")
    for _ in range(3):
        damaged(spark).coalesce(1).write.mode("append").parquet(source)
    stream = transform.transform_counted(replay_stream(spark, source, max_files_per_trigger=1), "counts", F.lit(2.0))
    query = execute.run_microbatch(stream, execute.file_sink(str(tmp_path / "target")), str(tmp_path / "c"), available_now=True)
    query.awaitTermination()
    told = execute.observed_counts(query, "counts")
    assert told["received"] == 33 and told["rejected_null"] == 3 and told["rejected_blank"] == 6 and set(told) == set(transform.COUNTS)
    assert execute.observed_counts(query, "other") == {}


# --- logs of any size ----------------------------------------------------------------------


SUMMARY = {"engine": "r", "topic": "t", "kept_records": 3, "seen_records": 5, "window_seconds": 285, "warmup_seconds": 15, "throughput_eps": 1.5}


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_summary_of_a_log_larger_than_a_split(spark, tmp_path, small_splits):
    noise = "\n".join(f"record {k} seen" for k in range(3000))
    (tmp_path / "big_consumer.log").write_text(noise + "\n== " + json.dumps(SUMMARY, indent=2) + " ==\n" + noise)
    (tmp_path / "small_consumer.log").write_text(json.dumps({**SUMMARY, "kept_records": 4}))
    (tmp_path / "none_consumer.log").write_text(noise)
    (tmp_path / "swapped_consumer.log").write_text("} first\n" + noise + "\n{ last\n")
    (tmp_path / "empty_consumer.log").write_text("")
    logs = runs.read_logs(spark, str(tmp_path / "*_consumer.log"))
    assert spark.read.text(str(tmp_path / "big_consumer.log")).rdd.getNumPartitions() > 5
    assert {r.label: r.kept_records for r in runs.log_summary_extract(logs).collect()} == {"big": 3, "small": 4}
    assert {r.label: len(r.text.splitlines()) for r in logs.collect()} == {"big": 9, "small": 1}


def test_greedy_meaning_is_kept(spark, tmp_path):
    """From the first brace to the last, as before: two objects are read as one text."""
    import re

    text = "a {broken\nb\n" + json.dumps(SUMMARY) + "\n} end"
    (tmp_path / "x_consumer.log").write_text(text)
    (row,) = runs.read_logs(spark, str(tmp_path / "x_consumer.log")).collect()
    assert re.search(r"\{.*\}", row.text, re.S).group(0) == re.search(r"\{.*\}", text, re.S).group(0)


def test_a_span_that_cannot_be_a_summary_is_not_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "SUMMARY_CHARS", 1000)
    (tmp_path / "x_consumer.log").write_text("{\n" + "x" * 2000 + "\n}")
    assert runs.read_logs(spark, str(tmp_path / "x_consumer.log")).collect() == []


# --- generator -------------------------------------------------------------------------------


def test_draws_are_plain_integer_arithmetic():
    """The text means the same in Python."""
    def value(seq, seed, stream, size):
        return eval(generate.draw_sql(str(seq), seed, stream, size, "//"))  # noqa: S307

    drawn = [value(k, 42, 1, 100) for k in range(20_000)]
    assert min(drawn) == 0 and max(drawn) == 99
    counts = [drawn.count(v) for v in range(100)]
    assert sum((c - 200) ** 2 / 200 for c in counts) < 150  # chi-squared with 99 degrees of freedom
    pairs = [v // 10 * 10 + w // 10 for v, w in zip(drawn, drawn[1:])]
    assert sum((pairs.count(v) - 200) ** 2 / 200 for v in range(100)) < 160
    other = [value(k, 42, 2, 100) for k in range(20_000)]
    both = [v // 10 * 10 + w // 10 for v, w in zip(drawn, other)]
    assert sum((both.count(v) - 200) ** 2 / 200 for v in range(100)) < 160
    assert [value(k + generate.PRIME, 42, 1, 100) for k in range(50)] != drawn[:50]
    with pytest.raises(ValueError):
        generate.draw_sql("x", 1, 1, 0)
