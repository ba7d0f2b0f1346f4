"""Queries over recorded topics and measurements that are made while a run lasts."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.cluster import join_small, scratch_path, settle
from tidemark.contract import INPUT_EVENT, OUTPUT_EVENT, QUANTILES
from tidemark.functions.records import decode
from tidemark.operators import latency, summaries, transform
from tidemark.operators.latency import LATENCIES
from tidemark.plans import testbed as B
from tidemark.plans.latency_queries import SECONDS, WARMUP
from tidemark.plans.transform_queries import ORACLES as TRANSFORM_ORACLES
from tidemark.plans.testbed import fixture_out_ts, fixture_recv_ts
from tidemark.sources import runs
from tidemark.sources.replay import RECORD, replay_stream
from tidemark.sources.topic import record_topic, topic_source, topic_stream
from tidemark.streaming import execute, measure

# Batches in which a replayed topic is taken.
BATCHES = 4
PROGRESS = 300


def _paths(spark: SparkSession, name: str, *parts: str) -> list[str]:
    return [scratch_path(spark, f"{name}-{part}") for part in parts]


def _half(records: DataFrame, column: str) -> Column:
    """Whether a record lies in the earlier half of the time that ``records`` take."""
    span = records.agg(F.min(column).alias("a"), F.max(column).alias("z")).first()
    return F.lit(False) if span["a"] is None else F.col(column) <= F.lit((span["a"] + span["z"]) / 2)


def _cap(records: DataFrame) -> int:
    return max(1, -(-records.count() // BATCHES))


def _stamped(records: DataFrame, seconds: str) -> DataFrame:
    return records.withColumn("timestamp", F.timestamp_micros((F.col(seconds) * 1_000_000).cast("bigint")))


# --- recorded topics ---------------------------------------------------------------------


def recorded_topic_source(spark: SparkSession, sf: str) -> DataFrame:
    """Events recorded in two parts and read back, with what holds for their offsets."""
    (path,) = _paths(spark, "recorded", "topic")
    raw = _stamped(B.raw_records(spark, sf).withColumn("at", decode("value")["ts"]), "at")
    early = _half(raw, "at")
    record_topic(raw.filter(early), path)
    record_topic(raw.filter(~early), path)
    read = topic_source(spark, path)
    ends = settle(read.groupBy("partition").agg(F.max("offset").alias("last"), F.count("*").alias("n"), F.countDistinct("offset").alias("places")))
    whole = (F.col("last") + 1 == F.col("n")) & (F.col("n") == F.col("places"))
    checked = join_small(read, ends, ["partition"])
    return checked.select("key", decode("value", INPUT_EVENT).alias("e"), whole.alias("offsets_whole"),
                          (F.unix_micros("timestamp") == (decode("value")["ts"] * 1_000_000).cast("bigint")).alias("time_kept")).select(
        "key", "e.*", "offsets_whole", "time_kept")


def bounded_intake(spark: SparkSession, sf: str) -> DataFrame:
    """A topic taken by a number of rows: two thirds, then a restart with the rest."""
    source, target, checkpoint = _paths(spark, "intake", "topic", "target", "checkpoint")
    raw = B.raw_records(spark, sf)
    third = F.pmod(F.xxhash64("value"), F.lit(3))
    cap = _cap(raw)
    for part in (third > 0, third == 0):
        record_topic(raw.filter(part), source)
        stream = transform.transform_events(topic_stream(spark, source, cap), fixture_out_ts())
        batches = execute.drain(execute.run_microbatch(stream, execute.file_sink(target), checkpoint))
        if any(b["rows"] > cap for b in batches):
            raise RuntimeError(f"a batch has more than {cap} rows: {batches}")
    records = spark.read.schema(RECORD).parquet(target)
    return records.select("key", decode("value", OUTPUT_EVENT).alias("e")).select("key", "e.*")


# --- measuring while a run lasts -----------------------------------------------------------


def _arrivals(stream: DataFrame) -> DataFrame:
    """Output records to latency records under the given clock."""
    seen = latency.parse_output_events(stream).withColumn("n", F.col("event_id").cast("bigint"))
    received = seen.select(B.two_runs("n").alias("engine"), "event_id", "ts", "out_ts", fixture_recv_ts("ts", "n").alias("recv_ts"))
    return latency.record_latency(received)


def _output_topic(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed output records of the paced run, by the time they were sent."""
    sent = transform.transform_events(B.raw_records(spark, sf, B.PACE), fixture_out_ts())
    return _stamped(sent.withColumn("at", decode("value", OUTPUT_EVENT)["out_ts"]), "at")


def live_measure(spark: SparkSession, sf: str) -> DataFrame:
    """A run measured while it is replayed; the query is stopped half way and goes on with the run's start from its state."""
    source, target, checkpoint = _paths(spark, "live", "topic", "latency", "checkpoint")
    sent = _output_topic(spark, sf)
    early, cap = _half(sent, "at"), _cap(sent)
    for part in (early, ~early):
        record_topic(sent.filter(part), source)
        measured = measure.measure_stream(_arrivals(topic_stream(spark, source, cap)), SECONDS, WARMUP)
        text = runs.latency_text(measured, "engine", ("kept",))
        execute.drain(execute.run_microbatch(text, execute.Sink("csv", {"path": target, "header": "true"}, ("engine", "kept")), checkpoint))
    return runs.latency_records(spark, target, more=("kept boolean",))


def _measured(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of measured records, replayed from a topic."""
    (source,) = _paths(spark, "measured", "topic")
    sent = _output_topic(spark, sf)
    record_topic(sent, source)
    return measure.measure_stream(_arrivals(topic_stream(spark, source, _cap(sent))), SECONDS, WARMUP)


def windowed_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Seen and kept records of a replayed run in windows of five minutes, and up to each of them.

    A query of its own over the measured records: Spark admits no aggregation in update mode behind
    the state of the phases.
    """
    measured, target, first, second = _paths(spark, "progress", "measured", "windows", "measure", "count")
    execute.drain(execute.run_microbatch(_measured(spark, sf), execute.file_sink(measured), first))
    read = spark.readStream.schema(spark.read.parquet(measured).schema).option("maxFilesPerTrigger", 8).parquet(measured)
    counts = measure.window_counts(read, f"{PROGRESS} seconds", "1 hour")
    execute.drain(execute.run_batches(counts, measure.progress_sink(target), second, "update"))
    return measure.read_progress(spark, target)


def merged_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries of micro-batches, merged: exact counts, and whether the sketched figures keep to their errors."""
    target, checkpoint = _paths(spark, "parts", "summaries", "checkpoint")
    execute.drain(execute.run_batches(_measured(spark, sf), measure.summary_sink(target), checkpoint))
    told = settle(summaries.summary_from_parts(summaries.read_parts(spark, target), SECONDS, WARMUP))
    kept = latency.drop_warmup(B.latency_records(spark, sf, B.PACE), WARMUP, SECONDS)
    names = [(c, q) for c in LATENCIES for q in QUANTILES]
    against = join_small(kept.select("engine", *LATENCIES), told.select("engine", *[F.col(f"{c}.{n}").alias(f"{c}_{n}") for c, (n, _) in names]), ["engine"])
    # a figure is rounded to three decimals: half of the last one on either side
    ranks = against.groupBy("engine").agg(F.count("*").alias("n"), *[
        f for c, (n, _) in names for f in (F.count_if(F.col(c) < F.col(f"{c}_{n}") - 0.0005).alias(f"{c}_{n}_below"),
                                           F.count_if(F.col(c) <= F.col(f"{c}_{n}") + 0.0005).alias(f"{c}_{n}_upto"))])
    slack = F.ceil(F.col("n") * F.lit(summaries.QUANTILE_ERROR)) + 1
    near = [(F.ceil(F.col("n") * q).between(F.col(f"{c}_{n}_below") - slack, F.col(f"{c}_{n}_upto") + slack)).alias(f"{c.removesuffix('_ms')}_{n}_near") for c, (n, q) in names]
    ids_near = (F.abs(F.col("distinct_ids") - F.col("seen_records")) <= F.ceil(F.col("seen_records") * F.lit(summaries.IDS_ERROR))).alias("ids_near")
    flat = told.join(ranks, "engine").select(
        "engine", "kept_records", "seen_records", "window_seconds", "warmup_seconds", "throughput_eps", ids_near,
        *[F.col(f"{c}.{f}").alias(f"{c.removesuffix('_ms')}_{f}") for c in LATENCIES for f in ("count", "max", "mean")], *near)
    return flat


def copy_free_output(spark: SparkSession, sf: str) -> DataFrame:
    """Output that a failed batch has delivered twice, read as a stream: each id once."""
    source, sent, target, first, second = _paths(spark, "copies", "source", "sent", "target", "send", "read")
    failed = []

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("append").parquet(sent)
        if not failed:
            failed.append(batch_id)
            raise RuntimeError("lost between write and commit")

    def start() -> StreamingQuery:
        stream = transform.transform_events(replay_stream(spark, source), fixture_out_ts())
        return stream.writeStream.foreachBatch(append).option("checkpointLocation", first).trigger(availableNow=True).start()

    B.raw_records(spark, sf, B.PACE).write.parquet(source)
    try:
        start().awaitTermination()
    except StreamingQueryException:
        if not failed:
            raise
        start().awaitTermination()
    if not failed:
        raise RuntimeError("no batch failed")
    events = replay_stream(spark, sent).select(decode("value", OUTPUT_EVENT).alias("e")).select("e.*")
    timed = events.withColumns({"producer": F.lit(0), "sent_at": F.timestamp_micros((F.col("out_ts") * 1_000_000).cast("bigint"))})
    once = measure.without_copies(timed, "sent_at", "1 hour").drop("producer", "sent_at")
    execute.run_microbatch(once, execute.file_sink(target), second, available_now=True).awaitTermination()
    return spark.read.schema(OUTPUT_EVENT).parquet(target)


# --- counts of a pass ------------------------------------------------------------------------


def observed_transform(spark: SparkSession, sf: str) -> DataFrame:
    """What the transform counts in its own pass over damaged records, as a batch and as a stream."""
    batch, source, target, checkpoint = _paths(spark, "observed", "batch", "source", "target", "checkpoint")
    raw = B.messy_records(spark, sf)
    observation = Observation("transform")
    transform.transform_counted(raw, observation, fixture_out_ts()).write.parquet(batch)
    raw.select(F.lit(None).cast("string").alias("key"), "value").write.parquet(source)
    stream = transform.transform_counted(replay_stream(spark, source), "transform", fixture_out_ts())
    query = execute.run_microbatch(stream, execute.file_sink(target), checkpoint, available_now=True)
    query.awaitTermination()
    told = {"batch": observation.get, "stream": execute.observed_counts(query, "transform")}
    written = {"batch": batch, "stream": target}
    rows = [(mode, *(counts.get(c, 0) for c in transform.COUNTS), spark.read.schema(RECORD).parquet(written[mode]).count()) for mode, counts in told.items()]
    return spark.createDataFrame(rows, ", ".join(["mode string", *(f"{c} bigint" for c in transform.COUNTS), "written bigint"]))


def large_log_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries found in logs that have a line for every record of their run."""
    records = B.latency_records(spark, sf, B.PACE)
    paths = B.long_log_files(spark, settle(latency.run_summary(records, B.WHOLE_RUN, WARMUP)), records)
    return latency.flatten_summary(runs.log_summary_extract(runs.read_logs(spark, paths)))


QUERIES = {
    f.__name__: f
    for f in (recorded_topic_source, bounded_intake, live_measure, windowed_progress, merged_summaries, copy_free_output,
              observed_transform, large_log_extract)
}

_TAGGED = f"""{B.RUN_SQL}, begun AS (SELECT *, recv_ts - min(recv_ts) OVER (PARTITION BY engine) AS since FROM rec),
  tagged AS (SELECT *, since >= {WARMUP} AS kept FROM begun WHERE since < {SECONDS})"""

ORACLES = {
    "recorded_topic_source": f"""WITH {B.EVENTS_SQL} SELECT CAST(user_id AS VARCHAR) AS key, *, true AS offsets_whole,
        true AS time_kept FROM m""",
    "bounded_intake": TRANSFORM_ORACLES["transform_events"],
    "live_measure": f"""WITH {_TAGGED} SELECT engine, kept, CAST(event_id AS VARCHAR) AS event_id,
        {', '.join(f'{B.fixed(c, d)} AS {c}' for c, d in (('recv_ts', 6), ('ts', 6), ('out_ts', 6), ('pipeline_ms', 3), ('e2e_ms', 3)))}
        FROM tagged""",
    "windowed_progress": f"""WITH {_TAGGED}, counts AS (
        SELECT engine, floor(floor(recv_ts * 1000000) / 1000000 / {PROGRESS}) * {PROGRESS} AS window_start, count(*) AS seen,
          count(CASE WHEN kept THEN 1 END) AS kept FROM tagged GROUP BY ALL)
        SELECT *, CAST(sum(seen) OVER w AS BIGINT) AS seen_so_far, CAST(sum(kept) OVER w AS BIGINT) AS kept_so_far
        FROM counts WINDOW w AS (PARTITION BY engine ORDER BY window_start)""",
    "merged_summaries": f"""WITH {B.RUN_SQL}, {B.summary_sql('rec', 'engine', SECONDS, WARMUP)}
        SELECT engine, kept_records, seen_records, window_seconds, warmup_seconds, throughput_eps, true AS ids_near,
          {', '.join(f'{c}_{f}' for c in ('pipeline', 'e2e') for f in ('count', 'max', 'mean'))},
          {', '.join(f'true AS {c}_{n}_near' for c in ('pipeline', 'e2e') for n, _ in QUANTILES)} FROM summary""",
    "copy_free_output": f"""WITH {B.RUN_SQL} SELECT event_id, user_id, event_type, upper(country) AS country, amount,
        {B.TAX_SQL} AS amount_with_tax, ts, {B.OUT_TS_SQL} AS out_ts FROM m WHERE {B.PASS_SQL}""",
    "observed_transform": f"""WITH {B.EVENTS_SQL}, counts AS (
        SELECT count(*) AS received, count(CASE WHEN event_id % 10 NOT IN (0, 1, 2, 8) THEN 1 END) AS decoded, 0 AS rejected_null,
          count(CASE WHEN event_id % 10 = 8 THEN 1 END) AS rejected_blank,
          count(CASE WHEN event_id % 10 IN (0, 1, 2) THEN 1 END) AS rejected_undecodable,
          count(CASE WHEN {B.PASS_SQL} AND event_id % 10 NOT IN (0, 1, 6, 7, 8) THEN 1 END) AS passed FROM m)
        SELECT mode, counts.*, passed AS written FROM counts, (SELECT unnest(['batch', 'stream']) AS mode) modes""",
    "large_log_extract": f"""WITH {B.RUN_SQL}, {B.summary_sql('rec', 'engine', B.WHOLE_RUN, WARMUP)}
        SELECT engine AS label, * FROM summary""",
}
