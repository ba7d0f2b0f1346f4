"""Queries over latency and recovery analytics and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.cluster import join_small, scratch_path, settle
from tidemark.contract import QUANTILES
from tidemark.functions.rounding import round_nearest
from tidemark.operators import latency, recovery
from tidemark.operators.latency import LATENCIES
from tidemark.plans import testbed as B
from tidemark.sources import runs

DAY = 86_400
# Window of the paced runs, in seconds: records after it are cut off. That is what three queries show.
SECONDS, WARMUP = 2000, 150
# A window that ends after the run, for all the others.
WHOLE_RUN = B.WHOLE_RUN
ACCURACY = 10_000


def parse_output_events(spark: SparkSession, sf: str) -> DataFrame:
    return latency.parse_output_events(B.output_records(spark, sf))


def record_latency(spark: SparkSession, sf: str) -> DataFrame:
    return B.latency_records(spark, sf)


def drop_warmup(spark: SparkSession, sf: str) -> DataFrame:
    kept = latency.drop_warmup(B.latency_records(spark, sf, B.PACE), WARMUP, SECONDS)
    return kept.select("engine", "event_id", "recv_ts", "pipeline_ms", "e2e_ms")


def _latencies(spark: SparkSession, sf: str) -> DataFrame:
    return latency.unpivot_latencies(B.latency_records(spark, sf))


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return latency.latency_percentiles(_latencies(spark, sf), "ms", ["engine", "metric"])


def latency_percentiles_scalable(spark: SparkSession, sf: str) -> DataFrame:
    """The bucketed method with so few ranked rows that it has to narrow its buckets, pass by pass."""
    return latency.latency_percentiles_scalable(_latencies(spark, sf), "ms", ["engine", "metric"], ranked_rows=20, splits=16)


def latency_percentiles_approx(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the ranks of the sketch's figures are off by at most n / ``ACCURACY``."""
    by = ["engine", "metric"]
    values = _latencies(spark, sf)
    told = settle(latency.latency_percentiles_scalable(values, "ms", by, method="approx", accuracy=ACCURACY))
    ranked = join_small(values.select(*by, round_nearest("ms", 3).alias("ms")), told, by)
    ranks = ranked.groupBy(*by, "count", "max").agg(*[
        f for name, _ in QUANTILES for f in (F.count_if(F.col("ms") < F.col(name)).alias(f"{name}_below"),
                                             F.count_if(F.col("ms") <= F.col(name)).alias(f"{name}_upto"))])
    slack = F.col("count") / ACCURACY
    return ranks.select(*by, "count", "max", *[
        F.ceil(F.col("count") * q).between(F.col(f"{name}_below") - slack, F.col(f"{name}_upto") + slack).alias(f"{name}_near")
        for name, q in QUANTILES])


def throughput(spark: SparkSession, sf: str) -> DataFrame:
    tagged = latency.tag_phase(B.latency_records(spark, sf, B.PACE), WARMUP, SECONDS)
    return latency.throughput(tagged, SECONDS, WARMUP)


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Settled, as they are written, read and compared several times."""
    return settle(latency.run_summary(B.latency_records(spark, sf, B.PACE), WHOLE_RUN, WARMUP))


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the records carry no run: they are summarised as one of their own."""
    named = F.when(F.col("event_id") % 3 > 0, F.col("engine"))
    records = B.latency_records(spark, sf, B.PACE).withColumn("engine", named)
    return latency.flatten_summary(latency.run_summary(records, SECONDS, WARMUP))


def empty_run_flag(spark: SparkSession, sf: str) -> DataFrame:
    """One run per day and hour: a warm-up of nearly an hour empties most."""
    hour = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd HH")
    records = B.latency_records(spark, sf).withColumn("engine", hour)
    summary = latency.run_summary(records, DAY, 3500)
    return latency.empty_run_flag(summary).select("engine", "kept_records", "seen_records", "empty_run",
                                                  F.col("e2e_ms.p99").alias("e2e_p99"))


def latency_csv_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Records written as CSV, one folder per run, and read back with their fixed decimals."""
    path = scratch_path(spark, "latency-csv")
    records = B.latency_records(spark, sf).withColumn("event_id", F.col("event_id").cast("string"))
    runs.latency_sink(records, path)
    return runs.latency_records(spark, path)


def latency_file_source(spark: SparkSession, sf: str) -> DataFrame:
    """Records under ``<run>_latency.csv``, read back with the run of the name."""
    path = scratch_path(spark, "latency-files")
    records = B.latency_records(spark, sf).withColumn("file", F.concat("engine", F.lit("_latency.csv")))
    records.select("recv_ts", "event_id", "ts", "out_ts", "pipeline_ms", "e2e_ms", "file").write.partitionBy(
        "file").option("header", True).csv(path)
    return runs.read_latency_files(spark, f"{path}/*_latency.csv")


def summary_json_io(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries written one file per run and read back with their label."""
    path = scratch_path(spark, "summaries")
    runs.write_summaries(_summaries(spark, sf), path)
    return latency.flatten_summary(runs.read_summaries(spark, f"{path}/*_summary.json"))


def log_summary_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries found again in consumer logs."""
    paths = B.consumer_log_files(spark, _summaries(spark, sf))
    return latency.flatten_summary(runs.log_summary_extract(runs.read_logs(spark, paths)))


def summary_prefer(spark: SparkSession, sf: str) -> DataFrame:
    """A summary file for one run, whose log reports another topic; logs for both."""
    summaries = _summaries(spark, sf)
    logs = runs.read_logs(spark, B.consumer_log_files(spark, summaries.withColumn("topic", F.lit("from-log"))))
    path = scratch_path(spark, "summaries")
    runs.write_summaries(summaries.filter(F.col("engine") == "run_a"), path)
    files = runs.read_summaries(spark, f"{path}/*_summary.json")
    return latency.flatten_summary(runs.summary_prefer(files, logs))


def recovery_gap(spark: SparkSession, sf: str) -> DataFrame:
    return recovery.recovery_gap(B.latency_records(spark, sf))


def recovery_gap_refined(spark: SparkSession, sf: str) -> DataFrame:
    """So few buckets that the second cut has to find the gap."""
    return recovery.recovery_gap(B.latency_records(spark, sf), buckets=16)


def recovery_report(spark: SparkSession, sf: str) -> DataFrame:
    return recovery.recovery_report(B.duplicated_records(spark, sf))


def duplicate_records(spark: SparkSession, sf: str) -> DataFrame:
    return recovery.duplicate_records(B.duplicated_records(spark, sf))


def distinct_vs_total(spark: SparkSession, sf: str) -> DataFrame:
    return recovery.distinct_vs_total(B.duplicated_records(spark, sf))


def duplicates_by_producer(spark: SparkSession, sf: str) -> DataFrame:
    """Three producers that each count their own ids: with the producer, without, and by id alone."""
    copies = B.duplicated_records(spark, sf).withColumns({
        "producer": F.col("event_id") % 3, "event_id": F.expr("event_id div 3")})
    parts = {"producer": recovery.duplicates_by_producer(copies),
             "fallback": recovery.duplicates_by_producer(copies.drop("producer")),
             "event_id": recovery.duplicate_records(copies)}
    tagged = [df.withColumn("key", F.lit(k)) for k, df in parts.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


QUERIES = {
    f.__name__: f
    for f in (
        parse_output_events, record_latency, drop_warmup, latency_percentiles, latency_percentiles_scalable,
        latency_percentiles_approx, throughput, run_summary, empty_run_flag, latency_csv_sink, summary_json_io,
        log_summary_extract, summary_prefer, recovery_gap, recovery_gap_refined, duplicate_records,
        distinct_vs_total, duplicates_by_producer, latency_file_source, recovery_report,
    )
}

_FIGURES = " UNION ALL ".join(
    f"""SELECT engine, '{c}' AS metric, count(*) AS count, {B.fixed(f'quantile_cont({c}, 0.5)', 3)} AS p50,
      {B.fixed(f'quantile_cont({c}, 0.95)', 3)} AS p95, {B.fixed(f'quantile_cont({c}, 0.99)', 3)} AS p99,
      {B.fixed(f'max({c})', 3)} AS max, {B.fixed(f'avg({c})', 3)} AS mean FROM rec GROUP BY engine"""
    for c in LATENCIES
)
_SUMMARY = f"{B.RUN_SQL}, {B.summary_sql('rec', 'engine', WHOLE_RUN, WARMUP)}"
_WINDOW = f"{B.RUN_SQL}, {B.summary_sql('rec', 'engine', SECONDS, WARMUP)}"
_NULL_RUN = f"""{B.RUN_SQL}, named AS (
  SELECT * REPLACE (CASE WHEN event_id % 3 > 0 THEN engine END AS engine) FROM rec),
  {B.summary_sql('named', 'engine', SECONDS, WARMUP)}"""
_GAP = f"""WITH {B.LATENCY_SQL}, steps AS (
  SELECT engine, recv_ts - lag(recv_ts) OVER (PARTITION BY engine ORDER BY recv_ts) AS step FROM rec)
  SELECT engine, coalesce(max(step), 0) * 1000::DOUBLE AS gap_ms FROM steps GROUP BY engine"""


def _duplicates(key: str, source: str = "dup") -> str:
    return f"""SELECT engine, CAST(sum(c) AS BIGINT) AS total_records, CAST(sum(c - 1) AS BIGINT) AS duplicate_records,
        count(CASE WHEN c > 1 THEN 1 END) AS duplicated_ids,
        {B.fixed('100 * sum(c - 1)::DOUBLE / sum(c)::DOUBLE', 3)} AS duplicate_rate_pct
      FROM (SELECT engine, {key}, count(*) AS c FROM {source} GROUP BY ALL) GROUP BY engine"""


ORACLES = {
    "parse_output_events": f"""WITH {B.LATENCY_SQL} SELECT engine, recv_ts, CAST(event_id AS VARCHAR) AS event_id,
        ts, out_ts FROM rec WHERE event_id % 50 NOT IN (0, 2, 3, 4)""",
    "record_latency": f"WITH {B.LATENCY_SQL} SELECT * FROM rec",
    "drop_warmup": f"""WITH {B.RUN_SQL}, begun AS (
        SELECT *, recv_ts - min(recv_ts) OVER (PARTITION BY engine) AS since FROM rec)
        SELECT engine, event_id, recv_ts, pipeline_ms, e2e_ms FROM begun
        WHERE since >= {WARMUP} AND since < {SECONDS}""",
    "latency_percentiles": f"WITH {B.LATENCY_SQL} {_FIGURES}",
    "latency_percentiles_scalable": f"WITH {B.LATENCY_SQL} {_FIGURES}",
    "latency_percentiles_approx": f"""WITH {B.LATENCY_SQL} SELECT engine, metric, count, max,
        true AS p50_near, true AS p95_near, true AS p99_near FROM ({_FIGURES})""",
    "throughput": f"WITH {_WINDOW} SELECT engine, kept_records, seen_records, throughput_eps FROM summary",
    "run_summary": f"WITH {_NULL_RUN} SELECT * FROM summary",
    "empty_run_flag": f"""WITH {B.LATENCY_SQL},
        hourly AS (SELECT *, strftime(make_timestamp(CAST(floor(ts) AS BIGINT) * 1000000), '%Y-%m-%d %H') AS hour
          FROM rec),
        {B.summary_sql('hourly', 'hour', DAY, 3500)}
        SELECT engine, kept_records, seen_records, kept_records = 0 AS empty_run, e2e_p99 FROM summary""",
    "latency_csv_sink": f"""WITH {B.LATENCY_SQL} SELECT engine, CAST(event_id AS VARCHAR) AS event_id,
        {', '.join(f'{B.fixed(c, d)} AS {c}' for c, d in
                   (('recv_ts', 6), ('ts', 6), ('out_ts', 6), ('pipeline_ms', 3), ('e2e_ms', 3)))} FROM rec""",
    "summary_json_io": f"WITH {_SUMMARY} SELECT engine AS label, * FROM summary",
    "log_summary_extract": f"WITH {_SUMMARY} SELECT engine AS label, * FROM summary",
    "summary_prefer": f"""WITH {_SUMMARY} SELECT engine AS label, * REPLACE
        (CASE WHEN engine = 'run_a' THEN topic ELSE 'from-log' END AS topic) FROM summary""",
    "latency_file_source": f"""WITH {B.LATENCY_SQL} SELECT engine, CAST(event_id AS VARCHAR) AS event_id, recv_ts, ts,
        out_ts, pipeline_ms, e2e_ms FROM rec""",
    "recovery_report": f"""WITH {B.DUPLICATED_SQL},
        copies AS ({_duplicates('event_id')}),
        spans AS (SELECT engine, count(DISTINCT event_id) AS distinct_ids, max(recv_ts) - min(recv_ts) AS span_s
          FROM dup GROUP BY engine),
        steps AS (SELECT engine, recv_ts - lag(recv_ts) OVER (PARTITION BY engine ORDER BY recv_ts) AS step FROM dup),
        gaps AS (SELECT engine, coalesce(max(step), 0) * 1000::DOUBLE AS gap_ms FROM steps GROUP BY engine)
        SELECT * FROM copies JOIN spans USING (engine) JOIN gaps USING (engine)""",
    "recovery_gap": _GAP,
    "recovery_gap_refined": _GAP,
    "duplicate_records": f"WITH {B.DUPLICATED_SQL} {_duplicates('event_id')}",
    "distinct_vs_total": f"""WITH {B.DUPLICATED_SQL} SELECT engine, count(*) AS total_records,
        count(DISTINCT event_id) AS distinct_ids, max(recv_ts) - min(recv_ts) AS span_s FROM dup GROUP BY engine""",
    "duplicates_by_producer": f"""WITH {B.DUPLICATED_SQL},
        multi AS (SELECT * REPLACE (event_id // 3 AS event_id), event_id % 3 AS producer FROM dup)
        SELECT 'producer' AS key, * FROM ({_duplicates('producer, event_id', 'multi')})
        UNION ALL SELECT 'fallback' AS key, * FROM ({_duplicates('event_id, user_id, ts', 'multi')})
        UNION ALL SELECT 'event_id' AS key, * FROM ({_duplicates('event_id', 'multi')})""",
}
