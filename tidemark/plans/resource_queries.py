"""Queries over resource, cost and backlog analytics and their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.rounding import round_columns
from tidemark.operators import latency, resources
from tidemark.plans import testbed as B
from tidemark.plans.latency_queries import WARMUP, WHOLE_RUN
from tidemark.sources import runs


def normalise_usage(spark: SparkSession, sf: str) -> DataFrame:
    return resources.normalise_usage(B.raw_usage(spark, sf))


def stats_csv_source(spark: SparkSession, sf: str) -> DataFrame:
    """Container samples from CSV files, with their engine."""
    return runs.read_container_stats(spark, B.container_stats_files(spark, sf))


def pod_samples_source(spark: SparkSession, sf: str) -> DataFrame:
    """Pod samples from text files, with their label."""
    return runs.read_pod_samples(spark, B.pod_sample_files(spark, sf))


def offset_samples_source(spark: SparkSession, sf: str) -> DataFrame:
    """Topic end offsets from text files, with their label."""
    return runs.read_offset_samples(spark, B.offset_sample_files(spark, sf))


def container_usage(spark: SparkSession, sf: str) -> DataFrame:
    return resources.container_usage(stats_csv_source(spark, sf))


def engine_usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    return resources.engine_usage_totals(container_usage(spark, sf))


def pod_usage(spark: SparkSession, sf: str) -> DataFrame:
    return resources.pod_usage(pod_samples_source(spark, sf))


def pod_usage_full_match(spark: SparkSession, sf: str) -> DataFrame:
    """All executor name patterns; figures to six decimals."""
    usage = resources.pod_usage_full_match(pod_samples_source(spark, sf))
    return round_columns(usage, dict.fromkeys(("mean_cpu", "peak_cpu", "mean_mem_gb", "peak_mem_gb"), 6))


def labelled_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return latency.run_summary(B.labelled_records(spark, sf), WHOLE_RUN, WARMUP)


def labelled_throughput(spark: SparkSession, sf: str) -> DataFrame:
    """What cost and usage need of the summaries: no percentiles."""
    tagged = latency.tag_phase(B.labelled_records(spark, sf), WARMUP, WHOLE_RUN)
    return latency.throughput(tagged, WHOLE_RUN, WARMUP)


def cost_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return resources.cost_estimate(engine_usage_totals(spark, sf), labelled_throughput(spark, sf))


def topic_backlog(spark: SparkSession, sf: str) -> DataFrame:
    return resources.topic_backlog(offset_samples_source(spark, sf))


def filter_pass_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Pass rate per country."""
    return round_columns(resources.filter_pass_rate(B.events(spark, sf), ["country"]), {"pass_rate": 6})


QUERIES = {
    f.__name__: f
    for f in (
        normalise_usage, stats_csv_source, pod_samples_source, offset_samples_source, container_usage,
        engine_usage_totals, pod_usage, pod_usage_full_match, cost_estimate, topic_backlog, filter_pass_rate,
    )
}

USAGE_SQL = f"""{B.STATS_SQL},
container_use AS (
  SELECT engine, container, {B.fixed('avg(cpu_pct / 100::DOUBLE)', 2)} AS mean_cpu_cores,
    {B.fixed('max(cpu_pct / 100::DOUBLE)', 2)} AS peak_cpu_cores,
    {B.fixed('avg(mem_used_mb)', 0)} AS mean_mem_mb, {B.fixed('max(mem_used_mb)', 0)} AS peak_mem_mb
  FROM stats GROUP BY engine, container
),
totals AS (
  SELECT engine, {B.fixed('sum(mean_cpu_cores)', 2)} AS cpu_mean, {B.fixed('sum(peak_cpu_cores)', 2)} AS cpu_peak,
    {B.fixed('sum(mean_mem_mb)', 0)} AS mem_mean, {B.fixed('sum(peak_mem_mb)', 0)} AS mem_peak
  FROM container_use WHERE NOT contains(container, 'kafka') GROUP BY engine
)"""


def pod_usage_sql(patterns: tuple[str, ...]) -> str:
    matches = " OR ".join(f"contains(pod, '{p}')" for p in patterns)
    return f"""
per_ts AS (
  SELECT label, ts, sum(millicores)::DOUBLE / 1000 AS cores, sum(mem_mib) AS mib
  FROM pods WHERE ns IN ('spark', 'flink') AND ({matches}) GROUP BY label, ts
)"""


POD_USE_SQL = f"""{pod_usage_sql(('rtm-bench', 'flink-bench'))},
pod_use AS (
  SELECT label, count(*) AS samples, {B.fixed('avg(cores)', 2)} AS mean_cpu_cores,
    {B.fixed('max(cores)', 2)} AS peak_cpu_cores, CAST({B.fixed('avg(mib)', 0)} AS BIGINT) AS mean_mem_mb,
    CAST({B.fixed('max(mib)', 0)} AS BIGINT) AS peak_mem_mb
  FROM per_ts GROUP BY label
)"""

# Backlog of every sample against the label's first one, straight from the definition.
BACKLOG_SQL = f"""
ends AS (
  SELECT *, row_number() OVER up AS at_start, row_number() OVER down AS at_end,
    first_value(ts) OVER up AS t0, first_value(in_end) OVER up AS in0, first_value(out_end) OVER up AS out0
  FROM offsets
  WINDOW up AS (PARTITION BY label ORDER BY ts, in_end), down AS (PARTITION BY label ORDER BY ts DESC, in_end DESC)
),
held AS (
  SELECT *, (in_end - in0) - (out_end - out0) / 0.333::DOUBLE AS backlog,
    CASE WHEN ts = t0 THEN 1 ELSE ts - t0 END AS span FROM ends
),
backlogs AS (
  SELECT label, CAST({B.fixed('max(backlog)', 0)} AS BIGINT) AS max_backlog,
    CAST({B.fixed('max(CASE WHEN at_end = 1 THEN backlog END)', 0)} AS BIGINT) AS final_backlog,
    CAST({B.fixed('max(CASE WHEN at_end = 1 THEN (in_end - in0)::DOUBLE / span END)', 0)} AS BIGINT) AS in_rate,
    CAST({B.fixed('max(CASE WHEN at_end = 1 THEN (out_end - out0)::DOUBLE / span END)', 0)} AS BIGINT) AS out_rate
  FROM held GROUP BY label HAVING count(*) >= 2
)"""

LABELLED_SUMMARY_SQL = B.summary_sql("rec", B.LABELS_SQL, WHOLE_RUN, WARMUP)
SUMMARY_AND_TOTALS_SQL = (
    f"{B.RUN_SQL}, {LABELLED_SUMMARY_SQL}, {USAGE_SQL.removeprefix(B.EVENTS_SQL).lstrip(',')}"
)

ORACLES = {
    "normalise_usage": f"""WITH {B.USAGE_SQL} SELECT event_id, cpu_pct,
        CASE unit WHEN 0 THEN {B.fixed('(n + 0.5) * 1024::DOUBLE', 1)} WHEN 1 THEN n + 0.25::DOUBLE
          WHEN 2 THEN {B.fixed('n / 1024::DOUBLE', 3)} ELSE n::DOUBLE END AS mem_used_mb FROM usage""",
    "stats_csv_source": f"WITH {B.STATS_SQL} SELECT * FROM stats",
    "pod_samples_source": f"WITH {B.PODS_SQL} SELECT * FROM pods",
    "offset_samples_source": f"WITH {B.OFFSETS_SQL} SELECT * FROM offsets",
    "container_usage": f"WITH {USAGE_SQL} SELECT * FROM container_use",
    "engine_usage_totals": f"WITH {USAGE_SQL} SELECT * FROM totals",
    "pod_usage": f"WITH {B.PODS_SQL}, {POD_USE_SQL} SELECT * FROM pod_use",
    "pod_usage_full_match": f"""WITH {B.PODS_SQL},
        {pod_usage_sql(('rtm-bench', 'flink-bench', 'rtm-pyspark-measured'))}
        SELECT label, count(*) AS samples, {B.fixed('avg(cores)', 6)} AS mean_cpu,
          {B.fixed('max(cores)', 6)} AS peak_cpu, {B.fixed('avg(mib) / 1024::DOUBLE', 6)} AS mean_mem_gb,
          {B.fixed('max(mib) / 1024::DOUBLE', 6)} AS peak_mem_gb FROM per_ts GROUP BY label""",
    "cost_estimate": f"""WITH {SUMMARY_AND_TOTALS_SQL},
        priced AS (SELECT engine, greatest(0.1::DOUBLE, cpu_mean) AS vcpu, mem_mean / 1024::DOUBLE AS mem_gb,
          coalesce(nullif(throughput_eps, 0), 1) AS eps FROM summary JOIN totals USING (engine))
        SELECT engine, vcpu, mem_gb, vcpu * 0.048::DOUBLE AS usd_per_hour,
          (vcpu * 0.048::DOUBLE) / (eps * 3600::DOUBLE) * 1e9::DOUBLE AS usd_per_billion FROM priced""",
    "topic_backlog": f"WITH {B.OFFSETS_SQL}, {BACKLOG_SQL} SELECT * FROM backlogs",
    "filter_pass_rate": f"""WITH {B.EVENTS_SQL} SELECT country, count(*) AS events,
        count(CASE WHEN {B.PASS_SQL} THEN 1 END) AS passed,
        {B.fixed(f'avg(CASE WHEN {B.PASS_SQL} THEN 1::DOUBLE ELSE 0::DOUBLE END)', 6)} AS pass_rate
        FROM m GROUP BY country""",
}
