"""Queries over the comparison tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rounding import round_columns
from tidemark.operators import compare, resources
from tidemark.operators.latency import flatten_summary
from tidemark.plans import resource_queries as Q
from tidemark.plans import testbed as B
from tidemark.sources import runs

# Order asked for by the caller; the last label has no run.
ORDER = ("beta-p6", "alpha-p6", "alpha-p12eq", "gamma")
DAY = 86_400


def latency_table(spark: SparkSession, sf: str) -> DataFrame:
    return compare.latency_table(Q.labelled_summaries(spark, sf), ORDER)


def resource_table(spark: SparkSession, sf: str) -> DataFrame:
    return compare.resource_table(Q.labelled_throughput(spark, sf), Q.engine_usage_totals(spark, sf))


def resource_backlog_table(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of pods and of summaries: the last one has neither pods nor offsets."""
    labels = Q.labelled_throughput(spark, sf).select(F.col("engine").alias("label"))
    return compare.resource_backlog_table(labels, Q.pod_usage(spark, sf), Q.topic_backlog(spark, sf))


def cost_table(spark: SparkSession, sf: str) -> DataFrame:
    return compare.cost_table(Q.labelled_throughput(spark, sf), Q.engine_usage_totals(spark, sf))


def speedup_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return compare.speedup_ratio(flatten_summary(Q.labelled_summaries(spark, sf)), "beta-p6")


def scaling_compare(spark: SparkSession, sf: str) -> DataFrame:
    return compare.scaling_compare(flatten_summary(Q.labelled_summaries(spark, sf)), "e2e_p99")


def _daily_runs(spark: SparkSession, sf: str) -> DataFrame:
    """A run per payload size and day: event rate and mean latencies."""
    payload = F.element_at(F.array(F.lit(150), F.lit(1024), F.lit(8192)), (F.col("user_id") % 3 + 1).cast("int"))
    records = B.latency_records(spark, sf).withColumn("payload_bytes", payload)
    return records.groupBy("payload_bytes", F.floor(F.col("ts") / DAY).alias("day")).agg(
        (F.count("*") / F.lit(float(DAY))).alias("event_rate"),
        F.max("pipeline_ms").alias("pipeline_max"), F.max("e2e_ms").alias("e2e_max"))


def data_rate_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Figures to six decimals."""
    sweep = compare.data_rate_sweep(_daily_runs(spark, sf), ["pipeline_max", "e2e_max"])
    return round_columns(sweep, dict.fromkeys(("event_rate", "mb_per_s", "pipeline_max", "e2e_max"), 6))


def label_listing(spark: SparkSession, sf: str) -> DataFrame:
    paths = B.consumer_log_files(spark, Q.labelled_summaries(spark, sf))
    return compare.label_listing(_log_folders(spark, paths))


def _log_folders(spark: SparkSession, paths: str) -> DataFrame:
    """Log paths as a sampler would have named them: Spark writes a folder per log."""
    inner = F.regexp_replace(F.col("path"), "/part-[^/]*$", "")
    return runs.list_files(spark, paths).select(F.regexp_replace(inner, "/file=([^/]*)$", "/$1").alias("path"))


def throughput_equivalence(spark: SparkSession, sf: str) -> DataFrame:
    """A run per ten users: output rate against input rate at a pass rate of two fifths."""
    events = B.events(spark, sf).withColumn("engine", F.expr("user_id div 10"))
    rates = resources.filter_pass_rate(events, ["engine"]).select(
        "engine", (F.col("events") / F.lit(float(DAY))).alias("in_rate"),
        (F.col("passed") / F.lit(float(DAY))).alias("out_rate"))
    return compare.throughput_equivalence(rates, tol=0.05, filter_pass=0.4)


QUERIES = {
    f.__name__: f
    for f in (
        latency_table, resource_table, resource_backlog_table, cost_table, speedup_ratio, scaling_compare,
        data_rate_sweep, label_listing, throughput_equivalence,
    )
}

_SUMMARY = f"{B.RUN_SQL}, {Q.LABELLED_SUMMARY_SQL}"
_FIGURES = ", ".join(compare.LATENCY_FIGURES)
_RESOURCES = """resources AS (
  SELECT engine, coalesce(cpu_mean, 0) AS cpu_mean, coalesce(cpu_peak, 0) AS cpu_peak,
    coalesce(mem_mean, 0) AS mem_mean, coalesce(mem_peak, 0) AS mem_peak
  FROM summary LEFT JOIN totals USING (engine))"""
_PODS = B.PODS_SQL.removeprefix(B.EVENTS_SQL).lstrip(",")
_OFFSETS = B.OFFSETS_SQL.removeprefix(B.EVENTS_SQL).lstrip(",")

ORACLES = {
    "latency_table": f"""WITH {_SUMMARY},
        wanted AS (SELECT * FROM (VALUES (0, 'beta-p6'), (1, 'alpha-p6'), (2, 'alpha-p12eq'), (3, 'gamma'))
          AS t(position, engine))
        SELECT CAST(position AS INTEGER) AS position, engine, kept_records, throughput_eps, {_FIGURES}
        FROM wanted JOIN summary USING (engine)""",
    "resource_table": f"WITH {Q.SUMMARY_AND_TOTALS_SQL}, {_RESOURCES} SELECT * FROM resources",
    "resource_backlog_table": f"""WITH {B.LATENCY_SQL}, {_PODS}, {Q.POD_USE_SQL}, {_OFFSETS}, {Q.BACKLOG_SQL},
        labels AS (SELECT DISTINCT {B.LABELS_SQL} AS label FROM rec)
        SELECT s.label, mean_cpu_cores, peak_cpu_cores, mean_mem_mb, peak_mem_mb, max_backlog,
          final_backlog, in_rate, out_rate
        FROM labels s LEFT JOIN pod_use p ON p.label = s.label LEFT JOIN backlogs b ON b.label = s.label""",
    "cost_table": f"""WITH {Q.SUMMARY_AND_TOTALS_SQL}, {_RESOURCES},
        priced AS (SELECT engine, greatest(0.1::DOUBLE, cpu_mean) AS vcpu, mem_mean / 1024::DOUBLE AS mem_gb,
          coalesce(nullif(throughput_eps, 0), 1) AS eps FROM summary JOIN resources USING (engine))
        SELECT engine, vcpu, mem_gb, vcpu * 0.048::DOUBLE AS usd_per_hour,
          (vcpu * 0.048::DOUBLE) / (eps * 3600::DOUBLE) * 1e9::DOUBLE AS usd_per_billion FROM priced""",
    "speedup_ratio": f"""WITH {_SUMMARY},
        long AS (UNPIVOT (SELECT engine, {_FIGURES} FROM summary) ON {_FIGURES} INTO NAME metric VALUE value)
        SELECT l.engine, l.metric, l.value, b.value AS baseline_value, b.value / nullif(l.value, 0) AS ratio
        FROM long l JOIN long b ON b.metric = l.metric AND b.engine = 'beta-p6'""",
    "scaling_compare": f"""WITH {_SUMMARY},
        parts AS (SELECT regexp_extract(engine, '^(.*)-(p6|p12eq)$', 1) AS engine,
          regexp_extract(engine, '^(.*)-(p6|p12eq)$', 2) AS config, e2e_p99 FROM summary),
        wide AS (SELECT engine, max(CASE WHEN config = 'p6' THEN e2e_p99 END) AS p6,
          max(CASE WHEN config = 'p12eq' THEN e2e_p99 END) AS p12eq FROM parts GROUP BY engine)
        SELECT *, p12eq / p6 AS ratio FROM wide""",
    "data_rate_sweep": f"""WITH {B.LATENCY_SQL},
        daily AS (SELECT ([150, 1024, 8192])[1 + user_id % 3] AS payload_bytes, floor(ts / {DAY}) AS day,
            count(*) / {DAY}::DOUBLE AS event_rate, max(pipeline_ms) AS pipeline_max, max(e2e_ms) AS e2e_max
          FROM rec GROUP BY ALL)
        SELECT CAST(payload_bytes AS INTEGER) AS payload_bytes, count(*) AS runs,
          {B.fixed('avg(event_rate)', 6)} AS event_rate,
          {B.fixed('any_value(payload_bytes) * avg(event_rate) / 1e6::DOUBLE', 6)} AS mb_per_s,
          {B.fixed('avg(pipeline_max)', 6)} AS pipeline_max, {B.fixed('avg(e2e_max)', 6)} AS e2e_max
        FROM daily GROUP BY payload_bytes""",
    "label_listing": f"WITH {_SUMMARY} SELECT engine AS label FROM summary",
    "throughput_equivalence": f"""WITH {B.EVENTS_SQL},
        rates AS (SELECT user_id // 10 AS engine, count(*) / {DAY}::DOUBLE AS in_rate,
          count(CASE WHEN {B.PASS_SQL} THEN 1 END) / {DAY}::DOUBLE AS out_rate FROM m GROUP BY 1)
        SELECT *, out_rate / (in_rate * 0.4::DOUBLE) AS out_ratio,
          out_rate / (in_rate * 0.4::DOUBLE) >= 0.95 AS keeps_up FROM rates""",
}
