"""Side-by-side tables of runs.

Inputs are one row per run or label, so plain joins suffice and AQE picks the strategy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.cluster import settle
from tidemark.contract import FILTER_PASS, RUN_CONFIGS, VCPU_HOUR_USD
from tidemark.operators.latency import flatten_summary
from tidemark.operators.resources import cost_estimate

LATENCY_FIGURES = tuple(f"{side}_{q}" for side in ("pipeline", "e2e") for q in ("p50", "p95", "p99", "max"))


def ordered_labels(summaries: DataFrame, labels: Sequence[str] | DataFrame, name: str) -> DataFrame:
    """The caller's labels with their position; repeated labels keep the first one."""
    if isinstance(labels, DataFrame):
        return labels.select(name, "position")
    listed = list(enumerate(dict.fromkeys(labels)))
    return summaries.sparkSession.createDataFrame(listed, f"position int, {name} string")


def latency_table(summaries: DataFrame, labels: Sequence[str] | DataFrame) -> DataFrame:
    """One row per listed engine that has a summary, in the caller's order."""
    flat = flatten_summary(summaries).select("engine", "kept_records", "throughput_eps", *LATENCY_FIGURES)
    return ordered_labels(summaries, labels, "engine").join(flat, "engine").orderBy("position")


def resource_table(summaries: DataFrame, totals: DataFrame) -> DataFrame:
    """Usage totals of the engines that have a summary; zeros if they have no samples."""
    zero = {c: 0.0 for c in ("cpu_mean", "cpu_peak", "mem_mean", "mem_peak")}
    return summaries.select("engine").join(totals, "engine", "left").fillna(zero)


def resource_backlog_table(labels: DataFrame, pods: DataFrame, backlog: DataFrame) -> DataFrame:
    """Every label with its pod usage and backlog; null where a label has none."""
    usage = pods.select("label", "mean_cpu_cores", "peak_cpu_cores", "mean_mem_mb", "peak_mem_mb")
    return labels.select("label").join(usage, "label", "left").join(backlog, "label", "left").orderBy("label")


def cost_table(summaries: DataFrame, totals: DataFrame, rate: float = VCPU_HOUR_USD) -> DataFrame:
    """Cost of the engines that have a summary; without samples the minimum vCPU is priced."""
    return cost_estimate(resource_table(summaries, totals), summaries, rate)


def speedup_ratio(summaries: DataFrame, baseline: str, metrics: Sequence[str] = LATENCY_FIGURES) -> DataFrame:
    """Per engine and metric: the baseline's value divided by the engine's.

    ``summaries`` is flat (``flatten_summary``), or any table with an engine and metrics.
    It is evaluated once. Each of its rows is compared; of a baseline listed more than once
    the largest value counts, and without one there are no rows.
    """
    long = settle(summaries.select("engine", *metrics)).select("engine", F.inline(F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    # One row per metric named by the caller.
    base = long.filter(F.col("engine") == baseline).groupBy("metric").agg(F.max("value").alias("baseline_value"))
    return long.join(F.broadcast(base), "metric").withColumn(
        "ratio", F.col("baseline_value") / F.nullif("value", F.lit(0.0)))


def split_label(label: Column, configs: Sequence[str] = RUN_CONFIGS) -> Column:
    """Run label to struct(engine, config); config is empty without a known suffix."""
    suffix = "-(" + "|".join(configs) + ")$"
    return F.struct(F.regexp_replace(label, suffix, "").alias("engine"),
                    F.regexp_extract(label, suffix, 1).alias("config"))


def scaling_compare(summaries: DataFrame, metric: str = "pipeline_p99",
                    configs: Sequence[str] = ("p6", "p12eq")) -> DataFrame:
    """Per engine: the metric under each configuration, and last over first."""
    parts = summaries.select(split_label(F.col("engine")).alias("l"), metric).select("l.*", metric)
    table = parts.groupBy("engine").pivot("config", list(configs)).agg(F.max(metric))
    return table.dropna("all", subset=list(configs)).withColumn(
        "ratio", F.col(configs[-1]) / F.nullif(configs[0], F.lit(0.0)))


def data_rate_sweep(runs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per payload size: runs, event rate, MB/s (1e6 bytes) and the mean of each metric."""
    rate = F.avg("event_rate")
    return runs.groupBy("payload_bytes").agg(
        F.count("*").alias("runs"),
        rate.alias("event_rate"),
        (F.col("payload_bytes") * rate / F.lit(1e6)).alias("mb_per_s"),
        *[F.avg(m).alias(m) for m in metrics],
    )


def label_listing(files: DataFrame, suffix: str = "_consumer.log") -> DataFrame:
    """Distinct labels of file names ``<label><suffix>``, sorted."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    label = F.substring(name, F.lit(1), F.length(name) - len(suffix))
    return files.filter(name.endswith(suffix)).select(label.alias("label")).distinct().orderBy("label")


def throughput_equivalence(runs: DataFrame, tol: float = 0.05, filter_pass: float = FILTER_PASS) -> DataFrame:
    """Per run: output rate over the expected one, and whether the run keeps up within ``tol``."""
    expected = F.col("in_rate") * F.lit(float(filter_pass))
    return runs.withColumn("out_ratio", F.col("out_rate") / F.nullif(expected, F.lit(0.0))).withColumn(
        "keeps_up", F.coalesce(F.col("out_ratio") >= F.lit(1.0 - tol), F.lit(False)))
