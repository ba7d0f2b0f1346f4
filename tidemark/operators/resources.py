"""Resource, cost and backlog analytics of run samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.contract import (
    FILTER_PASS,
    MIN_VCPU,
    POD_NAMESPACES,
    POD_PATTERNS,
    POD_PATTERNS_FULL,
    SHARED_CONTAINERS,
    VCPU_HOUR_USD,
)
from tidemark.functions import records as R
from tidemark.functions import usage as U
from tidemark.functions.rounding import round_columns

# Decimals of mean and peak usage in reports.
USAGE_DIGITS = {"mean_cpu_cores": 2, "peak_cpu_cores": 2, "mean_mem_mb": 0, "peak_mem_mb": 0}


def normalise_usage(df: DataFrame) -> DataFrame:
    """Sampler text columns ``cpu``, ``mem`` and, if present, ``mem_share`` to numbers."""
    out = df.withColumns({"cpu_pct": U.percent(F.col("cpu")), "__used": U.used_number(F.col("mem"))})
    out = out.withColumn("mem_used_mb", U.used_mb(F.col("mem"), "__used"))
    if "mem_share" in df.columns:
        out = out.withColumn("mem_pct", U.percent(F.col("mem_share")))
    return out.drop("cpu", "mem", "mem_share", "__used")


def container_usage(stats: DataFrame) -> DataFrame:
    """Per engine and container: mean and peak cores and memory, rounded for the report."""
    cores = F.col("cpu_pct") / F.lit(100.0)
    usage = stats.groupBy("engine", "container").agg(
        F.avg(cores).alias("mean_cpu_cores"),
        F.max(cores).alias("peak_cpu_cores"),
        F.avg("mem_used_mb").alias("mean_mem_mb"),
        F.max("mem_used_mb").alias("peak_mem_mb"),
    )
    return round_columns(usage, USAGE_DIGITS)


def _contains_any(column: str, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(column).contains(p) for p in parts], F.lit(False))


def engine_usage_totals(usage: DataFrame, exclude: Sequence[str] = SHARED_CONTAINERS) -> DataFrame:
    """Per engine: sum of the rounded container figures, shared containers left out.

    The peak is a sum of peaks: containers need not peak together. An engine that has
    only shared containers gets zeros.
    """
    own = ~_contains_any("container", exclude)

    def total(column: str) -> Column:
        return F.sum(F.when(own, F.col(column)).otherwise(0.0))

    totals = usage.groupBy("engine").agg(
        total("mean_cpu_cores").alias("cpu_mean"),
        total("peak_cpu_cores").alias("cpu_peak"),
        total("mean_mem_mb").alias("mem_mean"),
        total("peak_mem_mb").alias("mem_peak"),
    )
    return round_columns(totals, {"cpu_mean": 2, "cpu_peak": 2, "mem_mean": 0, "mem_peak": 0})


def _pod_totals(samples: DataFrame, patterns: Sequence[str], namespaces: Sequence[str]) -> DataFrame:
    """Cores and MiB of an engine's own pods, summed per label and instant."""
    own = samples.filter(F.col("ns").isin(*namespaces) & _contains_any("pod", patterns))
    return own.groupBy("label", "ts").agg(
        (F.sum("millicores") / F.lit(1000.0)).alias("cores"), F.sum("mem_mib").alias("mib"))


def pod_usage(samples: DataFrame, patterns: Sequence[str] = POD_PATTERNS,
              namespaces: Sequence[str] = POD_NAMESPACES) -> DataFrame:
    """Per label: mean and peak over instants of the pods' summed usage.

    The peak is a peak of sums, unlike ``engine_usage_totals``. Labels without a matching
    pod have no row.
    """
    usage = _pod_totals(samples, patterns, namespaces).groupBy("label").agg(
        F.count("*").alias("samples"),
        F.avg("cores").alias("mean_cpu_cores"),
        F.max("cores").alias("peak_cpu_cores"),
        F.avg("mib").alias("mean_mem_mb"),
        F.max("mib").alias("peak_mem_mb"),
    )
    whole = {c: F.col(c).cast("bigint") for c in ("mean_mem_mb", "peak_mem_mb")}
    return round_columns(usage, USAGE_DIGITS).withColumns(whole)


def pod_usage_full_match(samples: DataFrame, patterns: Sequence[str] = POD_PATTERNS_FULL,
                         namespaces: Sequence[str] = POD_NAMESPACES) -> DataFrame:
    """``pod_usage`` with every executor name pattern; memory in GB, nothing rounded."""
    return _pod_totals(samples, patterns, namespaces).groupBy("label").agg(
        F.count("*").alias("samples"),
        F.avg("cores").alias("mean_cpu"),
        F.max("cores").alias("peak_cpu"),
        (F.avg("mib") / F.lit(1024.0)).alias("mean_mem_gb"),
        (F.max("mib") / F.lit(1024.0)).alias("peak_mem_gb"),
    )


def cost_estimate(totals: DataFrame, summary: DataFrame, rate: float = VCPU_HOUR_USD) -> DataFrame:
    """Dollars per hour and per 1e9 output events of engines with both inputs.

    Only vCPUs are priced, at least 0.1 of them; memory is shown. A missing or zero
    throughput counts as one event per second.
    """
    vcpu = F.greatest(F.lit(MIN_VCPU), F.col("cpu_mean"))
    eps = F.coalesce(F.nullif("throughput_eps", F.lit(0.0)), F.lit(1.0))
    priced = summary.select("engine", "throughput_eps").join(totals, "engine").withColumn("vcpu", vcpu)
    priced = priced.withColumn("usd_per_hour", F.col("vcpu") * F.lit(float(rate)))
    return priced.select(
        "engine",
        "vcpu",
        (F.col("mem_mean") / F.lit(1024.0)).alias("mem_gb"),
        "usd_per_hour",
        (F.col("usd_per_hour") / (eps * F.lit(3600.0)) * F.lit(1e9)).alias("usd_per_billion"),
    )


def topic_backlog(samples: DataFrame, filter_pass: float = FILTER_PASS) -> DataFrame:
    """Per label: largest and final backlog in input records, input and output rates.

    Backlog is the input since the first sample less the output since then divided by the
    pass rate. One aggregation: the sample with the largest backlog is the one with the
    largest ``in_end - out_end / pass``, whatever the first sample is.
    """
    sample = F.struct("ts", "in_end", "out_end")
    height = F.col("in_end") - F.col("out_end") / F.lit(float(filter_pass))
    facts = samples.groupBy("label").agg(
        F.count("*").alias("samples"), F.min(sample).alias("a"), F.max(sample).alias("z"),
        F.max_by(sample, height).alias("top"))

    def backlog(at: str) -> Column:
        put = F.col(f"{at}.in_end") - F.col("a.in_end")
        return put - (F.col(f"{at}.out_end") - F.col("a.out_end")) / F.lit(float(filter_pass))

    seconds = F.col("z.ts") - F.col("a.ts")
    span = F.when(seconds == 0, F.lit(1)).otherwise(seconds)

    figures = {
        "max_backlog": backlog("top"),
        "final_backlog": backlog("z"),
        "in_rate": (F.col("z.in_end") - F.col("a.in_end")) / span,
        "out_rate": (F.col("z.out_end") - F.col("a.out_end")) / span,
    }
    exact = facts.filter("samples >= 2").select("label", *[c.alias(name) for name, c in figures.items()])
    whole = {name: F.col(name).cast("bigint") for name in figures}
    return round_columns(exact, dict.fromkeys(figures, 0)).withColumns(whole)


def filter_pass_rate(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of events that pass the transform's filter."""
    passes = F.coalesce(R.is_purchase_intent(F.col("event_type"), F.col("amount")), F.lit(False))
    return events.groupBy(*by).agg(
        F.count("*").alias("events"),
        F.count_if(passes).alias("passed"),
        F.avg(passes.cast("int")).alias("pass_rate"),
    )
