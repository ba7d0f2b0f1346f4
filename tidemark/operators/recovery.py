"""Recovery analytics of a fault run: output stall, duplicates, totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.cluster import join_small, settle, stable
from tidemark.functions.rounding import round_columns

# Buckets one task orders when it looks for gaps.
GAP_BUCKETS = 65_536


def _between_buckets(buckets: DataFrame, part: list[str], order: str) -> DataFrame:
    """Add ``step``: distance from the end of the bucket before to the start of this one."""
    window = W.partitionBy(*part).orderBy(order)
    return buckets.withColumn("step", F.col("lo") - F.lag("hi").over(window))


def recovery_gap(df: DataFrame, by: Sequence[str] = ("engine",), buckets: int = GAP_BUCKETS) -> DataFrame:
    """Per run: ``gap_ms``, the longest time between consecutive ``recv_ts``; 0 below two rows.

    Rows are never ordered. Each run is cut into buckets that keep their first and last
    time, which gives every gap between buckets. If a bucket spans more than the largest
    of those, its run is cut once more, into buckets narrower than that gap: no gap
    within them can then be the largest. Null and NaN times are left out; a run that holds
    an infinite time and another one has an infinite gap. A run's buckets are ordered in
    chunks, and one task orders the chunks: a 65,536th of the fine buckets.
    """
    by = list(by)
    keys = [f"__k{i}" for i in range(len(by))] or ["__all"]
    named = [F.struct(F.col(b)).alias(k) for b, k in zip(by, keys)] or [F.lit(0).alias("__all")]
    rows = stable(df.select(*named, F.col("recv_ts").cast("double").alias("t")).filter(
        F.col("t").isNotNull() & ~F.isnan("t")), "gap-input")

    runs = settle(rows.groupBy(*keys).agg(F.min("t").alias("first"), F.max("t").alias("last")))
    infinite = F.lit(float("inf"))
    since = F.col("t") - F.col("first")
    width = F.col("last") - F.col("first")
    spanning = runs.filter((F.col("last") > F.col("first")) & (width < infinite))
    coarse = join_small(rows, spanning, keys).withColumn("bucket", F.floor(since / width * buckets).cast("bigint"))
    coarse = coarse.groupBy(*keys, "bucket").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    gaps = settle(_between_buckets(coarse, keys, "bucket").groupBy(*keys).agg(
        F.max("step").alias("gap"), F.max(F.col("hi") - F.col("lo")).alias("inner")))

    unsure = gaps.filter(F.col("inner") > F.col("gap")).select(*keys, "gap")
    count = unsure.count()
    if count:
        # The gap is that between two buckets, so it is positive; half of it as the width
        # leaves room for rounding.
        fine = join_small(rows, settle(spanning.join(unsure, keys).select(*keys, "first", "gap")), keys, rows=count)
        fine = fine.withColumn("bucket", F.floor(since / F.col("gap") * 2).cast("bigint"))
        fine = fine.groupBy(*keys, "bucket").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
        # There may be many fine buckets: order them in chunks, then the chunks.
        fine = fine.withColumn("chunk", F.expr(f"bucket div {int(buckets)}"))
        chunks = _between_buckets(fine, [*keys, "chunk"], "bucket").groupBy(*keys, "chunk").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("step").alias("within"))
        refined = _between_buckets(chunks, keys, "chunk").groupBy(*keys).agg(
            F.greatest(F.max("within"), F.max("step")).alias("gap"))
        gaps = gaps.select(*keys, "gap").unionByName(refined).groupBy(*keys).agg(F.max("gap").alias("gap"))

    result = runs.join(gaps, keys, "left")
    labels = [F.col(k)[b].alias(b) for b, k in zip(by, keys)]
    gap = F.when(width == infinite, infinite).otherwise(F.coalesce("gap", F.lit(0.0)) * F.lit(1000.0))
    return result.select(*labels, gap.alias("gap_ms"))


def recovery_report(df: DataFrame, by: str = "engine", key: str | Sequence[str] = "event_id") -> DataFrame:
    """One row per fault run: records, distinct ids, duplicates and their rate, span and longest gap."""
    records = stable(df, "fault-runs")
    counts = distinct_vs_total(records, [by], key).select(F.col(by).alias("__run"), "distinct_ids", "span_s")
    gaps = recovery_gap(records, [by]).withColumnRenamed(by, "__stalled")
    report = duplicate_records(records, [by], key)
    report = report.join(counts, F.col(by).eqNullSafe(F.col("__run"))).join(gaps, F.col(by).eqNullSafe(F.col("__stalled")))
    return report.select(by, "total_records", "distinct_ids", "duplicate_records", "duplicated_ids", "duplicate_rate_pct",
                         "span_s", "gap_ms")


def _per_id(df: DataFrame, by: list[str], key: Sequence[str]) -> DataFrame:
    """Rows per id; counted before the shuffle, so that a hot id is no burden."""
    return df.filter(F.col("recv_ts").isNotNull()).groupBy(*by, *key).agg(
        F.count("*").alias("copies"), F.min("recv_ts").alias("first"), F.max("recv_ts").alias("last"))


def duplicate_records(df: DataFrame, by: Sequence[str] = ("engine",), key: str | Sequence[str] = "event_id") -> DataFrame:
    """Per run: surplus records, ids that have them, and their share of all records in percent."""
    by, key = list(by), [key] if isinstance(key, str) else list(key)
    surplus = F.sum(F.col("copies") - 1)
    counts = _per_id(df, by, key).groupBy(*by).agg(
        F.sum("copies").alias("total_records"),
        surplus.alias("duplicate_records"),
        F.count_if(F.col("copies") > 1).alias("duplicated_ids"),
        (surplus * F.lit(100.0) / F.sum("copies")).alias("duplicate_rate_pct"),
    )
    return round_columns(counts, {"duplicate_rate_pct": 3})


def duplicates_by_producer(df: DataFrame, by: Sequence[str] = ("engine",)) -> DataFrame:
    """``duplicate_records`` where several producers each count their own event ids.

    Without a ``producer`` column, (event_id, user_id, ts) identifies an event.
    """
    key = ["producer", "event_id"] if "producer" in df.columns else ["event_id", "user_id", "ts"]
    return duplicate_records(df, by, key)


def distinct_vs_total(df: DataFrame, by: Sequence[str] = ("engine",), key: str | Sequence[str] = "event_id") -> DataFrame:
    """Per run: records, distinct ids, and seconds from the first to the last record."""
    by, key = list(by), [key] if isinstance(key, str) else list(key)
    return _per_id(df, by, key).groupBy(*by).agg(
        F.sum("copies").alias("total_records"),
        F.count("*").alias("distinct_ids"),
        (F.max("last") - F.min("first")).alias("span_s"),
    )
