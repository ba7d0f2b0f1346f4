"""Exact quantiles of groups of any size.

The built-in ``percentile`` keeps every distinct value of a group in one buffer. Here a
group is never brought together: values are counted in order-preserving buckets, the
buckets that hold the wanted ranks are narrowed pass by pass, and only the rows of the
last, small buckets are ranked. Each pass reads the group and value columns once and
shuffles partial counts alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.cluster import join_small, settle, stable

# Rows one task may rank at the end.
RANKED_ROW_LIMIT = 200_000
# Sub-buckets per narrowing pass.
SPLITS = 4096
# First pass: bucket width is 1/128 of the value, and 1/128000 around zero. The largest
# finite quotient falls into bucket 90,852 and all beyond it share one, on either side of
# zero: a group has at most 181,707 buckets.
UNIT = 1e-3
RESOLUTION = 128.0


def _first_bucket(x: Column) -> Column:
    """Logarithmic bucket number, non-decreasing in ``x``.

    Declared non-null: a join on it would otherwise test for null first and so compute
    the logarithm twice.
    """
    steps = F.floor(F.log1p(F.abs(x) / F.lit(UNIT)) * F.lit(RESOLUTION)).cast("bigint")
    return F.coalesce(F.when(x < 0, -steps).otherwise(steps), F.lit(0).cast("bigint"))


def _low_and_high(q: float, total: str) -> tuple[str, str]:
    """0-based ranks on both sides of the position of quantile ``q``, as SQL text."""
    low = f"CAST(floor({float(q)!r}D * ({total} - 1)) AS BIGINT)"
    return low, f"least({low} + 1, {total} - 1)"


def _inside(probs: Sequence[float]) -> str:
    """SQL text: those of the wanted ranks that fall into the row's bucket."""
    wanted = ", ".join(rank for q in probs for rank in _low_and_high(q, "total"))
    return f"filter(array_distinct(array({wanted})), k -> k >= before AND k < before + n)"


def _holding(buckets: DataFrame, group: list[str], order: str, probs: Sequence[float]) -> DataFrame:
    """Buckets that hold wanted ranks; ``before`` moves from the group's first rank to the bucket's."""
    running = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = buckets.withColumn("before", F.col("before") + F.sum("n").over(running) - F.col("n"))
    return placed.filter(f"size({_inside(probs)}) > 0")


def _keys(by: Sequence[str]) -> list[Column]:
    """Nulls do not join: a struct around each group column is never null itself."""
    return [F.struct(F.col(b)).alias(f"__k{i}") for i, b in enumerate(by)]


def bucket_counts(df: DataFrame, value: str, by: Sequence[str], kept: str | None = None) -> DataFrame:
    """First pass of ``exact_quantiles``: rows and extremes per group and bucket, settled.

    Null and NaN values, and rows that the boolean column ``kept`` leaves out, share a null
    bucket of their group, so that the rows of a group are known from the same pass: ``n``
    counts rows, ``kept_n`` those of them that are kept.
    """
    x = F.col(value).cast("double")
    stays = F.coalesce(F.col(kept), F.lit(False)) if kept else F.lit(True)
    rows = df.select(*_keys(by), F.when(stays & ~F.isnan(x), x).alias("x"), stays.alias("stays"))
    rows = rows.withColumn("b0", F.when(F.col("x").isNotNull(), _first_bucket(F.col("x"))))
    return settle(rows.groupBy(*[f"__k{i}" for i in range(len(by))], "b0").agg(
        F.count("*").alias("n"), F.count_if("stays").alias("kept_n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
        F.sum("x").alias("s")))


def exact_quantiles(df: DataFrame, value: str, by: Sequence[str], probs: Sequence[float],
                    ranked_rows: int = RANKED_ROW_LIMIT, splits: int = SPLITS, buckets: DataFrame | None = None) -> DataFrame:
    """Per group: ``count``, ``max``, ``mean`` and ``q`` (array, in the order of ``probs``).

    Linear interpolation at position q*(n-1). Nulls and NaN are left out; a group without
    values has no row. Runs a few small jobs to size the next pass. ``buckets`` are those of
    ``bucket_counts`` over the same rows, if they are at hand.
    """
    by = list(by)
    rows = stable(df.select(*by, F.col(value).cast("double").alias("x")).filter(
        F.col("x").isNotNull() & ~F.isnan("x")), "quantile-input")
    if buckets is None:
        buckets = bucket_counts(rows, "x", by)
    keys = [f"__k{i}" for i in range(len(by))]
    rows = rows.select(*_keys(by), "x", _first_bucket(F.col("x")).alias("b0"))
    group_facts = ["total", "sum", "max"]
    columns = [*keys, *group_facts, "b0", "lo", "hi", "n", "before"]

    whole = W.partitionBy(*keys)
    buckets = buckets.filter("b0 IS NOT NULL").select(
        "*", F.sum("n").over(whole).alias("total"), F.sum("s").over(whole).alias("sum"),
        F.max("hi").over(whole).alias("max"), F.lit(0).cast("bigint").alias("before"))
    found = settle(_holding(buckets, keys, "b0", probs).select(*columns))
    answers, open_ = found.filter(F.col("lo") == F.col("hi")), found.filter(F.col("lo") < F.col("hi"))

    # Within a group and first bucket the intervals are disjoint: ``lo`` names one.
    interval = [*keys, "b0", "lo"]
    facts = [F.first(c).alias(c) for c in [*group_facts, "before"]]
    while True:
        size = open_.agg(F.count("*").alias("rows"), F.max("n").alias("n")).first()
        if not size["rows"]:
            break
        members = join_small(rows, open_.drop("n"), [*keys, "b0"], F.col("x").between(F.col("lo"), F.col("hi")),
                             rows=size["rows"])
        if size["n"] <= ranked_rows:
            ranked = members.groupBy(*interval, "x").agg(F.count("*").alias("n"), *facts)
            ranked = _holding(ranked, interval, "x", probs)
            answers = answers.unionByName(ranked.select(*keys, *group_facts, "b0", F.col("x").alias("lo"),
                                                        F.col("x").alias("hi"), "n", "before"))
            break
        # Both ends of an interval occur and land in different buckets, so it shrinks.
        sub = F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * splits).cast("bigint")
        split = members.withColumn("sub", sub).groupBy(*interval, "sub").agg(
            F.count("*").alias("n"), F.min("x").alias("lo2"), F.max("x").alias("hi2"), *facts)
        split = _holding(split, interval, "sub", probs)
        split = settle(split.withColumns({"lo": F.col("lo2"), "hi": F.col("hi2")}).select(*columns))
        answers = answers.unionByName(split.filter(F.col("lo") == F.col("hi")))
        open_ = split.filter(F.col("lo") < F.col("hi"))

    # At most two (rank, value) pairs for each quantile and group.
    pairs = f"transform({_inside(probs)}, k -> named_struct('k', k, 'v', lo))"
    result = answers.groupBy(*keys).agg(
        F.first("total").alias("count"), F.first("max").alias("max"), F.expr("first(sum) / first(total)").alias("mean"),
        F.expr(f"map_from_entries(flatten(collect_list({pairs})))").alias("m"))
    return result.select(*[F.col(k)[b].alias(b) for b, k in zip(by, keys)], "count", "max", "mean",
                         F.expr(f"array({', '.join(_interpolate(q) for q in probs)})").alias("q"))


def _interpolate(q: float) -> str:
    low, high = _low_and_high(q, "count")
    part = f"({float(q)!r}D * (count - 1) - {low})"
    return f"m[{low}] * (1D - {part}) + m[{high}] * {part}"
