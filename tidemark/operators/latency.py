"""Latency analytics of output events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.cluster import join_small, settle, stable
from tidemark.contract import OUTPUT_TOPIC, QUANTILES
from tidemark.functions.clock import wall_clock
from tidemark.functions.rounding import round_columns
from tidemark.operators.quantiles import bucket_counts, exact_quantiles

LATENCIES = ("pipeline_ms", "e2e_ms")

_STAMPS = T.StructType([T.StructField(c, T.StringType()) for c in ("event_id", "ts", "out_ts")])
_END = "end-of-record"
_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def parse_output_events(raw: DataFrame) -> DataFrame:
    """Output records to (event_id, ts, out_ts); other columns of ``raw`` are kept.

    A record is one JSON object with nothing after it. Both stamps must be numbers, or text
    that reads as one (digits without separators); other records are skipped. ``event_id``
    stays text and is empty when missing.
    """
    kept = [c for c in raw.columns if c not in ("key", "value", *_STAMPS.fieldNames())]
    # Read as a list that goes on after the record: text behind the object breaks the list.
    listed = F.concat(F.lit("["), F.col("value").cast("string"), F.lit(f',{{"event_id":"{_END}"}}]'))
    entry = F.from_json(listed, T.ArrayType(_STAMPS), {"allowSingleQuotes": "false"})

    def number(text: Column) -> Column:
        return F.when(text.rlike(_NUMBER), text.try_cast("double"))

    def stamps(items: Column) -> Column:
        e = F.when((F.size(items) == 2) & (F.get(items, F.lit(1))["event_id"] == _END), F.get(items, F.lit(0)))
        return F.struct(F.coalesce(e["event_id"], F.lit("")).alias("event_id"),
                        number(e["ts"]).alias("ts"), number(e["out_ts"]).alias("out_ts"))

    # One-element array, as in the transform: one JSON parse per record.
    parsed = F.filter(F.transform(F.array(entry), stamps), lambda e: e["ts"].isNotNull() & e["out_ts"].isNotNull())
    return raw.select(*kept, F.inline(parsed))


def record_latency(df: DataFrame, recv_ts: Column | None = None) -> DataFrame:
    """Add ``pipeline_ms`` and ``e2e_ms``.

    ``recv_ts`` defaults to the column of that name, else to the per-row clock.
    """
    if recv_ts is None:
        recv_ts = F.col("recv_ts") if "recv_ts" in df.columns else wall_clock()
    return df.withColumn("recv_ts", recv_ts).withColumns({
        "pipeline_ms": (F.col("out_ts") - F.col("ts")) * F.lit(1000.0),
        "e2e_ms": (F.col("recv_ts") - F.col("ts")) * F.lit(1000.0),
    })


def tag_phase(df: DataFrame, warmup_s: float, seconds: float, start: float | None = None,
              by: Sequence[str] = ("engine",)) -> DataFrame:
    """Add boolean ``kept``; records received at or after ``seconds`` are not part of the run.

    ``start`` is the run's first instant; by default the smallest ``recv_ts`` per group.
    """
    if start is not None:
        begun = df.withColumn("__start", F.lit(float(start)))
    else:
        by = list(by)
        keys = [f"__g{i}" for i in range(len(by))]
        # Struct keys compare null with null, which plain join keys do not.
        keyed = df.withColumns({k: F.struct(F.col(b)) for k, b in zip(keys, by)})
        if not by:
            keys, keyed = ["__g0"], df.withColumn("__g0", F.lit(0))
        first = settle(keyed.groupBy(*keys).agg(F.min("recv_ts").alias("__start")))
        begun = join_small(keyed, first, keys).drop(*keys)
    since = F.col("recv_ts") - F.col("__start")
    return begun.filter(since < float(seconds)).withColumn("kept", since >= float(warmup_s)).drop("__start")


def drop_warmup(df: DataFrame, warmup_s: float, seconds: float, start: float | None = None,
                by: Sequence[str] = ("engine",)) -> DataFrame:
    """Steady-state records: those received from ``warmup_s`` on and before ``seconds``."""
    return tag_phase(df, warmup_s, seconds, start, by).filter("kept").drop("kept")


def unpivot_latencies(df: DataFrame, by: Sequence[str] = ("engine",)) -> DataFrame:
    """One row per record and latency: ``metric`` (its column name) and ``ms``.

    Both latencies are then summarised in the same passes, as groups of their own.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("ms")) for c in LATENCIES])
    return df.select(*by, F.inline(pairs))


def _report(stats: DataFrame, by: list[str]) -> DataFrame:
    names = [name for name, _ in QUANTILES]
    figures = stats.select(*by, "count", *[F.col("q")[i].alias(n) for i, n in enumerate(names)], "max", "mean")
    return round_columns(figures, dict.fromkeys([*names, "max", "mean"], 3))


def _buffered(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    x = F.when(~F.isnan(col), F.col(col))
    probs = F.array(*[F.lit(q) for _, q in QUANTILES])
    stats = df.groupBy(*by).agg(F.count(x).alias("count"), F.max(x).alias("max"), F.avg(x).alias("mean"),
                                F.percentile(x, probs).alias("q"))
    return stats.filter("count > 0")


def latency_percentiles(df: DataFrame, col: str, by: Sequence[str] = ("engine",),
                        method: str = "histogram", buckets: DataFrame | None = None) -> DataFrame:
    """Per group: count, p50, p95, p99, max, mean; exact, to three decimals.

    The bucketed method serves every size. ``method="buffered"`` asks for the built-in
    ``percentile``, which brings the distinct values of a group together in one task: for
    groups that are known to be small. ``buckets`` spare the first pass (``bucket_counts``).
    """
    by = list(by)
    if method == "buffered":
        return _report(_buffered(df.select(*by, F.col(col).cast("double").alias(col)), col, by), by)
    return latency_percentiles_scalable(df, col, by, method, buckets=buckets)


def latency_percentiles_scalable(df: DataFrame, col: str, by: Sequence[str] = ("engine",), method: str = "histogram",
                                 accuracy: int = 10_000, buckets: DataFrame | None = None, **limits: int) -> DataFrame:
    """As ``latency_percentiles``, for groups of any size.

    ``method="histogram"`` is exact; ``"approx"`` uses ``percentile_approx`` in one pass:
    its ranks are within n/``accuracy`` and it does not interpolate.
    """
    by = list(by)
    if method == "histogram":
        return _report(exact_quantiles(df, col, by, [q for _, q in QUANTILES], buckets=buckets, **limits), by)
    if method == "approx":
        x = F.when(~F.isnan(col), F.col(col))
        probs = [q for _, q in QUANTILES]
        stats = df.groupBy(*by).agg(F.count(x).alias("count"), F.max(x).alias("max"), F.avg(x).alias("mean"),
                                    F.percentile_approx(x, probs, accuracy).alias("q"))
        return _report(stats.filter("count > 0"), by)
    raise ValueError(f"method must be 'histogram' or 'approx', not {method!r}")


def _with_throughput(counts: DataFrame, seconds: float, warmup_s: float) -> DataFrame:
    window = max(1e-9, float(seconds) - float(warmup_s))
    return round_columns(counts.withColumn("throughput_eps", F.col("kept_records") / F.lit(window)),
                         {"throughput_eps": 1})


def throughput(df: DataFrame, seconds: float, warmup_s: float, by: Sequence[str] = ("engine",)) -> DataFrame:
    """Per group: kept and seen records, and kept records per second of the window.

    ``df`` carries the boolean ``kept`` of ``tag_phase``.
    """
    counts = df.groupBy(*by).agg(F.count_if(F.col("kept")).alias("kept_records"), F.count("*").alias("seen_records"))
    return _with_throughput(counts, seconds, warmup_s)


def run_summary(df: DataFrame, seconds: float, warmup_s: float, topic: str = OUTPUT_TOPIC, by: str = "engine",
                start: float | None = None, runs: Sequence[str] | None = None) -> DataFrame:
    """One nested summary row per run, from records with latencies.

    A run that received nothing is reported only if named in ``runs``. Reads four columns
    of ``df`` three times: for the start of each run (not with ``start``), for its counts and the buckets of
    its latencies, and for the rows of the buckets that hold the figures; again only where such a
    bucket has more than ``quantiles.RANKED_ROW_LIMIT`` rows. Give it a written table (see
    ``latency_sink``) rather than undecoded records when there are many.
    """
    records = stable(df.select(by, "recv_ts", *LATENCIES), "run-records")
    tagged = tag_phase(records, warmup_s, seconds, start, [by])
    values = unpivot_latencies(tagged, [by, "kept"])
    buckets = bucket_counts(values, "ms", [by, "metric"], "kept")
    # each record has one value of either latency: its run's records are those of one of them
    seen = buckets.filter(F.col("__k1.metric") == LATENCIES[0]).groupBy(F.col(f"__k0.{by}").alias(by)).agg(
        F.sum("kept_n").alias("kept_records"), F.sum("n").alias("seen_records"))
    counts = _with_throughput(seen, seconds, warmup_s)
    figures = latency_percentiles(values.filter("kept"), "ms", [by, "metric"], buckets=buckets)
    stats = F.struct("count", *[name for name, _ in QUANTILES], "max", "mean")
    # One row per run on every side from here on; a null run is a run like the others.
    nested = figures.groupBy(F.col(by).alias("__run")).agg(
        *[F.any_value(F.when(F.col("metric") == c, stats), True).alias(c) for c in LATENCIES])
    if runs is not None:
        listed = df.sparkSession.createDataFrame([(r,) for r in dict.fromkeys(runs)], f"{by} string")
        counts = counts.withColumnRenamed(by, "__counted")
        counts = listed.join(counts, F.col(by).eqNullSafe(F.col("__counted")), "left").drop("__counted")
    empty = F.struct(F.lit(0).cast("bigint").alias("count"),
                     *[F.lit(None).cast("double").alias(c) for c in [n for n, _ in QUANTILES] + ["max", "mean"]])
    zero = F.lit(0).cast("bigint")
    return counts.join(nested, F.col(by).eqNullSafe(F.col("__run")), "left").select(
        F.col(by).alias("engine"),
        F.lit(topic).alias("topic"),
        F.coalesce("kept_records", zero).alias("kept_records"),
        F.coalesce("seen_records", zero).alias("seen_records"),
        F.lit(int(seconds - warmup_s)).alias("window_seconds"),
        F.lit(int(warmup_s)).alias("warmup_seconds"),
        F.coalesce("throughput_eps", F.lit(0.0)).alias("throughput_eps"),
        *[F.coalesce(c, empty).alias(c) for c in LATENCIES],
    )


def empty_run_flag(summary: DataFrame) -> DataFrame:
    """Add ``empty_run``: the run kept no record and its figures are null."""
    return summary.withColumn("empty_run", F.col("kept_records") == 0)


def flatten_summary(summary: DataFrame) -> DataFrame:
    """Summary with one column per figure, such as ``pipeline_p99``."""
    fields = ["count", *[name for name, _ in QUANTILES], "max", "mean"]
    nested = [F.col(f"{c}_ms.{f}").alias(f"{c}_{f}") for c in ("pipeline", "e2e") for f in fields]
    return summary.select(*[c for c in summary.columns if c not in LATENCIES], *nested)
