"""Run data derived by Spark from the ``events`` table, and the same in SQL.

The table has no country, no run and no receive time, so they are derived by fixed rules.
Every artifact below has one row per event or per group of events, so it grows with the
table. The ``*_SQL`` texts are the DuckDB side of the rule next to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.cluster import scratch_path
from tidemark.contract import COUNTRIES
from tidemark.operators import generate, transform
from tidemark.operators.latency import record_latency

# --- input events --------------------------------------------------------------------

EVENTS_TABLE = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

# The table spreads its events over a month. Divided by this, their times make a run of
# three quarters of an hour, in which a rate per second means something.
PACE = 1000
# Seconds of a window that ends after the paced run.
WHOLE_RUN = 3000


def _events_sql(pace: int) -> str:
    return f"""
m AS (
  SELECT event_id, user_id,
    CASE WHEN event_type = 'signup' THEN 'add_to_cart' ELSE event_type END AS event_type,
    (['us','es','de','fr','br','in','jp','gb'])[1 + user_id % 8] AS country,
    value AS amount, epoch_us(ts) / 1000000::DOUBLE / {pace}::DOUBLE AS ts
  FROM events
)"""


EVENTS_SQL = _events_sql(1)

TAX_SQL = "round(CAST(CAST(amount * 1.21::DOUBLE AS VARCHAR) AS DECIMAL(38,18)), 2)::DOUBLE"
PASS_SQL = "event_type IN ('purchase', 'add_to_cart') AND amount > 0"
OUT_TS_SQL = "ts + CAST((event_id * 7919) % 50000 AS DOUBLE) / 1000000::DOUBLE"
RECV_TS_SQL = "ts + CAST((event_id * 7919) % 50000 + 2000 + (event_id * 31) % 9000 AS DOUBLE) / 1000000::DOUBLE"


def fixture_out_ts(ts: str = "ts", event_id: str = "event_id") -> Column:
    """Deterministic stand-in for the output stamp: 0 to 50 ms after ``ts``."""
    return F.col(ts) + F.pmod(F.col(event_id) * 7919, F.lit(50000)).cast("double") / F.lit(1000000.0)


def fixture_recv_ts(ts: str = "ts", event_id: str = "event_id") -> Column:
    """Deterministic stand-in for the receive stamp: 2 to 11 ms after the output stamp."""
    micros = F.pmod(F.col(event_id) * 7919, F.lit(50000)) + 2000 + F.pmod(F.col(event_id) * 31, F.lit(9000))
    return F.col(ts) + micros.cast("double") / F.lit(1000000.0)


def fixed(expression: str, digits: int) -> str:
    """DuckDB text that rounds the binary value of a double, exact ties to even."""
    return f"CAST(printf('%.{digits}f', {expression}) AS DOUBLE)"


def events(spark: SparkSession, sf_dir: str, pace: int = 1) -> DataFrame:
    """The table in the shape of the input contract."""
    table = spark.read.schema(EVENTS_TABLE).parquet(f"{sf_dir}/events.parquet")
    country = F.element_at(F.array(*[F.lit(c) for c in COUNTRIES]), (F.col("user_id") % 8 + 1).cast("int"))
    return table.select(
        "event_id", "user_id",
        F.when(F.col("event_type") == "signup", "add_to_cart").otherwise(F.col("event_type")).alias("event_type"),
        country.alias("country"),
        F.col("value").alias("amount"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0) / F.lit(float(pace))).alias("ts"),
    )


def raw_records(spark: SparkSession, sf_dir: str, pace: int = 1) -> DataFrame:
    """Every event as a (key, value) record, as it would arrive from a topic."""
    return generate.events_to_kafka_records(events(spark, sf_dir, pace))


# Variants of a record by event_id % 10; the rest of the digits stay intact.
def messy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which most are damaged in one of the ways a decoder must handle."""
    e = events(spark, sf_dir)
    names = ("event_id", "user_id", "event_type", "country", "amount", "ts")

    def text(**changed: Column | None) -> Column:
        fields = [changed.get(n, F.col(n)) for n in names]
        kept = [f.alias(n) for f, n in zip(fields, names) if f is not None]
        return F.to_json(F.struct(*kept), {"ignoreNullFields": "false"})

    null = F.lit(None)
    kind = F.col("event_id") % 10
    value = (
        F.when(kind == 0, F.concat(F.lit("not json "), F.col("event_id").cast("string")))
        .when(kind == 1, text(amount=F.col("amount").cast("string")))
        .when(kind == 2, text(event_id=F.col("event_id").cast("double")))
        .when(kind == 3, text(country=None))
        .when(kind == 4, text(user_id=null.cast("bigint")))
        .when(kind == 5, F.concat(text(), F.lit(" trailing")))
        .when(kind == 6, text(event_type=F.initcap("event_type")))
        .when(kind == 7, text(amount=null.cast("double")))
        .when(kind == 8, F.lit(""))
        .otherwise(text())
    )
    return e.select(value.alias("value"))


# --- output records ------------------------------------------------------------------

_RECORDS_SQL = f""",
lat AS (
  SELECT CASE WHEN event_id % 2 = 0 THEN 'run_a' ELSE 'run_b' END AS engine,
    event_id, user_id, ts, {OUT_TS_SQL} AS out_ts, {RECV_TS_SQL} AS recv_ts
  FROM m WHERE {PASS_SQL}
),
rec AS (
  SELECT *, (out_ts - ts) * 1000::DOUBLE AS pipeline_ms, (recv_ts - ts) * 1000::DOUBLE AS e2e_ms FROM lat
)"""

LATENCY_SQL = EVENTS_SQL + _RECORDS_SQL
RUN_SQL = _events_sql(PACE) + _RECORDS_SQL

DUPLICATED_SQL = LATENCY_SQL + """,
dup AS (
  SELECT * FROM rec
  UNION ALL
  SELECT engine, event_id, user_id, ts, out_ts, recv_ts + 1::DOUBLE, pipeline_ms, e2e_ms
  FROM rec WHERE event_id % 97 = 0
)"""


def two_runs(event_id: str = "event_id") -> Column:
    return F.when(F.col(event_id) % 2 == 0, "run_a").otherwise("run_b")


def latency_source(spark: SparkSession, sf_dir: str, pace: int = 1) -> DataFrame:
    """Transformed events with deterministic stamps and a run: no latencies yet."""
    kept = transform.filter_purchase_intent(events(spark, sf_dir, pace))
    return kept.select(two_runs().alias("engine"), "event_id", "user_id", "ts",
                       fixture_out_ts().alias("out_ts"), fixture_recv_ts().alias("recv_ts"))


def latency_records(spark: SparkSession, sf_dir: str, pace: int = 1) -> DataFrame:
    return record_latency(latency_source(spark, sf_dir, pace))


def duplicated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency records of which some arrive again one second later."""
    records = latency_records(spark, sf_dir)
    again = records.filter(F.col("event_id") % 97 == 0).withColumn("recv_ts", F.col("recv_ts") + F.lit(1.0))
    return records.unionByName(again)


def output_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded output events with their receive time; a few in 50 have a bad stamp or text behind them."""
    kept = transform.filter_purchase_intent(events(spark, sf_dir))
    encoded = transform.enrich(kept, fixture_out_ts()).select("event_id", "ts", "out_ts")
    good = F.to_json(F.struct("event_id", "ts", "out_ts"))
    as_text = F.to_json(F.struct("event_id", F.col("ts").cast("string").alias("ts"), "out_ts"))
    bad = F.to_json(F.struct("event_id", F.lit("soon").alias("ts"), "out_ts"))
    typed = F.to_json(F.struct("event_id", F.concat(F.col("ts").cast("string"), F.lit("d")).alias("ts"), "out_ts"))
    kind = F.col("event_id") % 50
    value = (F.when(kind == 0, bad).when(kind == 1, as_text).when(kind == 2, F.lit("{}")).when(kind == 3, typed)
             .when(kind == 4, F.concat(good, F.lit(" more"))).otherwise(good))
    return encoded.select(two_runs().alias("engine"), fixture_recv_ts().alias("recv_ts"), value.alias("value"))


# --- labelled runs for the comparison tables -----------------------------------------

LABELS = ("alpha-p6", "alpha-p12eq", "beta-p6", "beta-p12eq")
LABELS_SQL = "(['alpha-p6','alpha-p12eq','beta-p6','beta-p12eq'])[1 + event_id % 4]"


def four_labels(column: str = "event_id") -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in LABELS]), (F.col(column) % 4 + 1).cast("int"))


def labelled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency_records(spark, sf_dir, PACE).withColumn("engine", four_labels())


def summary_sql(source: str, engine: str, seconds: int, warmup: int, name: str = "summary") -> str:
    """CTE with one flat summary row per run of ``source`` (columns as ``rec``)."""
    figures = []
    for side in ("pipeline", "e2e"):
        x = f"CASE WHEN kept THEN {side}_ms END"
        figures.append(f"count({x}) AS {side}_count")
        figures += [f"{fixed(f'quantile_cont({x}, {q})', 3)} AS {side}_{n}"
                    for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
        figures += [f"{fixed(f'max({x})', 3)} AS {side}_max", f"{fixed(f'avg({x})', 3)} AS {side}_mean"]
    return f"""
begun AS (
  SELECT *, {engine} AS run, recv_ts - min(recv_ts) OVER (PARTITION BY {engine}) AS since FROM {source}
),
tagged AS (SELECT *, since >= {warmup} AS kept FROM begun WHERE since < {seconds}),
{name} AS (
  SELECT run AS engine, 'output-events' AS topic,
    count(CASE WHEN kept THEN 1 END) AS kept_records, count(*) AS seen_records,
    CAST({seconds - warmup} AS INTEGER) AS window_seconds, CAST({warmup} AS INTEGER) AS warmup_seconds,
    {fixed(f"count(CASE WHEN kept THEN 1 END) / {seconds - warmup}::DOUBLE", 1)} AS throughput_eps,
    {", ".join(figures)}
  FROM tagged GROUP BY run
)"""


# --- resource samples ----------------------------------------------------------------

STATS_SQL = EVENTS_SQL + """,
stats AS (
  SELECT (['alpha-p6','alpha-p12eq','beta-p6','gamma'])[1 + event_id % 4] AS engine,
    (['worker-1','worker-2','coordinator','kafka-0'])[1 + user_id % 4] AS container,
    CAST(floor(ts) AS BIGINT) AS epoch, amount AS cpu_pct,
    (5000 + (event_id * 37) % 30000) / 10::DOUBLE AS mem_used_mb,
    ((event_id * 13) % 1000) / 10::DOUBLE AS mem_pct
  FROM m WHERE event_id % 50 <> 0
)"""


def _choice(values, index: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(index) % len(values) + 1).cast("int"))


def container_stats_files(spark: SparkSession, sf_dir: str) -> str:
    """Write container samples as CSV, one folder per engine; one row in 50 is bad."""
    e = events(spark, sf_dir)
    engine = _choice(("alpha-p6", "alpha-p12eq", "beta-p6", "gamma"), "event_id")
    rows = e.select(
        F.floor("ts").alias("epoch"),
        _choice(("worker-1", "worker-2", "coordinator", "kafka-0"), "user_id").alias("container"),
        F.when(F.col("event_id") % 50 == 0, "n/a").otherwise(F.col("amount").cast("string")).alias("cpu_pct"),
        ((5000 + (F.col("event_id") * 37) % 30000) / F.lit(10.0)).alias("mem_used_mb"),
        (((F.col("event_id") * 13) % 1000) / F.lit(10.0)).alias("mem_pct"),
        F.concat(engine, F.lit("_stats.csv")).alias("file"),
    )
    path = scratch_path(spark, "stats")
    rows.write.partitionBy("file").option("header", True).csv(path)
    return f"{path}/*_stats.csv"


USAGE_SQL = EVENTS_SQL + f""",
usage AS (
  SELECT event_id, amount AS cpu_pct, (event_id * 37) % 900 + 1 AS n, event_id % 4 AS unit FROM m
)"""


def raw_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampler output before normalising, in every unit it prints."""
    n = F.col("event_id") * 37 % 900 + 1
    unit = F.col("event_id") % 4
    mem = (
        F.when(unit == 0, F.concat(n.cast("string"), F.lit(".5GiB / 8GiB")))
        .when(unit == 1, F.concat(n.cast("string"), F.lit(".25MiB / 2GiB")))
        .when(unit == 2, F.concat(n.cast("string"), F.lit("KiB / 1GiB")))
        .otherwise(n.cast("string"))
    )
    cpu = F.concat(F.col("amount").cast("string"), F.lit("%"))
    return events(spark, sf_dir).select("event_id", cpu.alias("cpu"), mem.alias("mem"))


RUN_LABELS = ("alpha-p6", "alpha-p12eq", "beta-p6")
_RUN_LABEL_SQL = "(['alpha-p6','alpha-p12eq','beta-p6'])[1 + user_id % 3]"

PODS_SQL = EVENTS_SQL + f""",
pods AS (
  SELECT {_RUN_LABEL_SQL} AS label, CAST(floor(ts / 3600) AS BIGINT) * 3600 AS ts,
    (['spark','flink','kafka','spark','flink'])[1 + event_id % 5] AS ns,
    (['rtm-bench-driver','rtm-pyspark-measured-exec-','flink-bench-taskmanager-','operator-'])[1 + (event_id * 3) % 4]
      || CAST(user_id % 7 AS VARCHAR) AS pod,
    (event_id * 7) % 4000 AS millicores,
    CASE WHEN event_id % 9 = 0 THEN ((event_id * 11) % 8) * 1024::DOUBLE ELSE ((event_id * 11) % 8000)::DOUBLE END AS mem_mib
  FROM m WHERE event_id % 40 > 1
)"""


def pod_sample_files(spark: SparkSession, sf_dir: str) -> str:
    """Write pod samples as text, one folder per label; some lines are short or not numeric."""
    pod = F.concat(_choice_by((F.col("event_id") * 3) % 4, (
        "rtm-bench-driver", "rtm-pyspark-measured-exec-", "flink-bench-taskmanager-", "operator-")),
        (F.col("user_id") % 7).cast("string"))
    mem = F.when(F.col("event_id") % 9 == 0, F.concat((F.col("event_id") * 11 % 8).cast("string"), F.lit("Gi")))
    mem = mem.otherwise(F.concat((F.col("event_id") * 11 % 8000).cast("string"), F.lit("Mi")))
    cores = F.concat(F.when(F.col("event_id") % 40 == 1, "x").otherwise(""),
                     (F.col("event_id") * 7 % 4000).cast("string"), F.lit("m"))
    head = [(F.floor(F.col("ts") / 3600) * 3600).cast("string"),
            _choice(("spark", "flink", "kafka", "spark", "flink"), "event_id"), pod]
    line = F.when(F.col("event_id") % 40 == 0, F.concat_ws(" ", *head)).otherwise(
        F.concat_ws("   ", *head, cores, mem, F.lit("")))
    file = F.concat(_choice(RUN_LABELS, "user_id"), F.lit("_top.txt"))
    path = scratch_path(spark, "pods")
    events(spark, sf_dir).select(line.alias("value"), file.alias("file")).write.partitionBy("file").text(path)
    return f"{path}/*_top.txt"


def _choice_by(index: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


OFFSETS_SQL = EVENTS_SQL + f""",
offsets AS (
  SELECT {_RUN_LABEL_SQL} AS label, CAST(floor(ts) AS BIGINT) AS ts, event_id * 100 AS in_end,
    event_id * 33 + (event_id * 5) % 1700 AS out_end
  FROM m WHERE event_id % 60 > 1
)"""


def offset_sample_files(spark: SparkSession, sf_dir: str) -> str:
    """Write topic end offsets as text, one folder per label; some lines are not three integers."""
    i = F.col("event_id")
    parts = [F.floor("ts").cast("string"), (i * 100).cast("string"), (i * 33 + i * 5 % 1700).cast("string")]
    line = F.when(i % 60 == 0, F.concat_ws(" ", *parts, F.lit("9"))).when(i % 60 == 1, F.lit("ts in out"))
    line = line.otherwise(F.concat_ws(" ", *parts))
    file = F.concat(_choice(RUN_LABELS, "user_id"), F.lit("_lag.txt"))
    path = scratch_path(spark, "offsets")
    events(spark, sf_dir).select(line.alias("value"), file.alias("file")).write.partitionBy("file").text(path)
    return f"{path}/*_lag.txt"


# --- summaries and logs as files -----------------------------------------------------


def consumer_log_files(spark: SparkSession, summaries: DataFrame) -> str:
    """Write one consumer log per run, its summary printed between other lines."""
    body = F.to_json(F.struct(*[c for c in summaries.columns]), {"pretty": "true", "ignoreNullFields": "false"})
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("measuring run "), F.col("engine"), F.lit(" on "), F.col("topic")),
        F.concat(F.col("seen_records").cast("string"), F.lit(" records so far")),
        F.lit(""), F.lit("figures of the run"), body, F.lit("end of log"),
    )
    path = scratch_path(spark, "logs")
    file = F.concat(F.col("engine"), F.lit("_consumer.log"))
    summaries.select(text.alias("value"), file.alias("file")).write.partitionBy("file").text(path)
    return f"{path}/*_consumer.log"


def long_log_files(spark: SparkSession, summaries: DataFrame, records: DataFrame) -> str:
    """Write one consumer log per run with a line per record, before and after its summary."""
    body = F.to_json(F.struct(*summaries.columns), {"pretty": "true", "ignoreNullFields": "false"})
    printed = summaries.select("engine", F.lit(1).alias("part"), F.lit(0.0).alias("at"), body.alias("value"))
    line = F.concat(F.lit("record "), F.col("event_id").cast("string"), F.lit(" after "), F.col("e2e_ms").cast("string"), F.lit(" ms"))
    lines = records.select("engine", F.when(F.col("event_id") % 4 == 0, 2).otherwise(0).alias("part"), F.col("recv_ts").alias("at"), line.alias("value"))
    path = scratch_path(spark, "long-logs")
    file = F.concat("engine", F.lit("_consumer.log"))
    # a log is one file, so its run is written by one task
    logs = lines.unionByName(printed).withColumn("file", file).repartition("file").sortWithinPartitions("file", "part", "at")
    logs.select("value", "file").write.partitionBy("file").text(path)
    return f"{path}/*_consumer.log"
