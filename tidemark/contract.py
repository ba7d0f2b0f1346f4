"""Record schemas and fixed values of the event contract.

Schemas are declared, never inferred. All times are epoch seconds as double.
"""

from __future__ import annotations

from pyspark.sql import types as T

# They must equal the published contract for results to agree.
PURCHASE_INTENT = ("purchase", "add_to_cart")
EVENT_TYPES = ("click", "view", "purchase", "add_to_cart", "logout", "login")
COUNTRIES = ("us", "es", "de", "fr", "br", "in", "jp", "gb")
USER_COUNT = 100_000
AMOUNT_MAX = 500.0
TAX_FACTOR = 1.21
FILTER_PASS = 0.333
VCPU_HOUR_USD = 0.048
MIN_VCPU = 0.1
SHARED_CONTAINERS = ("kafka",)
POD_NAMESPACES = ("spark", "flink")
POD_PATTERNS = ("rtm-bench", "flink-bench")
POD_PATTERNS_FULL = ("rtm-bench", "flink-bench", "rtm-pyspark-measured")
RUN_CONFIGS = ("p6", "p12eq", "chaos")
QUANTILES = (("p50", 0.50), ("p95", 0.95), ("p99", 0.99))
MICROBATCH_INTAKE = 200_000
INPUT_TOPIC = "input-events"
OUTPUT_TOPIC = "output-events"

INPUT_EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("ts", T.DoubleType()),
    ]
)

OUTPUT_EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("amount_with_tax", T.DoubleType()),
        T.StructField("ts", T.DoubleType()),
        T.StructField("out_ts", T.DoubleType()),
    ]
)

LATENCY_STATS = T.StructType(
    [
        T.StructField("count", T.LongType()),
        T.StructField("p50", T.DoubleType()),
        T.StructField("p95", T.DoubleType()),
        T.StructField("p99", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("mean", T.DoubleType()),
    ]
)

RUN_SUMMARY = T.StructType(
    [
        T.StructField("engine", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("kept_records", T.LongType()),
        T.StructField("seen_records", T.LongType()),
        T.StructField("window_seconds", T.IntegerType()),
        T.StructField("warmup_seconds", T.IntegerType()),
        T.StructField("throughput_eps", T.DoubleType()),
        T.StructField("pipeline_ms", LATENCY_STATS),
        T.StructField("e2e_ms", LATENCY_STATS),
    ]
)

# Numbers are read as text so that one bad cell drops its row, not the file.
CONTAINER_STATS_TEXT = T.StructType(
    [
        T.StructField("epoch", T.StringType()),
        T.StructField("container", T.StringType()),
        T.StructField("cpu_pct", T.StringType()),
        T.StructField("mem_used_mb", T.StringType()),
        T.StructField("mem_pct", T.StringType()),
    ]
)

LATENCY_RECORD_COLUMNS = ("recv_ts", "event_id", "ts", "out_ts", "pipeline_ms", "e2e_ms")
