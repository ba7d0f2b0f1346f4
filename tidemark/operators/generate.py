"""Synthetic events as a Spark job.

Every value is integer arithmetic on the event's counter and the seed, so the rows do not depend on
how the job is partitioned, a retried task produces the same ones, and any engine with 64-bit integers
computes them: ``draw_sql`` is the same text for Spark and for other SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.contract import AMOUNT_MAX, COUNTRIES, EVENT_TYPES, USER_COUNT
from tidemark.functions import records as R
from tidemark.operators.transform import pad_payload


# A prime below 2**31: products of two remainders fit 64 bits. Its predecessor is not divisible by 5,
# so the fifth power is a permutation of the remainders.
PRIME = 2_147_483_647
STEP = 48_271
ROUND_STEP = 40_692
SEED_STEP = 69_621
STREAM_STEP = 1_103_515_245


def draw_sql(seq: str, seed: int, stream: int, size: int, div: str = "div") -> str:
    """SQL text: an integer in [0, size) for the counter ``seq`` >= 0; ``div`` is the engine's integer division.

    The counter moves along the remainders of a prime in equal steps, the fifth power scatters them, and the
    result is scaled to the size. Streams and seeds begin elsewhere. After ``PRIME`` counters the steps begin
    anew with another start. Sizes up to 2**32 are admitted.
    """
    if not 0 < size <= 1 << 32:
        raise ValueError("size must be 1 to 2**32")
    start = (seed * SEED_STEP + stream * STREAM_STEP) % PRIME
    x = f"(({seq} % {PRIME} * {STEP} + ({seq} {div} {PRIME}) % {PRIME} * {ROUND_STEP} + {start}) % {PRIME})"
    square = f"({x} * {x} % {PRIME})"
    fifth = f"({square} * {square} % {PRIME} * {x} % {PRIME})"
    return f"({fifth} * {size} {div} {PRIME})"


def _draw(seed: int, stream: int, size: int) -> Column:
    return F.expr(draw_sql("__seq", seed, stream, size))


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def paced_ts(seq: Column, rate: float = 10_000.0, start_ts: float = 1_750_000_000.0) -> Column:
    """Time of the ``seq``-th event of a steady load of ``rate`` events per second."""
    return F.lit(float(start_ts)) + seq.cast("double") / F.lit(float(rate))


def events_from_ids(ids: DataFrame, column: str = "id", seed: int = 42, producers: int = 1,
                    payload_bytes: int = 0, ts: Column | None = None) -> DataFrame:
    """One event per sequence number of ``ids``, stamped with ``ts``.

    With several producers each counts its own event ids from 1, as separate load pods
    do; ``producer`` tells them apart.
    """
    if producers < 1:
        raise ValueError("producers must be at least 1")
    stamp = paced_ts(F.col(column)) if ts is None else ts
    seq = ids.select(F.col(column).cast("bigint").alias("__seq"), stamp.alias("ts"))
    cents = int(AMOUNT_MAX * 100) + 1
    events = seq.select(
        (F.expr(f"__seq div {int(producers)}") + 1).alias("event_id"),
        (_draw(seed, 1, USER_COUNT) + 1).alias("user_id"),
        _pick(EVENT_TYPES, _draw(seed, 2, len(EVENT_TYPES))).alias("event_type"),
        _pick(COUNTRIES, _draw(seed, 3, len(COUNTRIES))).alias("country"),
        (_draw(seed, 4, cents).cast("double") / F.lit(100.0)).alias("amount"),
        "ts",
        F.pmod(F.col("__seq"), F.lit(producers)).cast("int").alias("producer"),
    )
    return pad_payload(events, payload_bytes)


def synthetic_events(spark: SparkSession, n: int, seed: int = 42, producers: int = 1, payload_bytes: int = 0,
                     rate: float = 10_000.0, start_ts: float = 1_750_000_000.0,
                     partitions: int | None = None) -> DataFrame:
    """``n`` events; ``partitions`` only sets the parallelism."""
    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return events_from_ids(ids, "id", seed, producers, payload_bytes, paced_ts(F.col("id"), rate, start_ts))


def synthetic_event_stream(spark: SparkSession, rows_per_second: int = 10_000, seed: int = 42, producers: int = 1,
                           payload_bytes: int = 0) -> DataFrame:
    """The same events from the ``rate`` source, ``ts`` being the time of emission."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    emitted = F.unix_micros("timestamp").cast("double") / F.lit(1000000.0)
    return events_from_ids(ticks, "value", seed, producers, payload_bytes, emitted)


def events_to_kafka_records(events: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Events to (key, value): user id as text, event as compact JSON; columns of ``carry`` stay beside them."""
    fields = ["event_id", "user_id", "event_type", "country", "amount", "ts"]
    fields += [c for c in ("pad", "producer") if c in events.columns]
    return events.select(R.user_key("user_id").alias("key"), R.encode(fields).alias("value"), *carry)
