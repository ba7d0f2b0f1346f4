"""Stall, duplicates and totals of a fault run."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import recovery as A


def df_of(spark, rows):
    return spark.createDataFrame(rows, "engine string, event_id string, recv_ts double")


def times(spark, **runs):
    return df_of(spark, [(e, str(i), t) for e, ts in runs.items() for i, t in enumerate(ts)])


def widest(ts):
    ts = sorted(ts)
    return max((b - a for a, b in zip(ts, ts[1:])), default=0.0) * 1000.0


@pytest.mark.parametrize("buckets", [1, 2, 7, 64, 65_536])
def test_gap_agrees_with_ordering(spark, buckets):
    rng = random.Random(buckets)
    base = 1.75e9
    stalled = [base + i * 0.02 for i in range(1000)] + [base + 38.2 + i * 0.02 for i in range(1000)]
    runs = {
        "stall": stalled,
        "steady": [base + i * 0.01 for i in range(2000)],
        "random": [base + rng.uniform(0, 60) for _ in range(2000)],
        "burst": [base + rng.random() * 1e-3 for _ in range(2000)] + [base + 100],
        "clustered": [base + c * 10 + rng.expovariate(100) for c in range(20) for _ in range(50)],
        "same": [base] * 50,
        "one": [base],
        "two": [base, base + 3],
    }
    for ts in runs.values():
        rng.shuffle(ts)
    df = times(spark, **runs).repartition(4)
    got = {r.engine: r.gap_ms for r in A.recovery_gap(df, buckets=buckets).collect()}
    assert got == {e: widest(ts) for e, ts in runs.items()}


def test_gap_next_to_times_that_are_not_finite(spark):
    inf, nan = float("inf"), float("nan")
    runs = {"far": [1.0, 2.0, 30.0, inf], "all": [inf, inf], "both": [-inf, inf], "nan": [1.0, nan, 4.0], "plain": [1.0, 2.0]}
    got = {r.engine: r.gap_ms for r in A.recovery_gap(times(spark, **runs)).collect()}
    assert got == {"far": inf, "all": 0.0, "both": inf, "nan": 3000.0, "plain": 1000.0}


def test_report_of_a_fault_run(spark):
    rows = [("a", "1", 1.0), ("a", "1", 2.0), ("a", "2", 7.0), (None, "1", 1.0)]
    got = {r.engine: tuple(r)[1:] for r in A.recovery_report(df_of(spark, rows)).collect()}
    assert got == {"a": (3, 2, 1, 1, 33.333, 6.0, 5000.0), None: (1, 1, 0, 0, 0.0, 0.0, 0.0)}


def test_gap_below_two_rows_is_zero(spark):
    got = A.recovery_gap(df_of(spark, [("a", "1", 5.0), ("a", "2", None)])).collect()
    assert [(r.engine, r.gap_ms) for r in got] == [("a", 0.0)]
    assert A.recovery_gap(df_of(spark, [])).collect() == []


def test_gap_without_groups_and_with_a_null_group(spark):
    df = df_of(spark, [(None, "1", 1.0), (None, "2", 4.0), ("a", "3", 2.0)])
    assert A.recovery_gap(df, by=[]).first().gap_ms == 2000.0
    assert {(r.engine, r.gap_ms) for r in A.recovery_gap(df).collect()} == {(None, 3000.0), ("a", 0.0)}


def test_gap_does_not_order_rows(spark, plan):
    """Window functions see buckets, never the records."""
    df = times(spark, a=[float(i) for i in range(50)])
    text = plan(A.recovery_gap(df))
    assert "Window" not in text or "HashAggregate" in text.split("Window")[1]


def test_duplicates(spark):
    rows = [("a", "1", 1.0), ("a", "1", 2.0), ("a", "1", 3.0), ("a", "2", 4.0), ("a", "3", 5.0), ("a", "3", 6.0),
            ("b", "1", 1.0), ("b", "2", None)]
    got = {r.engine: r for r in A.duplicate_records(df_of(spark, rows)).collect()}
    assert tuple(got["a"])[1:] == (6, 3, 2, 50.0)
    assert tuple(got["b"])[1:] == (1, 0, 0, 0.0)
    totals = {r.engine: tuple(r)[1:] for r in A.distinct_vs_total(df_of(spark, rows)).collect()}
    assert totals == {"a": (6, 3, 5.0), "b": (1, 1, 0.0)}


def test_hot_id_is_counted_before_the_shuffle(spark, plan):
    """One id holds most rows; each task sends one partial count of it."""
    df = spark.range(10_000).select(F.lit("a").alias("engine"), F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("event_id"),
                                    F.col("id").cast("double").alias("recv_ts"))
    row = A.duplicate_records(df).first()
    assert row.total_records == 10_000 and row.duplicated_ids == 1
    text = plan(A.duplicate_records(df))
    assert text.count("partial_count(1)") >= 1


def test_several_producers(spark):
    rows = [("a", p, i, p * 1000 + i, 1.0 * i) for p in range(3) for i in range(10)]
    rows += [("a", 0, 5, 5, 5.0)]
    df = spark.createDataFrame(rows, "engine string, producer int, event_id long, user_id long, ts double").withColumn(
        "recv_ts", F.col("ts") + 1)
    assert A.duplicate_records(df).first().duplicate_records == 21
    assert A.duplicates_by_producer(df).first().duplicate_records == 1
    assert A.duplicates_by_producer(df.drop("producer")).first().duplicate_records == 1
