"""Report rounding agrees with correctly rounded decimals of the binary value."""

import random

from pyspark.sql import functions as F

from tidemark.functions.records import amount_with_tax, amount_with_tax_scaled_round
from tidemark.functions.rounding import round_nearest


def test_round_nearest_is_correct_for_ties_and_near_ties(spark):
    rng = random.Random(7)
    values = [k / 1000 for k in range(0, 3000, 5)] + [0.5, 1.5, 2.5, -2.5, -0.385, 1e15 + 0.5, 2.0**53, -(2.0**60), 1e300]
    values += [rng.uniform(-1e6, 1e6) for _ in range(2000)] + [k / 8 for k in range(-40, 40)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 3, 6):
        got = df.select("v", round_nearest("v", digits).alias("r")).collect()
        wrong = [(r.v, r.r, round(r.v, digits)) for r in got if r.r != round(r.v, digits)]
        assert not wrong, wrong[:5]


def test_round_nearest_keeps_null_nan_and_infinity(spark):
    rows = spark.sql("SELECT * FROM VALUES (CAST(NULL AS DOUBLE)), (double('NaN')), (double('Infinity')) t(v)")
    got = [r.r for r in rows.select(round_nearest("v", 2).alias("r")).collect()]
    assert got[0] is None and got[1] != got[1] and got[2] == float("inf")


def test_tax_dialects(spark):
    df = spark.createDataFrame([(7.5,), (18.5,), (22.5,), (33.5,)], "amount double").select(
        amount_with_tax(F.col("amount")).alias("a"), amount_with_tax_scaled_round(F.col("amount")).alias("b"))
    rows = df.collect()
    assert [r.a for r in rows] == [9.08, 22.38, 27.22, 40.54]
    assert [r.b for r in rows][:3] == [9.07, 22.39, 27.23]


def test_tax_dialects_differ_on_83_of_all_cent_amounts(spark):
    cents = spark.range(50_001).select((F.col("id") / F.lit(100.0)).alias("amount"))
    differ = cents.filter(amount_with_tax(F.col("amount")) != amount_with_tax_scaled_round(F.col("amount")))
    assert differ.count() == 83
