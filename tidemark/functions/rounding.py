"""Rounding of report figures."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round_nearest(value: str, digits: int) -> Column:
    """Round the *binary* value of a double to ``digits`` places, exact ties to even.

    ``value`` is a column name or SQL expression of type double. ``round`` and ``bround``
    work on the shortest decimal text, where 0.385 is a tie; as a double it lies above
    0.385 and rounds to 0.39. So where the scaled value seems to be a tie, the rounding
    error of the scaling decides; it is recovered by splitting the value into two halves
    of at most 26 bits (the factor 2**27 + 1), whose products are exact.
    """
    if not 0 <= digits <= 7:
        raise ValueError("digits must be 0..7")
    x, scale = f"({value})", f"{10**digits}D"
    product = f"({x} * {scale})"
    high = f"({x} * 134217729D - ({x} * 134217729D - {x}))"
    error = f"(({high} * {scale} - {product}) + ({x} - {high}) * {scale})"
    whole = f"rint{product}"
    # From 2**52 on a double has no fraction left.
    return F.expr(f"""
        CASE WHEN NOT abs({product}) < 4503599627370496D THEN {x}
             WHEN {product} - {whole} = 0.5D AND {error} > 0D THEN ({whole} + 1D) / {scale}
             WHEN {product} - {whole} = -0.5D AND {error} < 0D THEN ({whole} - 1D) / {scale}
             ELSE {whole} / {scale} END""")


def round_columns(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    """Round the named columns in place, each to its number of digits."""
    return df.withColumns({name: round_nearest(f"`{name}`", places) for name, places in digits.items()})
