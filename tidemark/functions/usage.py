"""Resource figures printed as text by samplers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.rounding import round_nearest


def percent(text: Column) -> Column:
    """``12.3%`` to 12.3."""
    return F.regexp_replace(text, "%", "").try_cast("double")


def used_number(text: Column) -> Column:
    """The number of the used part of ``123.4MiB / 2GiB``."""
    return F.regexp_replace(F.split(text, " /")[0], "[^0-9.]", "").try_cast("double")


def used_mb(text: Column, number: str) -> Column:
    """The used part in MB; ``number`` names the column of its number. No unit is taken as MB."""
    used = F.split(text, " /")[0]
    return (
        F.when(used.contains("GiB"), round_nearest(f"{number} * 1024", 1))
        .when(used.contains("MiB"), F.col(number))
        .when(used.contains("KiB"), round_nearest(f"{number} / 1024", 3))
        .otherwise(F.col(number))
    )


def millicores(text: Column) -> Column:
    """``250m`` to 250; null if the rest is not an integer."""
    return F.regexp_replace(text, "m+$", "").try_cast("bigint")


def pod_memory_mib(text: Column) -> Column:
    """``1000Mi`` to 1000, with the other binary units converted; null without digits."""
    digits = F.regexp_replace(text, "[^0-9]", "").try_cast("double")
    return (
        F.when(text.endswith("Ti"), digits * 1048576)
        .when(text.endswith("Gi"), digits * 1024)
        .when(text.endswith("Ki"), digits / 1024)
        .otherwise(digits)
    )
