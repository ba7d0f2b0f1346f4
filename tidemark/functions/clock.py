"""Per-row clocks.

``current_timestamp()`` is fixed for a whole batch, and for a whole trigger in
real-time mode, so it cannot measure a record's latency. ``wall_clock`` calls the JVM
clock for each row, without Python workers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wall_clock() -> Column:
    """Epoch seconds as double with millisecond resolution, evaluated per row."""
    return F.reflect(F.lit("java.lang.System"), F.lit("currentTimeMillis")).cast("double") / F.lit(1000.0)
