"""Real-time trigger for Python writers.

``DataStreamWriter.trigger`` has no real-time argument in this Spark version, so the JVM
trigger is attached to the underlying writer.
"""

from __future__ import annotations

import re

from pyspark.sql.streaming import DataStreamWriter

MIN_TRIGGER_MS = 5000
_UNITS_MS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000}


def _milliseconds(duration: str) -> int:
    parts = re.fullmatch(r"\s*(\d+)\s+(millisecond|second|minute|hour)s?\s*", duration.lower())
    if not parts:
        raise ValueError(f"cannot read duration {duration!r}, write it like '5 seconds'")
    return int(parts[1]) * _UNITS_MS[parts[2]]


def check_realtime_options(checkpoint: str | None, trigger: str) -> None:
    """Reject early what Spark would reject, or silently get wrong, at start."""
    if not checkpoint:
        raise ValueError("real-time mode needs a checkpoint location")
    if _milliseconds(trigger) < MIN_TRIGGER_MS:
        raise ValueError(f"real-time trigger must be at least {MIN_TRIGGER_MS} ms, not {trigger!r}")


def set_realtime_trigger(writer: DataStreamWriter, duration: str) -> DataStreamWriter:
    """Attach the JVM's real-time trigger to a Python writer."""
    jvm = writer._spark._sc._jvm
    writer._jwrite.trigger(jvm.org.apache.spark.sql.streaming.Trigger.RealTime(duration))
    return writer
