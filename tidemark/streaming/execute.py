"""Run a transformed stream: micro-batch or real-time, into a checkpointed sink."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidemark.streaming.realtime import check_realtime_options, set_realtime_trigger


@dataclass(frozen=True)
class Sink:
    """Format and options of a stream's sink, and the columns by which files are laid out."""

    format: str
    options: Mapping[str, str] = field(default_factory=dict)
    partition_by: tuple[str, ...] = ()


def file_sink(path: str, fmt: str = "parquet") -> Sink:
    """Keyed records as files, in place of a topic."""
    return Sink(fmt, {"path": path})


def _writer(df: DataFrame, sink: Sink, checkpoint: str | None, mode: str, name: str | None) -> DataStreamWriter:
    writer = df.writeStream.format(sink.format).options(**sink.options).outputMode(mode)
    if sink.partition_by:
        writer = writer.partitionBy(*sink.partition_by)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.queryName(name) if name else writer


def run_microbatch(df: DataFrame, sink: Sink, checkpoint: str, available_now: bool = False,
                   name: str | None = None) -> StreamingQuery:
    """Append mode; a new batch starts when the last one ends.

    ``available_now`` processes what is there and stops. Restarting with the same
    ``checkpoint`` resumes where the last committed batch ended.
    """
    writer = _writer(df, sink, checkpoint, "append", name)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_realtime(df: DataFrame, sink: Sink, checkpoint: str, trigger: str = "5 seconds",
                 name: str | None = None) -> StreamingQuery:
    """Update mode under the real-time trigger, whose duration sets the checkpoint cadence.

    Spark admits stateless built-in operators, Kafka as the source, and Kafka, foreach or
    console as the sink; one core is held per source partition. AQE must be off.
    """
    check_realtime_options(checkpoint, trigger)
    return set_realtime_trigger(_writer(df, sink, checkpoint, "update", name), trigger).start()


def run(df: DataFrame, mode: str, sink: Sink, checkpoint: str, trigger: str = "5 seconds",
        available_now: bool = False, name: str | None = None) -> StreamingQuery:
    """Start the query in the given mode."""
    if mode == "rtm":
        return run_realtime(df, sink, checkpoint, trigger, name)
    if mode == "microbatch":
        return run_microbatch(df, sink, checkpoint, available_now, name)
    raise ValueError(f"{mode!r} is no mode: real-time is 'rtm', batches are 'microbatch'")


def batch_durations(query: StreamingQuery) -> list[dict]:
    """Rows and step durations (ms) of the recent batches, from the query's own progress."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], **dict(p["durationMs"])} for p in query.recentProgress]


def run_batches(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
                name: str | None = None) -> StreamingQuery:
    """Hand each micro-batch and its number to ``write``, which must replace what it wrote if a batch comes again."""
    writer = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.queryName(name) if name else writer).start()


def drain(query: StreamingQuery) -> list[dict]:
    """Process all that the source holds, batch by batch, stop the query, and return its recent batches.

    For sources that bound a batch by rows: under ``available_now`` Spark would fix their end after one
    bounded batch.
    """
    try:
        query.processAllAvailable()
        return batch_durations(query)
    finally:
        query.stop()


def observed_counts(query: StreamingQuery, name: str) -> dict[str, int]:
    """Sums of the figures observed under ``name`` over the query's recent batches.

    Spark keeps the newest ``spark.sql.streaming.numRecentProgressUpdates`` (100).
    """
    totals: dict[str, int] = {}
    for progress in query.recentProgress:
        observed = progress.observedMetrics.get(name)
        for figure, value in (observed.asDict() if observed is not None else {}).items():
            totals[figure] = totals.get(figure, 0) + value
    return totals
