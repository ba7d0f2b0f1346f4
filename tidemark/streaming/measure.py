"""Measuring a run while it lasts: phases of records, progress by windows, records without copies."""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import summaries

RUN_SALTS = 16
# Bytes of held back rows that a task keeps in memory; the rest lies in a file of Spark's local folder.
HELD_BYTES = 1 << 22


def _dealt(by: str, salts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Deal records over the salts of their run, and tell every salt when the run's records here began."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            salt = pa.array([(place + k) % salts for k in range(n)], pa.int32())
            place += n
            yield pa.RecordBatch.from_arrays([*batch.columns, salt, pa.array([False] * n)], [*batch.schema.names, "__salt", "__begins"])
            begun = pa.table({by: batch.column(by), "recv_ts": batch.column("recv_ts")}).group_by(by).aggregate([("recv_ts", "min")])
            told = pa.concat_tables([begun.append_column("__salt", pa.array([s] * len(begun), pa.int32())) for s in range(salts)])
            columns = [told.column(by).cast(f.type) if f.name == by else told.column("recv_ts_min").cast(f.type) if f.name == "recv_ts" else pa.nulls(len(told), f.type)
                       for f in batch.schema]
            columns += [told.column("__salt"), pa.array([True] * len(told))]
            yield from pa.Table.from_arrays(columns, [*batch.schema.names, "__salt", "__begins"]).combine_chunks().to_batches()
    return run


def _phases(names: Sequence[str], warmup_s: float, seconds: float, held_bytes: int = HELD_BYTES):
    """Records of one salt of a run to those within its window, with ``kept``; the run's start lies in the state."""
    def tagged(rows: pd.DataFrame, start: float) -> Iterator[pd.DataFrame]:
        since = rows["recv_ts"] - start
        inside = ~rows["__begins"].astype(bool) & (since < seconds)
        if inside.any():
            yield rows.loc[inside, list(names)].assign(kept=since[inside] >= warmup_s)

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            for rows in chunks:
                yield from tagged(rows, state.get[0])
            return
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        with tempfile.SpooledTemporaryFile(held_bytes, dir=folder) as held:
            start, n = None, 0
            for rows in chunks:
                begins = rows["__begins"].astype(bool)
                first = rows.loc[begins, "recv_ts"].min()
                if first == first and (start is None or first < start):
                    start = float(first)
                pickle.dump(rows.loc[~begins], held, pickle.HIGHEST_PROTOCOL)
                n += 1
            if start is not None:
                state.update((start,))
                held.seek(0)
                for _ in range(n):
                    yield from tagged(pickle.load(held), start)
    return run


def measure_stream(records: DataFrame, seconds: float, warmup_s: float, by: str = "engine", salts: int = RUN_SALTS) -> DataFrame:
    """Stream of latency records to those of the run's window, with boolean ``kept``.

    The same as ``latency.tag_phase`` for a stream whose first batch holds the run's first arrival: the
    smallest ``recv_ts`` of the first batch in which the run appears is its start, is kept in the state
    store, and outlives restarts. Records that arrive later with an earlier time are seen, not kept.
    Rows without a receive time are dropped; a null run is a run of its own.

    A run is dealt over ``salts`` keys, so one that holds all records is measured by as many tasks. Each
    salt has the start in its own state: every Arrow batch tells all salts the earliest time it holds. Only
    in a run's first batch are rows held back, until its start is known: 1/``salts`` of that batch, of which
    a task has ``HELD_BYTES`` in memory and the rest in a local file.
    """
    # rows that tell of a start carry nothing else, so every column may be null on the way
    fields = [T.StructField(f.name, f.dataType) for f in records.schema]
    inner = T.StructType([*fields, T.StructField("__salt", T.IntegerType()), T.StructField("__begins", T.BooleanType())])
    outer = T.StructType([*fields, T.StructField("kept", T.BooleanType())])
    if not isinstance(records.schema["recv_ts"].dataType, T.DoubleType):
        raise ValueError("recv_ts must be a double: epoch seconds")
    dealt = records.filter("recv_ts IS NOT NULL AND NOT isnan(recv_ts)").mapInArrow(_dealt(by, salts), inner)
    return dealt.groupBy(by, "__salt").applyInPandasWithState(
        _phases(records.columns, float(warmup_s), float(seconds)), outer, T.StructType([T.StructField("start", T.DoubleType())]), "append", "NoTimeout")


# --- progress ------------------------------------------------------------------------


def window_counts(tagged: DataFrame, every: str = "5 seconds", late: str = "1 minute", by: str = "engine") -> DataFrame:
    """Seen and kept records per run and tumbling window of the receive time, as a stream or a batch.

    ``window_start`` is epoch seconds. A stream keeps a window until the largest receive time is ``late``
    past its end. A record that arrives after that is late: it is not counted, and the query's
    progress reports it (``late_rows``). Counts are made before the shuffle: one row per task, window and run.
    """
    timed = tagged.withColumn("__at", F.timestamp_micros((F.col("recv_ts") * 1_000_000).cast("bigint")))
    if timed.isStreaming:
        timed = timed.withWatermark("__at", late)
    counts = timed.groupBy(F.window("__at", every).alias("w"), by).agg(
        F.count("*").alias("seen"), F.count_if(F.col("kept")).alias("kept"))
    return counts.select(by, (F.unix_micros("w.start") / F.lit(1_000_000.0)).alias("window_start"), "seen", "kept")


def progress_sink(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for update mode: a batch's changed windows, under its number.

    A batch that is repeated after a failure replaces what it wrote.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def read_progress(spark, path: str, by: str = "engine") -> DataFrame:
    """Newest counts of every window, and what its run had seen and kept up to the window's end.

    Windows of a run are added up in one task each: a row per window, not per record.
    """
    updates = spark.read.parquet(path)
    newest = updates.groupBy(by, "window_start").agg(F.max_by(F.struct("seen", "kept"), "batch").alias("c"))
    so_far = W.partitionBy(by).orderBy("window_start")
    return newest.select(by, "window_start", "c.seen", "c.kept", F.sum("c.seen").over(so_far).alias("seen_so_far"),
                         F.sum("c.kept").over(so_far).alias("kept_so_far"))


def late_rows(query) -> int:
    """Records that the query's recent batches have dropped as late."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


# --- summaries while the run lasts -----------------------------------------------------


def summary_sink(path: str, by: str = "engine") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: a summary of each micro-batch, as a part of its own (see ``operators.summaries``)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        summaries.write_part(summaries.summarise_part(batch, by), path, batch_id)
    return write


# --- records without copies --------------------------------------------------------------


def without_copies(stream: DataFrame, time: str, within: str, key: Sequence[str] = ("producer", "event_id")) -> DataFrame:
    """At-least-once output with each id once: the first of its copies.

    ``time`` is a timestamp column. Ids are forgotten when the largest time is ``within`` past theirs, which
    bounds the state; a copy is found if its time is at most ``within`` from the first one's, and a replayed
    record keeps its time. Records that are older than that on arrival are dropped as late. Rows whose key
    is null in the same fields are copies of each other.
    """
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(list(key))
