"""Recorded topics: partitioned records with offsets, kept in files and read as a batch or a stream.

A recording stands in for a broker's topic: each record has a partition, an offset that counts up
within it, a time, a key and a value. Files hold segments of consecutive offsets; an index names
their ranges. The stream's position is an offset per partition, and a batch admits a number of rows.

The reader is a Python data source: Spark asks it for offsets and tasks, and each task reads a range
of one segment with pyarrow. The folder must be reachable by pyarrow's file systems on the driver and
on all executors (a shared mount, HDFS with its client library, S3 or GCS).
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.operators.numbering import number_rows

# Executors need not have this package: the reader's classes travel with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "recorded_topic"
RECORDED = "partition int, offset bigint, timestamp timestamp, key string, value string"
SEGMENT_ROWS = 100_000
ROWS_PER_TASK = 50_000
_ARROW = pa.schema([("partition", pa.int32()), ("offset", pa.int64()), ("timestamp", pa.timestamp("us", "UTC")),
                    ("key", pa.string()), ("value", pa.string())])


# --- writing ---------------------------------------------------------------------------


def record_topic(records: DataFrame, path: str, partitions: int = 6, segment_rows: int = SEGMENT_ROWS) -> None:
    """Append ``records`` (key, value, and timestamp if there is one) to the topic at ``path``.

    A key always goes to the same partition; records without a key are dealt by their value. Offsets
    go on where the partition ended and ascend with the timestamp, null first. A topic has one writer
    at a time. Readers see a recording when its index is complete, and all of it at once. Other
    columns are dropped; an empty table adds an empty recording.
    """
    if partitions < 1 or segment_rows < 1:
        raise ValueError("partitions and segment_rows must be at least 1")
    spark = records.sparkSession
    stamp = F.unix_micros(F.col("timestamp").cast("timestamp")) if "timestamp" in records.columns else F.lit(None).cast("bigint")
    dealt = records.select(
        F.pmod(F.coalesce(F.xxhash64("key"), F.xxhash64("value")) if "key" in records.columns else F.xxhash64("value"),
               F.lit(partitions)).cast("int").alias("partition"),
        stamp.alias("micros"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    ends = _ends(_index(path))
    base = F.coalesce(*[F.when(F.col("partition") == int(p), F.lit(end)) for p, end in ends.items()], F.lit(0)).cast("bigint")
    placed = number_rows(dealt, ["partition"], ["micros"]).withColumn("offset", base + F.col("position"))
    placed = placed.withColumn("segment", F.expr(f"offset div {int(segment_rows)}")).drop("position")
    recording = uuid.uuid4().hex
    data = f"{path.rstrip('/')}/data/{recording}"
    (placed.repartition("partition", "segment").sortWithinPartitions("partition", "segment", "offset")
     .write.partitionBy("partition", "segment").parquet(data))
    kept = spark.read.schema("micros bigint, key string, value string, offset bigint, partition int, segment bigint").parquet(data)
    files = kept.groupBy("partition", F.col("_metadata.file_path").alias("file")).agg(
        F.min("offset").alias("first"), F.max("offset").alias("last"))
    files.write.json(f"{path.rstrip('/')}/index/{recording}")


# --- index -----------------------------------------------------------------------------


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it; ``file:`` paths are local."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _index(path: str) -> list[dict]:
    """Partition, first and last offset and file of every segment of the complete recordings."""
    system, root = _located(path.rstrip("/"))
    listed = system.get_file_info(fs.FileSelector(f"{root}/index", allow_not_found=True, recursive=True))
    complete = {f.path.rsplit("/", 1)[0] for f in listed if f.base_name == "_SUCCESS"}
    segments = []
    for file in sorted(f.path for f in listed if f.base_name.endswith(".json") and f.path.rsplit("/", 1)[0] in complete):
        with system.open_input_stream(file) as lines:
            segments += [json.loads(line) for line in lines.read().decode().splitlines() if line]
    return segments


def _ends(segments: list[dict]) -> dict[str, int]:
    ends: dict[str, int] = {}
    for s in segments:
        name = str(s["partition"])
        ends[name] = max(ends.get(name, 0), s["last"] + 1)
    return ends


def _starts(segments: list[dict]) -> dict[str, int]:
    starts: dict[str, int] = {}
    for s in segments:
        name = str(s["partition"])
        starts[name] = min(starts.get(name, s["first"]), s["first"])
    return starts


def capped(at: dict[str, int], ends: dict[str, int], rows: int | None) -> dict[str, int]:
    """Offsets at most ``rows`` records past ``at``.

    Each partition takes part by what it has left, and with a record at least if ``rows`` allows,
    so that partitions which are ordered by time advance together.
    """
    left = {p: max(0, end - at.get(p, 0)) for p, end in sorted(ends.items())}
    total = sum(left.values())
    if rows is None or total <= rows:
        return {**at, **{p: max(end, at.get(p, 0)) for p, end in ends.items()}}
    taken = {p: rows * n // total for p, n in left.items()}
    spare = rows - sum(taken.values())
    for p in sorted(left, key=lambda p: (taken[p] > 0, p)):  # those without a record first
        if spare and taken[p] < left[p]:
            taken[p] += 1
            spare -= 1
    return {**at, **{p: at.get(p, 0) + n for p, n in taken.items()}}


# --- reading ---------------------------------------------------------------------------


class Range(InputPartition):
    """Offsets ``first`` up to ``end`` of one segment."""

    def __init__(self, file: str, partition: int, first: int, end: int):
        self.file, self.partition, self.first, self.end = file, partition, first, end


def ranges(segments: list[dict], start: dict[str, int], end: dict[str, int], rows_per_task: int) -> list[Range]:
    """The parts of segments between two positions, none with more rows than asked for."""
    found = []
    for s in segments:
        name = str(s["partition"])
        first, stop = max(s["first"], start.get(name, 0)), min(s["last"] + 1, end.get(name, 0))
        found += [Range(s["file"], s["partition"], k, min(k + rows_per_task, stop)) for k in range(first, stop, rows_per_task)]
    return found


def read_range(part: Range) -> Iterator[pa.RecordBatch]:
    """Records of the range; row groups outside it are not read."""
    system, path = _located(part.file)
    with system.open_input_file(path) as handle:
        file = pq.ParquetFile(handle)
        place = file.schema_arrow.names.index("offset")
        groups = []
        for g in range(file.num_row_groups):
            known = file.metadata.row_group(g).column(place).statistics
            if known is None or not known.has_min_max or known.min < part.end and known.max >= part.first:
                groups.append(g)
        for batch in file.iter_batches(10_000, row_groups=groups, columns=["offset", "micros", "key", "value"]):
            offset = batch.column("offset")
            low, high = pa.scalar(part.first, pa.int64()), pa.scalar(part.end, pa.int64())
            batch = batch.filter(pa.compute.and_(pa.compute.greater_equal(offset, low), pa.compute.less(offset, high)))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.partition] * batch.num_rows, pa.int32()), batch.column("offset"),
                     batch.column("micros").cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC")), batch.column("key"), batch.column("value")],
                    schema=_ARROW)


def _positive(options, name: str, default: int | None) -> int | None:
    value = options.get(name)
    if value is None:
        return default
    if int(value) < 1:
        raise ValueError(f"{name} must be at least 1, not {value}")
    return int(value)


class _BatchReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.task = options["path"], _positive(options, "rowsPerTask", ROWS_PER_TASK)

    def partitions(self) -> list[Range]:
        segments = _index(self.path)
        return ranges(segments, _starts(segments), _ends(segments), self.task)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from read_range(partition) if partition is not None else ()


class _StreamReader(DataSourceStreamReader):
    """Spark asks for the latest offsets without saying from where; the last planned end is kept here.

    After a restart Spark plans the last range of the checkpoint again, or an empty one at its end,
    before it asks, so the position is known by then.
    """

    def __init__(self, options):
        self.path, self.task = options["path"], _positive(options, "rowsPerTask", ROWS_PER_TASK)
        self.rows = _positive(options, "maxRowsPerTrigger", None)
        self.begin = options.get("startingOffsets", "earliest")
        if self.begin not in ("earliest", "latest"):
            raise ValueError(f"startingOffsets must be 'earliest' or 'latest', not {self.begin!r}")
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict[str, int]:
        segments = _index(self.path)
        return _starts(segments) if self.begin == "earliest" else _ends(segments)

    def latestOffset(self) -> dict[str, int]:
        if self.at is None:
            self.at = self.initialOffset()
        return capped(self.at, _ends(_index(self.path)), self.rows)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.at = dict(end)
        return ranges(_index(self.path), start, end, self.task)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from read_range(partition)

    def commit(self, end: dict) -> None:
        """Recordings are kept."""


class RecordedTopic(DataSource):
    """``path``, ``rowsPerTask``; for streams also ``maxRowsPerTrigger`` and ``startingOffsets``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return RECORDED

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def topic_source(spark: SparkSession, path: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """All records of the topic: partition, offset, timestamp, key, value."""
    spark.dataSource.register(RecordedTopic)
    return spark.read.format(FORMAT).option("rowsPerTask", rows_per_task).load(path)


def topic_stream(spark: SparkSession, path: str, max_rows: int | None = None, starting_offsets: str = "earliest",
                 rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The same as a stream; a micro-batch takes at most ``max_rows`` records.

    Run it to the end of the topic with ``execute.drain``: ``availableNow`` fixes its end with the
    first question for offsets, and would stop after ``max_rows`` records.
    """
    spark.dataSource.register(RecordedTopic)
    reader = spark.readStream.format(FORMAT).option("rowsPerTask", rows_per_task).option("startingOffsets", starting_offsets)
    if max_rows is not None:
        reader = reader.option("maxRowsPerTrigger", max_rows)
    return reader.load(path)
