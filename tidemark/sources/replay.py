"""Records replayed from files, for work without a broker.

Replayed records have the shape the transform reads from Kafka: ``key`` and ``value``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])


def replay_source(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Batch of records from ``parquet``, or ``text`` with one JSON value per line."""
    if fmt == "text":
        return spark.read.text(path)
    return spark.read.schema(RECORD).format(fmt).load(path)


def replay_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """The same as a stream; each micro-batch takes at most the given number of files."""
    reader = spark.readStream.format(fmt)
    if fmt != "text":
        reader = reader.schema(RECORD)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)
