"""Readers and writers of run artifacts.

A run's label comes from the file name ``<label>_<kind>``, or from the folder of that name
when Spark wrote the artifact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.cluster import join_small, settle
from tidemark.contract import CONTAINER_STATS_TEXT, LATENCY_RECORD_COLUMNS, RUN_SUMMARY
from tidemark.functions.rounding import round_nearest
from tidemark.functions.usage import millicores, pod_memory_mib

# Decimals written for each latency record column.
_DECIMALS = {"recv_ts": 6, "ts": 6, "out_ts": 6, "pipeline_ms": 3, "e2e_ms": 3}


def label_from_path(path: Column, kind: str) -> Column:
    """``label`` of ``.../label_kind`` or ``.../[column=]label_kind/part-...``."""
    escaped = kind.replace(".", "\\.")
    return F.regexp_extract(path, f"(?:^|[/=])([^/=]+)_{escaped}(?:/[^/]*)?$", 1)


def _file_label(kind: str) -> Column:
    return label_from_path(_plain_path(F.col("_metadata.file_path")), kind)


def _plain_path(uri: Column) -> Column:
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


# --- latency records -----------------------------------------------------------------


def _fixed_text(column: str) -> Column:
    decimal = round_nearest(column, _DECIMALS[column]).try_cast(f"decimal(22,{_DECIMALS[column]})")
    return F.coalesce(decimal.cast("string"), F.col(column).cast("string"))


def latency_text(df: DataFrame, by: str = "engine", carry: Sequence[str] = ()) -> DataFrame:
    """The columns of a latency file as text with fixed decimals, for a batch or a stream."""
    return df.select(by, *carry, *[_fixed_text(c).alias(c) if c in _DECIMALS else F.col(c) for c in LATENCY_RECORD_COLUMNS])


def latency_sink(df: DataFrame, path: str, fmt: str = "csv", by: str = "engine", mode: str = "overwrite",
                 max_records_per_file: int = 0) -> None:
    """Write every record, warm-up included, one folder per run.

    Rows are written where they are, without a shuffle: a large run becomes many files,
    never one task. CSV has fixed decimals; NaN, infinities and what 22 digits do not hold
    are written as the text of the double. Parquet keeps the doubles.
    """
    df = latency_text(df, by) if fmt == "csv" else df.select(by, *LATENCY_RECORD_COLUMNS)
    writer = df.write.format(fmt).mode(mode).partitionBy(by)
    if fmt == "csv":
        writer = writer.option("header", True)
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.save(path)


def latency_records(spark: SparkSession, path: str, fmt: str = "csv", by: str = "engine", more: Sequence[str] = ()) -> DataFrame:
    """Read what ``latency_sink`` wrote; rows without a receive time are dropped.

    ``more`` are further columns (name and type) by which the files are laid out below the run.
    """
    schema = ", ".join(["recv_ts double, event_id string, ts double, out_ts double, pipeline_ms double, e2e_ms double", f"{by} string", *more])
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path).filter("recv_ts IS NOT NULL")


def read_latency_files(spark: SparkSession, paths: str | list[str], by: str = "engine") -> DataFrame:
    """Records of ``<run>_latency.csv`` files (or folders of that name), with the run of the name.

    Columns are recv_ts, event_id, ts, out_ts, pipeline_ms, e2e_ms under a header; rows
    without a receive time are dropped.
    """
    schema = "recv_ts double, event_id string, ts double, out_ts double, pipeline_ms double, e2e_ms double"
    read = spark.read.schema(schema).option("header", True).csv(paths)
    return read.select("*", _file_label("latency.csv").alias(by)).filter("recv_ts IS NOT NULL")


# --- summaries -----------------------------------------------------------------------


def write_summaries(summaries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON file per run, under ``<engine>_summary.json``."""
    folder = F.concat(F.col("engine"), F.lit("_summary.json"))
    (summaries.withColumn("run", folder).write.mode(mode).partitionBy("run")
     .option("maxRecordsPerFile", 1).option("ignoreNullFields", False).json(path))


def read_summaries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Summaries with the label of their file; one JSON document per file, on any lines."""
    read = spark.read.schema(RUN_SUMMARY).option("multiLine", True).json(paths)
    return read.select(_file_label("summary.json").alias("label"), *RUN_SUMMARY.fieldNames())


# Characters of the part of a log that may be a summary; a summary has a few hundred.
SUMMARY_CHARS = 1 << 24


def read_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Consumer logs, one row per file that may hold a summary: label and the lines that may.

    These are the lines from the first that holds ``{`` to the last that holds ``}``. A log of any size is
    read in splits: a first pass finds both lines by their place, a second keeps the lines between them, and
    only these are put together. A log without such lines, or with more than ``SUMMARY_CHARS`` between them,
    has no row. Line ends are read as ``\\n``.
    """
    # Lines of a split are numbered in order, and splits by where they begin: a line's place in its file.
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), _file_label("consumer.log").alias("label"), place.alias("place"), F.col("value").alias("text"))
    spans = settle(lines.groupBy("path").agg(F.min(F.when(F.contains("text", F.lit("{")), F.col("place"))).alias("first"),
                                             F.max(F.when(F.contains("text", F.lit("}")), F.col("place"))).alias("last")).filter("first <= last"))
    between = join_small(lines, spans, ["path"], F.col("place").between(F.col("first"), F.col("last")))
    sizes = settle(between.groupBy("path").agg(F.sum(F.length("text") + 1).alias("chars")).filter(F.col("chars") <= SUMMARY_CHARS))
    kept = join_small(between.drop("first", "last"), sizes.select("path"), ["path"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda s: s["text"]), "\n")
    return kept.groupBy("path").agg(F.first("label").alias("label"), joined.alias("text")).select("label", "text")


def log_summary_extract(logs: DataFrame) -> DataFrame:
    """Summary embedded in each log: from its first ``{`` to its last ``}``.

    Logs without one, or with one that does not parse, have no row.
    """
    text = F.regexp_extract("text", r"(?s)(\{.*\})", 1)
    found = logs.select("label", F.from_json(text, RUN_SUMMARY).alias("s"))
    return found.filter(F.col("s.kept_records").isNotNull()).select("label", "s.*")


def summary_prefer(summaries: DataFrame, logs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Summary file if a label has one, else the summary in its log, else no row."""
    fields = F.struct(*RUN_SUMMARY.fieldNames()).alias("s")
    ranked = summaries.select("label", F.lit(0).alias("source"), fields).unionByName(
        log_summary_extract(logs).select("label", F.lit(1).alias("source"), fields))
    best = ranked.groupBy("label").agg(F.min_by("s", "source").alias("s"))
    if labels is not None:
        best = labels.select("label").distinct().join(best, "label")
    return best.select("label", "s.*")


# --- samples -------------------------------------------------------------------------


def read_container_stats(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Container samples with their engine; rows whose figures do not parse are dropped."""
    raw = spark.read.schema(CONTAINER_STATS_TEXT).option("header", True).option("enforceSchema", False).csv(paths)
    return parse_container_stats(raw.withColumn("engine", _file_label("stats.csv")))


def parse_container_stats(raw: DataFrame) -> DataFrame:
    number = {c: F.col(c).try_cast("double") for c in ("cpu_pct", "mem_used_mb", "mem_pct")}
    typed = raw.withColumns({"epoch": F.col("epoch").try_cast("bigint"), **number})
    return typed.filter("cpu_pct IS NOT NULL AND mem_used_mb IS NOT NULL")


def _words(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda w: w != "")


def read_pod_samples(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    lines = spark.read.text(paths).select(_file_label("top.txt").alias("label"), F.col("value").alias("line"))
    return parse_pod_samples(lines)


# Words are taken with get(): the filter on them may be evaluated before the one on their number.
def parse_pod_samples(lines: DataFrame) -> DataFrame:
    """``ts ns pod <n>m <n>Mi`` lines to columns; short or non-integer lines are skipped."""
    words = lines.select("label", _words(F.col("line")).alias("w")).filter(F.size("w") >= 5)
    ts, ns, pod, cpu, mem = [F.get("w", i) for i in range(5)]
    parsed = words.select("label", ts.try_cast("bigint").alias("ts"), ns.alias("ns"), pod.alias("pod"),
                          millicores(cpu).alias("millicores"), pod_memory_mib(mem).alias("mem_mib"))
    return parsed.dropna(subset=["ts", "millicores", "mem_mib"])


def read_offset_samples(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    lines = spark.read.text(paths).select(_file_label("lag.txt").alias("label"), F.col("value").alias("line"))
    return parse_offset_samples(lines)


def parse_offset_samples(lines: DataFrame) -> DataFrame:
    """``ts in_end out_end`` lines to columns; anything but three integers is skipped."""
    words = lines.select("label", _words(F.col("line")).alias("w")).filter(F.size("w") == 3)
    names = ("ts", "in_end", "out_end")
    return words.select("label", *[F.get("w", i).try_cast("bigint").alias(n) for i, n in enumerate(names)]).dropna(
        subset=list(names))


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Paths of the files, without reading their content."""
    listed = spark.read.format("binaryFile").load(paths)
    return listed.select(_plain_path(F.col("path")).alias("path"))
