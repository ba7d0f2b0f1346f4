"""Entries for ``spark-submit``: load a topic, transform it, measure the output, analyse runs.

    spark-submit tidemark/app.py load      --target topic:/shared/in --rate 10000 --seconds 120
    spark-submit tidemark/app.py transform --source topic:/shared/in --target topic:/shared/out --checkpoint /shared/c1 --drain
    spark-submit tidemark/app.py measure   --source topic:/shared/out --engine run-p6 --out /shared/results --checkpoint /shared/c2 --drain
    spark-submit tidemark/app.py analyse   --results /shared/results run-p6

Places are ``topic:PATH`` (a recorded topic), ``files:PATH`` (Parquet with key and value) or
``kafka:SERVERS/TOPIC``. Memory, executors and checkpoint folder belong to ``spark-submit``.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __package__ in (None, ""):  # started as a file
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.cluster import build_session, settle  # noqa: E402
from tidemark.contract import MICROBATCH_INTAKE, RUN_SUMMARY  # noqa: E402
from tidemark.functions.clock import wall_clock  # noqa: E402
from tidemark.operators import compare, generate, latency, resources, summaries, transform  # noqa: E402
from tidemark.sources import kafka, replay, runs, topic  # noqa: E402
from tidemark.streaming import execute, measure  # noqa: E402


@dataclass(frozen=True)
class Place:
    """Where records come from or go to."""

    kind: str
    path: str

    @classmethod
    def parse(cls, text: str) -> Place:
        kind, _, path = text.partition(":")
        if kind not in ("topic", "files", "kafka") or not path or kind == "kafka" and "/" not in path:
            raise argparse.ArgumentTypeError(f"{text!r} is no topic:PATH, files:PATH or kafka:SERVERS/TOPIC")
        return cls(kind, path)

    def broker(self) -> tuple[str, str]:
        servers, _, name = self.path.rpartition("/")
        return servers, name


def _stream(spark: SparkSession, place: Place, mode: str, max_rows: int | None) -> DataFrame:
    if place.kind == "kafka":
        return kafka.kafka_event_source(spark, *place.broker(), mode=mode, max_offsets=max_rows)
    if place.kind == "topic":
        return topic.topic_stream(spark, place.path, max_rows)
    return replay.replay_stream(spark, place.path)


def load(spark: SparkSession, args: argparse.Namespace) -> None:
    """Synthetic events of a steady rate, sent at once; their stamps are paced."""
    events = generate.synthetic_events(spark, args.rate * args.seconds, args.seed, args.producers, args.payload_bytes, float(args.rate))
    records = generate.events_to_kafka_records(events, ("ts",))
    if args.target.kind == "topic":
        topic.record_topic(records.withColumn("timestamp", F.timestamp_micros((F.col("ts") * 1_000_000).cast("bigint"))), args.target.path, args.partitions)
    elif args.target.kind == "files":
        records.select("key", "value").write.mode("append").parquet(args.target.path)
    else:
        servers, name = args.target.broker()
        records.select("key", "value").write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", name).save()


def start_transform(spark: SparkSession, args: argparse.Namespace):
    """The transform as a stream in the asked mode; a recorded topic is delivered to at least once, like a broker's."""
    out = transform.transform_events(_stream(spark, args.source, args.mode, args.max_rows))
    if args.target.kind == "topic":
        if args.mode != "microbatch":
            raise ValueError("a recorded topic is written in micro-batches")
        return execute.run_batches(out, lambda batch, _: topic.record_topic(batch, args.target.path, args.partitions), args.checkpoint)
    sink = kafka.keyed_kafka_sink(*args.target.broker()) if args.target.kind == "kafka" else execute.file_sink(args.target.path)
    return execute.run(out, args.mode, sink, args.checkpoint, args.trigger)


def start_measure(spark: SparkSession, args: argparse.Namespace):
    """Latency records of the output while it arrives, and a summary of each batch.

    Under ``<out>/<engine>_latency.csv`` and ``<out>/<engine>_parts``; a batch that comes again replaces
    what it wrote.
    """
    raw = _stream(spark, args.source, "microbatch", args.max_rows)
    clock = F.unix_micros("timestamp") / F.lit(1_000_000.0) if args.clock == "record" else wall_clock()
    if args.clock == "record" and "timestamp" not in raw.columns:
        raise ValueError("only a recorded topic has the records' own time")
    seen = latency.record_latency(latency.parse_output_events(raw.withColumn("recv_ts", clock).select("recv_ts", "value")))
    tagged = measure.measure_stream(seen.withColumn("engine", F.lit(args.engine)), args.seconds, args.warmup)
    folder = f"{args.out}/{args.engine}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        text = runs.latency_text(batch).drop("engine")
        text.write.mode("overwrite").option("header", True).csv(f"{folder}_latency.csv/batch={batch_id}")
        summaries.write_part(summaries.summarise_part(batch), f"{folder}_parts", batch_id)
        batch.unpersist()

    return execute.run_batches(tagged, write, args.checkpoint)


def finish_measure(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Write the run's summary from its parts, without reading a record again."""
    parts = summaries.read_parts(spark, f"{args.out}/{args.engine}_parts")
    told = settle(summaries.summary_from_parts(parts, args.seconds, args.warmup))
    runs.write_summaries(told.select(*RUN_SUMMARY.fieldNames()), f"{args.out}", "append")
    return told


def analyse(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    """Latency, resources and backlog of the labels, in their order; of all labels with a summary or a log if none is named.

    Reads ``<label>_summary.json``, else ``<label>_consumer.log``, and ``<label>_top.txt`` and ``<label>_lag.txt``
    as far as they exist.
    """
    def there(kind: str) -> bool:
        glob = spark._jvm.org.apache.hadoop.fs.Path(f"{args.results}/*_{kind}")
        found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob)
        return found is not None and len(found) > 0

    def read(kind: str, reader, columns: str) -> DataFrame:
        return reader(spark, f"{args.results}/*_{kind}") if there(kind) else spark.createDataFrame([], columns)

    flat = ", ".join(["label string", *(f"{f.name} {f.dataType.simpleString()}" for f in RUN_SUMMARY)])
    files = read("summary.json", runs.read_summaries, flat)
    logs = read("consumer.log", runs.read_logs, "label string, text string")
    found = settle(runs.summary_prefer(files, logs))
    known = found.select("label")
    labels = args.labels or [r.label for r in known.orderBy("label").collect()]
    listed = spark.createDataFrame([(x,) for x in labels], "label string")
    pods = resources.pod_usage(read("top.txt", runs.read_pod_samples, "label string, ts bigint, ns string, pod string, millicores bigint, mem_mib double"))
    backlog = resources.topic_backlog(read("lag.txt", runs.read_offset_samples, "label string, ts bigint, in_end bigint, out_end bigint"))
    return {"latency": compare.latency_table(found.drop("engine").withColumnRenamed("label", "engine"), labels),
            "resources": compare.resource_backlog_table(listed, pods, backlog)}


def markdown(table: DataFrame) -> str:
    """A report's table as text: a row per label."""
    rows = [["" if v is None else str(v) for v in r] for r in table.collect()]
    lines = [table.columns, ["---"] * len(table.columns), *rows]
    return "\n".join("| " + " | ".join(cells) + " |" for cells in lines)


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="tidemark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = main.add_subparsers(dest="command", required=True)

    made = sub.add_parser("load", help="synthetic events")
    made.add_argument("--target", type=Place.parse, required=True)
    made.add_argument("--rate", type=int, default=10_000)
    made.add_argument("--seconds", type=int, default=120)
    made.add_argument("--payload-bytes", type=int, default=0)
    made.add_argument("--producers", type=int, default=1)
    made.add_argument("--seed", type=int, default=42)

    moved = sub.add_parser("transform", help="raw records to keyed output records")
    moved.add_argument("--mode", choices=("microbatch", "rtm"), default="microbatch")
    moved.add_argument("--trigger", default="5 seconds", help="of real-time mode")
    moved.add_argument("--target", type=Place.parse, required=True)

    told = sub.add_parser("measure", help="latency records and summary of output records")
    told.add_argument("--engine", required=True)
    told.add_argument("--warmup", type=float, default=15)
    told.add_argument("--seconds", type=float, default=120)
    told.add_argument("--out", required=True)
    told.add_argument("--clock", choices=("wall", "record"), default="wall")

    for part in (made, moved):
        part.add_argument("--partitions", type=int, default=6, help="of a recorded topic")
    for part in (moved, told):
        part.add_argument("--source", type=Place.parse, required=True)
        part.add_argument("--checkpoint", required=True)
        part.add_argument("--max-rows", type=int, default=MICROBATCH_INTAKE, help="of a micro-batch")
        part.add_argument("--drain", action="store_true", help="stop when the source has no more records")

    read = sub.add_parser("analyse", help="tables of measured runs")
    read.add_argument("--results", required=True)
    read.add_argument("labels", nargs="*")
    return main


def run(spark: SparkSession, argv: Sequence[str]) -> int:
    """One command; returns 2 if a measured run kept no record."""
    args = parser().parse_args(argv)
    if args.command == "load":
        load(spark, args)
    elif args.command == "analyse":
        for name, table in analyse(spark, args).items():
            print(f"## {name}\n\n{markdown(table)}\n")
    else:
        query = (start_transform if args.command == "transform" else start_measure)(spark, args)
        if args.drain:
            execute.drain(query)
        elif args.command == "measure":
            query.awaitTermination(int(args.seconds))
            query.stop()
        else:
            query.awaitTermination()
        if args.command == "measure":
            told = finish_measure(spark, args)
            print(markdown(latency.flatten_summary(told.select(*RUN_SUMMARY.fieldNames()))))
            return 0 if told.filter("kept_records > 0").count() else 2
    return 0


if __name__ == "__main__":
    realtime = "rtm" in sys.argv[1:]
    sys.exit(run(build_session("tidemark", realtime=realtime), sys.argv[1:]))
