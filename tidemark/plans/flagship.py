"""The flagship plan: raw records through the transform to one summary row per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.cluster import scratch_path
from tidemark.operators import latency, transform
from tidemark.plans import testbed as B
from tidemark.plans.latency_queries import WARMUP, WHOLE_RUN
from tidemark.plans.testbed import fixture_out_ts, fixture_recv_ts
from tidemark.sources import runs


def summarise_transformed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decode, transform and encode every event, record the output's latencies, summarise them.

    The records are written before they are summarised, as a measuring consumer does:
    the summary reads four columns a few times, and JSON is parsed once.
    """
    sent = transform.transform_events(B.raw_records(spark, sf_dir, B.PACE), fixture_out_ts())
    seen = latency.parse_output_events(sent).withColumn("event_number", F.col("event_id").cast("bigint"))
    received = seen.withColumns({
        "recv_ts": fixture_recv_ts("ts", "event_number"), "engine": B.two_runs("event_number")})
    path = scratch_path(spark, "flagship-latency")
    runs.latency_sink(latency.record_latency(received), path, "parquet")
    summary = latency.run_summary(runs.latency_records(spark, path, "parquet"), WHOLE_RUN, WARMUP)
    return latency.flatten_summary(latency.empty_run_flag(summary))


QUERIES = {"summarise_transformed_events": summarise_transformed_events}

ORACLES = {
    "summarise_transformed_events": f"""WITH {B.RUN_SQL}, {B.summary_sql('rec', 'engine', WHOLE_RUN, WARMUP)}
        SELECT *, kept_records = 0 AS empty_run FROM summary""",
}
