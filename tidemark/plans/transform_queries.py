"""Queries over the event transform, its sources and its generator."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.cluster import scratch_path
from tidemark.contract import AMOUNT_MAX, COUNTRIES, EVENT_TYPES, INPUT_EVENT, OUTPUT_EVENT, USER_COUNT
from tidemark.functions.records import decode
from tidemark.operators import generate, transform
from tidemark.plans import testbed as B
from tidemark.plans.testbed import fixture_out_ts
from tidemark.sources.replay import replay_source as read_replay

_OUTPUT_SQL = f"""event_id, user_id, event_type, upper(country) AS country, amount, {B.TAX_SQL} AS amount_with_tax,
  ts, {B.OUT_TS_SQL} AS out_ts"""
_OUTPUT_FIXTURE_SQL = "ts + CAST(pmod(event_id * 7919, 50000) AS DOUBLE) / 1000000D"


def _with_decoded_value(records: DataFrame, schema=OUTPUT_EVENT) -> DataFrame:
    """Key and decoded value: encoded numbers are compared by value, not by text."""
    return records.select("key", decode("value", schema).alias("e")).select("key", "e.*")


def decode_events(spark: SparkSession, sf: str) -> DataFrame:
    return transform.decode_events(B.raw_records(spark, sf))


def filter_purchase_intent(spark: SparkSession, sf: str) -> DataFrame:
    return transform.filter_purchase_intent(B.events(spark, sf))


def amount_with_tax(spark: SparkSession, sf: str) -> DataFrame:
    return transform.add_amount_with_tax(B.events(spark, sf)).select("event_id", "amount", "amount_with_tax")


def amount_with_tax_scaled_round(spark: SparkSession, sf: str) -> DataFrame:
    taxed = transform.add_amount_with_tax(B.events(spark, sf), "scaled")
    return taxed.select("event_id", "amount", "amount_with_tax")


def upper_country(spark: SparkSession, sf: str) -> DataFrame:
    return transform.upper_country(B.events(spark, sf)).select("event_id", "country")


def stamp_out_ts(spark: SparkSession, sf: str) -> DataFrame:
    """What holds for every row's wall clock; clocks of a cluster may differ by a minute."""
    start = time.time() - 60
    stamped = transform.stamp_out_ts(B.events(spark, sf))
    return stamped.select("event_id", "ts", F.col("out_ts").isNotNull().alias("stamped"),
                          (F.col("out_ts") == F.round(F.col("out_ts") * 1000) / 1000).alias("whole_milliseconds"),
                          (F.col("out_ts") >= start).alias("after_start"))


def carry_ts(spark: SparkSession, sf: str) -> DataFrame:
    kept = transform.filter_purchase_intent(B.events(spark, sf))
    return transform.enrich(kept, fixture_out_ts())


def encode_events(spark: SparkSession, sf: str) -> DataFrame:
    """Encoded and read back."""
    kept = transform.filter_purchase_intent(B.events(spark, sf))
    encoded = transform.encode_events(transform.enrich(kept, fixture_out_ts()))
    return encoded.select(decode("value", OUTPUT_EVENT).alias("e")).select("e.*")


def key_by_user(spark: SparkSession, sf: str) -> DataFrame:
    """Both key dialects; the JSON key is read back."""
    keyed = transform.key_by_user(B.events(spark, sf)).withColumnRenamed("key", "text_key")
    keyed = transform.key_by_user(keyed, "json")
    return keyed.select("event_id", "text_key",
                        F.from_json("key", "user_id bigint").getField("user_id").alias("json_key_user_id"))


def transform_events(spark: SparkSession, sf: str) -> DataFrame:
    """The whole transform over raw records."""
    return _with_decoded_value(transform.transform_events(B.raw_records(spark, sf), fixture_out_ts()))


def transform_events_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The whole transform as SQL text over a view."""
    B.raw_records(spark, sf).createOrReplaceTempView("tidemark_raw_records")
    return _with_decoded_value(transform.transform_events_sql(spark, "tidemark_raw_records", _OUTPUT_FIXTURE_SQL))


def decode_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Damaged records under the three decode policies."""
    raw = B.messy_records(spark, sf)
    policies = {"strict": {}, "coerced": {"coerce": True}, "default": {"missing": "default"}}
    parts = [
        transform.transform_decoded(raw, F.lit(0.0), **options).drop("out_ts").withColumn("policy", F.lit(name))
        for name, options in policies.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def rejected_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records that do not decode cleanly, counted by reason."""
    return transform.rejects(B.messy_records(spark, sf)).groupBy("reason").agg(F.count("*").alias("records"))


def pad_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Padded records: encoded growth, and the events that the padded records decode to."""
    plain = generate.events_to_kafka_records(B.events(spark, sf)).select(F.col("value").alias("plain"))
    events = plain.select("plain", decode("plain").alias("e")).select("plain", "e.*")
    padded = generate.events_to_kafka_records(transform.pad_payload(events, 1024), carry=("plain",))
    both = padded.select(decode("value").alias("e"), (F.octet_length("value") - F.octet_length("plain")).alias("added_bytes"))
    return both.select("e.*", "added_bytes")


def replay_source(spark: SparkSession, sf: str) -> DataFrame:
    """Records written once and replayed from files into the transform."""
    path = scratch_path(spark, "replay")
    B.raw_records(spark, sf).write.parquet(path)
    return transform.transform_decoded(read_replay(spark, path), fixture_out_ts())


def synthetic_events(spark: SparkSession, sf: str) -> DataFrame:
    """One synthetic event per row of the events table, from two producers."""
    ids = spark.read.schema(B.EVENTS_TABLE).parquet(f"{sf}/events.parquet").select("event_id")
    return generate.events_from_ids(ids, "event_id", seed=42, producers=2)


def events_to_kafka_records(spark: SparkSession, sf: str) -> DataFrame:
    return _with_decoded_value(B.raw_records(spark, sf), INPUT_EVENT)


QUERIES = {
    f.__name__: f
    for f in (
        decode_events, filter_purchase_intent, amount_with_tax, amount_with_tax_scaled_round, upper_country,
        stamp_out_ts, carry_ts, encode_events, key_by_user, transform_events, transform_events_sql, decode_policy,
        rejected_records, pad_payload, replay_source, synthetic_events, events_to_kafka_records,
    )
}

def _drawn(stream: int, size: int) -> str:
    return generate.draw_sql("event_id", 42, stream, size, "//")


def _listed(values, stream: int) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[1 + {_drawn(stream, len(values))}]"


_TRANSFORMED = f"WITH {B.EVENTS_SQL} SELECT {_OUTPUT_SQL} FROM m WHERE {B.PASS_SQL}"
_KEYED = f"WITH {B.EVENTS_SQL} SELECT CAST(user_id AS VARCHAR) AS key, {_OUTPUT_SQL} FROM m WHERE {B.PASS_SQL}"

ORACLES = {
    "synthetic_events": f"""SELECT event_id // 2 + 1 AS event_id, {_drawn(1, USER_COUNT)} + 1 AS user_id,
        {_listed(EVENT_TYPES, 2)} AS event_type, {_listed(COUNTRIES, 3)} AS country,
        CAST({_drawn(4, int(AMOUNT_MAX * 100) + 1)} AS DOUBLE) / 100::DOUBLE AS amount,
        1750000000::DOUBLE + CAST(event_id AS DOUBLE) / 10000::DOUBLE AS ts, CAST(event_id % 2 AS INTEGER) AS producer FROM events""",
    "stamp_out_ts": f"""WITH {B.EVENTS_SQL} SELECT event_id, ts, true AS stamped, true AS whole_milliseconds,
        true AS after_start FROM m""",
    "decode_events": f"WITH {B.EVENTS_SQL} SELECT * FROM m",
    "filter_purchase_intent": f"WITH {B.EVENTS_SQL} SELECT * FROM m WHERE {B.PASS_SQL}",
    "amount_with_tax": f"WITH {B.EVENTS_SQL} SELECT event_id, amount, {B.TAX_SQL} AS amount_with_tax FROM m",
    "amount_with_tax_scaled_round": f"""WITH {B.EVENTS_SQL} SELECT event_id, amount,
        floor(amount * 1.21::DOUBLE * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE AS amount_with_tax FROM m""",
    "upper_country": f"WITH {B.EVENTS_SQL} SELECT event_id, upper(country) AS country FROM m",
    "carry_ts": _TRANSFORMED,
    "encode_events": _TRANSFORMED,
    "key_by_user": f"""WITH {B.EVENTS_SQL} SELECT event_id, CAST(user_id AS VARCHAR) AS text_key,
        user_id AS json_key_user_id FROM m""",
    "transform_events": _KEYED,
    "transform_events_sql": _KEYED,
    "decode_policy": f"""WITH {B.EVENTS_SQL},
        kinds AS (SELECT *, event_id % 10 AS kind, {B.TAX_SQL} AS amount_with_tax FROM m
          WHERE {B.PASS_SQL} AND event_id % 10 NOT IN (0, 6, 7, 8)),
        policies AS (SELECT unnest(['strict', 'coerced', 'default']) AS policy)
        SELECT policy,
          CASE WHEN kind = 2 AND policy = 'strict' THEN NULL WHEN kind = 2 AND policy = 'default' THEN 0
            ELSE event_id END AS event_id,
          CASE WHEN kind = 4 THEN CASE WHEN policy = 'default' THEN 0 END ELSE user_id END AS user_id,
          event_type,
          CASE WHEN kind = 3 THEN CASE WHEN policy = 'default' THEN '' END ELSE upper(country) END AS country,
          amount, amount_with_tax, ts
        FROM kinds JOIN policies ON kind <> 1 OR policy = 'coerced'""",
    "rejected_records": f"""WITH {B.EVENTS_SQL}
        SELECT CASE WHEN event_id % 10 = 8 THEN 'blank' ELSE 'undecodable' END AS reason, count(*) AS records
        FROM m WHERE event_id % 10 IN (0, 1, 2, 8) GROUP BY 1""",
    "pad_payload": f"""WITH {B.EVENTS_SQL} SELECT *, CAST(1024 + length(',"pad":""') AS INTEGER) AS added_bytes FROM m""",
    "replay_source": _TRANSFORMED,
    "events_to_kafka_records": f"WITH {B.EVENTS_SQL} SELECT CAST(user_id AS VARCHAR) AS key, * FROM m",
}
