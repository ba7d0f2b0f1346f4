from pyspark.sql import functions as F

from tidemark.contract import COUNTRIES, EVENT_TYPES
from tidemark.functions.records import decode
from tidemark.operators import generate, resources, transform


def test_values_are_within_the_contract(spark):
    events = generate.synthetic_events(spark, 20_000)
    stats = events.agg(F.min("event_id"), F.max("event_id"), F.countDistinct("event_id"), F.min("user_id"),
                       F.max("user_id"), F.min("amount"), F.max("amount")).first()
    assert tuple(stats)[:3] == (1, 20_000, 20_000)
    assert 1 <= stats[3] and stats[4] <= 100_000 and 0 <= stats[5] and stats[6] <= 500
    assert {r[0] for r in events.select("event_type").distinct().collect()} == set(EVENT_TYPES)
    assert {r[0] for r in events.select("country").distinct().collect()} == set(COUNTRIES)
    assert events.filter(F.round("amount", 2) != F.col("amount")).count() == 0


def test_about_a_third_passes_the_filter(spark):
    rate = resources.filter_pass_rate(generate.synthetic_events(spark, 50_000)).first()
    assert abs(rate.pass_rate - 1 / 3) < 0.01 and rate.events == 50_000


def test_rows_do_not_depend_on_partitioning(spark):
    one = generate.synthetic_events(spark, 5000, producers=3, partitions=1)
    many = generate.synthetic_events(spark, 5000, producers=3, partitions=13)
    assert one.exceptAll(many).count() == 0
    assert generate.synthetic_events(spark, 5000, seed=1).exceptAll(generate.synthetic_events(spark, 5000, seed=2)).count() > 4000


def test_producers_count_their_own_ids(spark):
    events = generate.synthetic_events(spark, 999, producers=3)
    per = events.groupBy("producer").agg(F.count("*"), F.countDistinct("event_id"), F.max("event_id")).collect()
    assert sorted(tuple(r) for r in per) == [(0, 333, 333, 333), (1, 333, 333, 333), (2, 333, 333, 333)]


def test_records_carry_key_and_padding(spark):
    records = generate.events_to_kafka_records(generate.synthetic_events(spark, 100, payload_bytes=512))
    row = records.first()
    decoded = records.select("key", decode("value").alias("e")).select("key", "e.*").first()
    assert len(row.value) > 512 and row.key == str(decoded.user_id) and decoded.event_id is not None
    assert transform.transform_events(records).count() > 0


def test_stream_of_events(spark, tmp_path):
    stream = generate.synthetic_event_stream(spark, rows_per_second=200)
    assert stream.isStreaming
    query = (stream.writeStream.format("memory").queryName("generated").outputMode("append")
             .option("checkpointLocation", str(tmp_path)).start())
    import time

    end = time.time() + 20
    while time.time() < end and not spark.table("generated").limit(1).count():
        time.sleep(0.5)
    query.stop()
    row = spark.table("generated").first()
    assert row is not None and row.ts > 1.7e9
