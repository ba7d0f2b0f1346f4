"""Recorded topics: offsets, bounded batches, restarts."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.numbering import number_rows
from tidemark.sources import topic
from tidemark.sources.topic import capped, ranges, record_topic, topic_source, topic_stream
from tidemark.streaming import execute


def records(spark, n, first=0):
    return spark.range(first, first + n).select(
        F.when(F.col("id") % 10 > 0, (F.col("id") % 7).cast("string")).alias("key"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"),
        F.timestamp_seconds(1_750_000_000 - F.col("id")).alias("timestamp"))


def test_number_rows(spark):
    rows = [("a", 3, "x"), ("a", None, "y"), (None, 1, "z"), ("a", 3, "w"), (None, 1, "z")] + [("hot", k % 5, str(k)) for k in range(500)]
    found = number_rows(spark.createDataFrame(rows, "g string, o int, v string").repartition(7), ["g"], ["o"]).collect()
    assert sorted(((r.g, r.o, r.v) for r in found), key=str) == sorted(rows, key=str)
    for g in ("a", None, "hot"):
        mine = sorted((r.position, r.o) for r in found if r.g == g)
        assert [p for p, _ in mine] == list(range(len(mine)))
        assert [o for _, o in mine] == sorted((o for _, o in mine), key=lambda o: (o is not None, o))
    assert number_rows(spark.createDataFrame([], "g string, o int"), ["g"], ["o"]).collect() == []


def test_a_hot_group_is_numbered_by_many_tasks(spark):
    one = spark.range(0, 20_000, 1, 8).select(F.lit("hot").alias("g"), F.lit(0).alias("o"), "id")
    found = number_rows(one, ["g"], ["o"])
    assert found.agg(F.countDistinct("position"), F.max("position")).first()[:] == (20_000, 19_999)


def test_offsets_are_whole_and_in_order(spark, tmp_path):
    path = str(tmp_path / "topic")
    record_topic(records(spark, 300), path, partitions=4, segment_rows=16)
    record_topic(records(spark, 100, 300), path, partitions=4, segment_rows=16)
    read = topic_source(spark, path, rows_per_task=7).collect()
    assert sorted(r.value for r in read) == sorted(f"v{k}" for k in range(400))
    for p in range(4):
        mine = sorted((r.offset, r.timestamp) for r in read if r.partition == p)
        assert [o for o, _ in mine] == list(range(len(mine)))
    by_key = {}
    for r in read:
        if r.key is not None:
            by_key.setdefault(r.key, set()).add(r.partition)
    assert all(len(p) == 1 for p in by_key.values()) and len(by_key) == 7
    first = [r for r in read if int(r.value[1:]) < 300]
    assert all(a.timestamp <= b.timestamp for p in range(4) for a, b in zip(*(lambda s: (s, s[1:]))(
        sorted((r for r in first if r.partition == p), key=lambda r: r.offset))))


def test_records_without_key_column_time_or_rows(spark, tmp_path):
    path = str(tmp_path / "topic")
    record_topic(spark.createDataFrame([(None, "a"), (None, None), ("k", "b")], "key string, value string"), path, partitions=2)
    assert {(r.key, r.value, r.timestamp) for r in topic_source(spark, path).collect()} == {(None, "a", None), (None, None, None), ("k", "b", None)}
    none = str(tmp_path / "none")
    record_topic(spark.createDataFrame([], "key string, value string"), none)
    assert topic_source(spark, none).collect() == [] and topic_source(spark, str(tmp_path / "absent")).collect() == []


def test_unfinished_recordings_are_not_seen(spark, tmp_path):
    path = tmp_path / "topic"
    record_topic(records(spark, 5), str(path))
    part = path / "index" / "unfinished"
    part.mkdir()
    (part / "part-0.json").write_text('{"partition":0,"file":"file:///nowhere","first":100,"last":200}\n')
    assert topic_source(spark, str(path)).count() == 5


def test_capped():
    ends = {"0": 100, "1": 10, "2": 1}
    assert capped({}, ends, None) == capped({}, ends, 111) == ends
    assert capped({}, ends, 11) == {"0": 9, "1": 1, "2": 1}  # nobody is left behind
    assert sum(capped({}, ends, 50).values()) == 50
    assert capped({"0": 100, "1": 10, "2": 0}, ends, 1) == ends
    at, steps = {}, 0
    while at != ends:
        after = capped(at, ends, 7)
        assert 0 < sum(after.values()) - sum(at.values()) <= 7 and all(after[p] <= ends[p] for p in ends)
        at, steps = after, steps + 1
    assert steps == 16
    assert capped({"0": 5}, {"0": 3}, 2) == {"0": 5}  # never backwards


def test_ranges_hold_every_offset_once():
    segments = [{"partition": 0, "first": 0, "last": 9, "file": "a"}, {"partition": 0, "first": 10, "last": 12, "file": "b"}]
    found = ranges(segments, {"0": 3}, {"0": 12}, 4)
    assert [(r.file, r.first, r.end) for r in found] == [("a", 3, 7), ("a", 7, 10), ("b", 10, 12)]
    assert ranges(segments, {"0": 5}, {"0": 5}, 4) == []


def test_batches_hold_no_more_rows_than_asked(spark, tmp_path):
    path, target, checkpoint = (str(tmp_path / n) for n in ("topic", "target", "checkpoint"))

    def taken(rows):
        stream = topic_stream(spark, path, rows, rows_per_task=20).select("key", "value")
        return [b["rows"] for b in execute.drain(execute.run_microbatch(stream, execute.file_sink(target), checkpoint)) if b["rows"]]

    record_topic(records(spark, 250), path, partitions=3)
    assert taken(100) == [100, 100, 50]
    record_topic(records(spark, 70, 250), path, partitions=3)
    assert taken(60) == [60, 10]  # goes on where the checkpoint ends
    assert taken(60) == []
    assert sorted(r.value for r in spark.read.parquet(target).collect()) == sorted(f"v{k}" for k in range(320))


def test_a_failed_batch_is_taken_again(spark, tmp_path):
    path, checkpoint = str(tmp_path / "topic"), str(tmp_path / "checkpoint")
    record_topic(records(spark, 90), path, partitions=3)
    got, failed = {}, []

    def write(batch, batch_id):
        rows = [r.value for r in batch.collect()]
        if batch_id == 1 and not failed:
            failed.append(rows)
            raise RuntimeError("lost")
        got[batch_id] = rows

    def start():
        return execute.run_batches(topic_stream(spark, path, 40), write, checkpoint)

    with pytest.raises(Exception, match="lost"):
        execute.drain(start())
    record_topic(records(spark, 10, 90), path, partitions=3)  # more records do not change the batch
    execute.drain(start())
    assert sorted(got[1]) == sorted(failed[0]) and all(len(rows) <= 40 for rows in got.values())
    assert sorted(v for rows in got.values() for v in rows) == sorted(f"v{k}" for k in range(100))


def test_latest_offsets_skip_what_is_there(spark, tmp_path):
    path, target, checkpoint = (str(tmp_path / n) for n in ("topic", "target", "checkpoint"))

    def run():
        stream = topic_stream(spark, path, starting_offsets="latest").select("key", "value")
        execute.drain(execute.run_microbatch(stream, execute.file_sink(target), checkpoint))

    record_topic(records(spark, 20), path)
    run()
    record_topic(records(spark, 5, 20), path)
    run()
    assert sorted(r.value for r in spark.read.schema("key string, value string").parquet(target).collect()) == [f"v{k}" for k in range(20, 25)]


@pytest.mark.parametrize("options", [{"max_rows": 0}, {"starting_offsets": "soon"}])
def test_bad_options(spark, tmp_path, options):
    path = str(tmp_path / "topic")
    record_topic(records(spark, 5), path)
    with pytest.raises(Exception, match="must be"):
        execute.drain(execute.run_microbatch(topic_stream(spark, path, **options).select("value"), execute.file_sink(str(tmp_path / "t")), str(tmp_path / "c")))
    with pytest.raises(ValueError):
        record_topic(records(spark, 5), path, partitions=0)


def test_paths():
    assert topic._located("/a/b")[1] == topic._located("file:/a/b")[1] == topic._located("file:///a/b")[1] == "/a/b"
