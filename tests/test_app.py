"""The commands for ``spark-submit``, from load to tables."""

import argparse
import json
import os
import subprocess
import sys

import pytest

from tidemark import app
from tidemark.contract import RUN_SUMMARY
from tidemark.sources import runs, topic

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_places():
    assert app.Place.parse("topic:/a/b") == app.Place("topic", "/a/b")
    assert app.Place.parse("kafka:h1:9092,h2:9092/name").broker() == ("h1:9092,h2:9092", "name")
    assert app.Place.parse("files:file:///x").path == "file:///x"
    for bad in ("", "topic:", "kafka:broker", "ftp:/x", "/x"):
        with pytest.raises(argparse.ArgumentTypeError):
            app.Place.parse(bad)


def test_from_load_to_tables(spark, tmp_path, capsys):
    start, end, results = f"topic:{tmp_path}/in", f"topic:{tmp_path}/out", f"{tmp_path}/results"
    assert app.run(spark, ["load", "--target", start, "--rate", "100", "--seconds", "30", "--payload-bytes", "10", "--partitions", "2"]) == 0
    assert topic.topic_source(spark, f"{tmp_path}/in").count() == 3000
    assert app.run(spark, ["transform", "--source", start, "--target", end, "--checkpoint", f"{tmp_path}/c1", "--max-rows", "1000", "--drain"]) == 0
    sent = topic.topic_source(spark, f"{tmp_path}/out").count()
    assert 900 < sent < 1100
    measure = ["measure", "--source", end, "--engine", "run-p6", "--out", results, "--checkpoint", f"{tmp_path}/c2", "--drain", "--seconds", "4000", "--warmup", "0"]
    assert app.run(spark, measure) == 0
    (summary,) = runs.read_summaries(spark, f"{results}/*_summary.json").collect()
    assert (summary.label, summary.seen_records, summary.kept_records) == ("run-p6", sent, sent) and summary.e2e_ms["p50"] > summary.pipeline_ms["p50"] > 0
    kept = spark.read.option("header", True).csv(f"{results}/run-p6_latency.csv")
    assert kept.count() == sent and "recv_ts" in kept.columns
    capsys.readouterr()
    (tmp_path / "results" / "old_consumer.log").write_text("line\n" + json.dumps({f: None for f in RUN_SUMMARY.fieldNames()} | {"kept_records": 7, "engine": "x"}) + "\nend")
    (tmp_path / "results" / "old_lag.txt").write_text("1 100 10\n11 1100 310\nbad\n")
    (tmp_path / "results" / "old_top.txt").write_text("1 spark rtm-bench-driver 500m 1000Mi\n")
    assert app.run(spark, ["analyse", "--results", results, "old", "run-p6", "none"]) == 0
    told = capsys.readouterr().out
    rows = [[c.strip() for c in line.split("|")[1:-1]] for line in told.splitlines() if line.startswith("|")]
    named = {r[0]: r for r in rows}
    assert "run-p6" in named and named["old"][:3] == ["old", "0.5", "0.5"]
    assert [r for r in rows if "old" in r and "7" in r] and [r for r in rows if "run-p6" in r and str(sent) in r]
    assert app.run(spark, ["analyse", "--results", results]) == 0 and "run-p6" in capsys.readouterr().out


def test_files_in_and_out(spark, tmp_path):
    assert app.run(spark, ["load", "--target", f"files:{tmp_path}/in", "--rate", "10", "--seconds", "5", "--producers", "2"]) == 0
    transform = ["transform", "--source", f"files:{tmp_path}/in", "--target", f"files:{tmp_path}/out", "--checkpoint", f"{tmp_path}/c", "--drain"]
    assert app.run(spark, transform) == 0 and 0 < spark.read.parquet(f"{tmp_path}/out").count() < 50
    measure = ["measure", "--source", f"files:{tmp_path}/out", "--engine", "r", "--out", f"{tmp_path}/results", "--checkpoint", f"{tmp_path}/c2", "--drain", "--warmup", "100"]
    assert app.run(spark, measure) == 2  # all of it is warm-up


def test_what_cannot_be_started(spark, tmp_path):
    with pytest.raises(ValueError, match="own time"):
        app.run(spark, ["measure", "--source", f"files:{ROOT}/tests", "--engine", "r", "--out", "x", "--checkpoint", "y", "--clock", "record"])
    with pytest.raises(ValueError, match="micro-batches"):
        app.run(spark, ["transform", "--source", f"files:{ROOT}/tests", "--target", "topic:/x", "--checkpoint", "y", "--mode", "rtm"])
    with pytest.raises(SystemExit):
        app.run(spark, ["measure", "--engine", "r"])


def test_started_as_a_file():
    told = subprocess.run([sys.executable, os.path.join(ROOT, "tidemark", "app.py"), "--help"], capture_output=True, text=True, timeout=120, check=True)
    assert "transform" in told.stdout and "analyse" in told.stdout
