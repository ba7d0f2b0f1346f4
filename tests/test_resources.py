"""Usage, cost and backlog on hand-written samples in the published formats."""

import pytest

from tidemark.operators import resources as R
from tidemark.sources import runs

STATS = """epoch,container,cpu_pct,mem_used_mb,mem_pct
100,worker-1,38.50,400.0,1.0
101,worker-1,38.50,401.0,1.0
100,worker-2,150.00,99.5,1.0
101,worker-2,50.00,100.5,1.0
101,worker-2,--,100.5,1.0
100,my-kafka-0,900.00,5000.0,9.0
"""

PODS = """100 flink flink-bench-jm-1   18m   492Mi
100 flink flink-bench-tm-1-1                 20m   1Gi
  101\tflink flink-bench-jm-1   1000m   500Mi   extra
101 kafka flink-bench-broker 1m 1Mi
101 spark spark-operator 1m 16Mi
101 spark rtm-pyspark-measured-exec-1 500m 2048Mi
102 flink flink-bench-jm-1
102 flink flink-bench-jm-1 x 5Mi
102 flink flink-bench-jm-1 5m none

"""

OFFSETS = """1000 100 50
1010 1100 383
1020 2100 600
bad line here
1030 2100 700 9
1030 3100 1049
"""


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_normalise_usage(spark):
    rows = [("12.3%", "123.4MiB / 2GiB", "0.5%"), ("0%", "1.5GiB / 8GiB", "1%"), ("5%", "512KiB / 1GiB", "1%"),
            ("5%", "77 / 100", "1%"), ("5%", "1.0625GiB / 2GiB", "1%"), ("x", "none", "1%")]
    got = R.normalise_usage(spark.createDataFrame(rows, "cpu string, mem string, mem_share string")).collect()
    assert [(r.cpu_pct, r.mem_used_mb) for r in got] == [
        (12.3, 123.4), (0.0, 1536.0), (5.0, 0.5), (5.0, 77.0), (5.0, 1088.0), (None, None)]
    assert got[0].mem_pct == 0.5


def test_container_and_engine_usage(spark, tmp_path):
    stats = runs.read_container_stats(spark, write(tmp_path, "fast-engine_stats.csv", STATS))
    usage = {r.container: tuple(r)[2:] for r in R.container_usage(stats).collect()}
    # 0.385 lies above the tie as a double, 400.5 and 100.0 are exact: ties go to even.
    assert usage["worker-1"] == (0.39, 0.39, 400.0, 401.0)
    assert usage["worker-2"] == (1.0, 1.5, 100.0, 100.0)
    totals = R.engine_usage_totals(R.container_usage(stats)).first()
    assert tuple(totals) == ("fast-engine", 1.39, 1.89, 500.0, 501.0)


def test_engine_with_shared_containers_only_has_zero_totals(spark):
    usage = spark.createDataFrame([("e", "kafka", 1.0, 2.0, 3.0, 4.0)], "engine string, container string, mean_cpu_cores double, "
                                  "peak_cpu_cores double, mean_mem_mb double, peak_mem_mb double")
    assert tuple(R.engine_usage_totals(usage).first()) == ("e", 0.0, 0.0, 0.0, 0.0)
    assert R.engine_usage_totals(usage, exclude=()).first().cpu_mean == 1.0


def test_pod_usage(spark, tmp_path):
    samples = runs.read_pod_samples(spark, write(tmp_path, "run-p6_top.txt", PODS))
    row = R.pod_usage(samples).first()
    # Instant 100 sums two pods (38 m, 1516 MiB), instant 101 has one (1000 m, 500 MiB).
    assert tuple(row) == ("run-p6", 2, 0.52, 1.0, 1008, 1516)
    full = R.pod_usage_full_match(samples).first()
    assert (full.mean_cpu, full.peak_cpu, full.peak_mem_gb) == (0.769, 1.5, 2548 / 1024)
    assert R.pod_usage(samples, patterns=("nothing",)).count() == 0


def test_peaks_differ_by_definition(spark, tmp_path):
    """Containers: sum of peaks. Pods: peak of sums."""
    stats = "epoch,container,cpu_pct,mem_used_mb,mem_pct\n1,a,100,1,1\n2,a,0,1,1\n1,b,0,1,1\n2,b,100,1,1\n"
    totals = R.engine_usage_totals(R.container_usage(runs.read_container_stats(spark, write(tmp_path, "e_stats.csv", stats))))
    pods = ("1 spark rtm-bench-a 1000m 1Mi\n2 spark rtm-bench-a 0m 1Mi\n"
            "1 spark rtm-bench-b 0m 1Mi\n2 spark rtm-bench-b 1000m 1Mi\n")
    usage = R.pod_usage(runs.read_pod_samples(spark, write(tmp_path, "e_top.txt", pods)))
    assert totals.first().cpu_peak == 2.0 and usage.first().peak_cpu_cores == 1.0


def test_cost(spark):
    totals = spark.createDataFrame([("a", 1.79, 5.08, 2449.0, 2653.0), ("idle", 0.0, 0.0, 0.0, 0.0), ("none", 2.0, 2.0, 1.0, 1.0)],
                                   "engine string, cpu_mean double, cpu_peak double, mem_mean double, mem_peak double")
    summary = spark.createDataFrame([("a", 3334.5), ("idle", 0.0), ("lost", 5.0)], "engine string, throughput_eps double")
    got = {r.engine: r for r in R.cost_estimate(totals, summary).collect()}
    assert set(got) == {"a", "idle"}
    assert round(got["a"].usd_per_hour, 4) == 0.0859 and round(got["a"].usd_per_billion, 2) == 7.16
    assert got["a"].mem_gb == 2449 / 1024
    assert got["idle"].vcpu == 0.1 and got["idle"].usd_per_billion == pytest.approx(0.1 * 0.048 / 3600 * 1e9)
    assert R.cost_estimate(totals, summary, rate=0.1).filter("engine = 'a'").first().usd_per_hour == pytest.approx(0.179)


def test_backlog(spark, tmp_path):
    samples = runs.read_offset_samples(spark, write(tmp_path, "run_lag.txt", OFFSETS))
    assert samples.count() == 4
    row = R.topic_backlog(samples).first()
    assert tuple(row) == ("run", round(2000 - 550 / 0.333), round(3000 - 999 / 0.333), 100, round(999 / 30))
    halved = R.topic_backlog(samples, filter_pass=0.5).first()
    assert halved.max_backlog == round(3000 - 999 / 0.5)


def test_backlog_agrees_with_its_definition(spark):
    import random

    rng = random.Random(2)
    rows, ends = [], [0, 0]
    for t in range(500):
        rows.append(("r", t, ends[0], ends[1]))
        ends = [ends[0] + rng.randrange(2000), ends[1] + rng.randrange(700)]
    row = R.topic_backlog(spark.createDataFrame(rows, "label string, ts long, in_end long, out_end long").repartition(4)).first()
    held = [i - o / 0.333 for _, _, i, o in rows]
    assert (row.max_backlog, row.final_backlog) == (round(max(held)), round(held[-1]))


@pytest.mark.parametrize("rate", [1 / 3, 0.4, 0.3333333333333333, 1e-7])
def test_backlog_at_any_pass_rate(spark, rate):
    rows = [("r", 1, 0, 0), ("r", 2, 10**9, 333333183)]
    row = R.topic_backlog(spark.createDataFrame(rows, "label string, ts long, in_end long, out_end long"), rate).first()
    final = round(10**9 - 333333183 / rate)
    assert (row.max_backlog, row.final_backlog) == (max(0, final), final)


def test_backlog_needs_two_samples_and_survives_one_instant(spark):
    schema = "label string, ts long, in_end long, out_end long"
    assert R.topic_backlog(spark.createDataFrame([("r", 1, 1, 1)], schema)).count() == 0
    row = R.topic_backlog(spark.createDataFrame([("r", 1, 0, 0), ("r", 1, 10, 3)], schema)).first()
    assert (row.in_rate, row.out_rate) == (10, 3)


def test_pass_rate_counts_nulls_as_dropped(spark):
    df = spark.createDataFrame([("purchase", 1.0), ("view", 1.0), ("add_to_cart", None), ("purchase", 0.0)], "event_type string, amount double")
    assert tuple(R.filter_pass_rate(df).first()) == (4, 1, 0.25)
