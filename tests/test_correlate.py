import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowspark.operators import correlate
from flowspark.operators.correlate import COUNTS, ScanRule
from flowspark.plans.correlate_files import correlate_files

SCHEMA = ("InputFile string, SourceIP string, DestinationIP string, Timestamp timestamp, DestinationPort int, SYNCount double, "
          "RSTCount double, BackwardPackets double, Scenario string, GroundTruth string, RowID long")
START = dt.datetime(2024, 1, 1)


def make(n=1500, seconds=400, seed=1):
    rng = random.Random(seed)
    return [("f", rng.choice(["a", "b", "hot", "hot", "hot"]), rng.choice("xy"), START + dt.timedelta(seconds=rng.randrange(seconds)),
             rng.randrange(30), float(rng.random() < 0.7), float(rng.random() < 0.3), float(rng.choice([0, 3])), "sc", "gt", i)
            for i in range(n)]


def brute(rows, seconds):
    sources, expected = defaultdict(list), {}
    for r in rows:
        sources[r[:2]].append(r)
    for flows in sources.values():
        flows.sort(key=lambda r: (r[3], r[10]))
        for n, r in enumerate(flows):
            w = [x for x in flows[:n + 1] if x[3] >= r[3] - dt.timedelta(seconds=seconds)]
            expected[r[10]] = (len(w), len({x[4] for x in w}), len({(x[2], x[4]) for x in w}), sum(x[5] > 0 for x in w),
                               sum(x[6] > 0 for x in w), sum(x[7] <= 0 for x in w))
    return expected


def counts(df):
    return {r["RowID"]: tuple(r[c] for c in COUNTS) for r in df.collect()}


@pytest.mark.parametrize("rule", [ScanRule(10, 6, 5), ScanRule(10, 6, 5, slice_seconds=3), ScanRule(0.5, 6, 5)])
@pytest.mark.parametrize("seconds", [400, 1])
def test_rolling_counts_against_brute_force(spark, rule, seconds):
    rows = make(1500 if seconds > 1 else 600, seconds)
    rolled = correlate.rolling_source_counts(spark.createDataFrame(rows, SCHEMA), rule)
    assert counts(rolled) == brute(rows, rule.window_seconds)


def test_one_instant_is_cut_over_partitions(spark):
    rows = [("f", "hot", "x", START, k % 50, 1.0, 0.0, 0.0, "s", "g", k) for k in range(900)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert counts(correlate.rolling_source_counts(spark.createDataFrame(rows, SCHEMA).repartition(6), ScanRule())) == brute(rows, 10)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_oversized_ports_are_counted_as_invalid(spark):
    flows = spark.createDataFrame([("a", "b", START, "99999999999"), ("a", "b", START, "80")],
                                  "SourceIP string, DestinationIP string, Timestamp timestamp, DestinationPort string")
    with pytest.raises(ValueError, match="1 rows have invalid destination ports"):
        correlate.prepare_flows(flows.withColumn("SYNCount", F.lit(1.0)), F.lit("f"), F.lit("s"))


def test_flow_exactly_one_window_old_counts(spark):
    rows = [("f", "a", "x", START + dt.timedelta(seconds=s), p, 1.0, 0.0, 0.0, "s", "g", i)
            for i, (s, p) in enumerate([(0, 1), (10, 2), (21, 3)])]
    assert {k: v[:2] for k, v in counts(correlate.rolling_source_counts(spark.createDataFrame(rows, SCHEMA), ScanRule(10))).items()} == {
        0: (1, 1), 1: (2, 2), 2: (1, 1)}


def test_alert_fires_at_twentieth_tied_flow(spark):
    rows = [("scan.csv", "10.0.0.1", "10.0.0.2", START, 100 + i, 1.0, 1.0, 1.0, "scan", "PORT SCAN", i) for i in range(25)]
    rows += [("scan.csv", "10.0.0.9", "10.0.0.2", START, 80, 1.0, 0.0, 1.0, "scan", "PORT SCAN", 99)]
    summary, alerts = correlate.correlate(spark.createDataFrame(rows, SCHEMA))
    found = alerts.collect()
    assert len(found) == 1 and len(alerts.columns) == 22 and len(summary.columns) == 26
    alert = found[0]
    assert alert["TriggerRowID"] == 19 and alert["WindowFlowCount"] == 20 and alert["TriggerDestinationPort"] == 119
    assert alert["AlertTimestamp"] == "2024-01-01T00:00:00+00:00"
    assert alert["Reason"] == ("At least 20 SYN-bearing flows reached at least 20 unique destination ports within 10 seconds.")
    verdicts = {r["SourceIP"]: r for r in summary.collect()}
    assert verdicts["10.0.0.1"]["MITREGroundTruth"] == "T1595 - Active Scanning" and verdicts["10.0.0.1"]["AverageFlowsPerSecond"] == 25.0
    assert verdicts["10.0.0.9"]["Detection"] == "NO_SCAN_PATTERN" and not verdicts["10.0.0.9"]["CrossFlowScanFlag"]


def test_no_alert_keeps_schema(spark):
    _, alerts = correlate.correlate(spark.createDataFrame(make(20), SCHEMA))
    assert alerts.count() == 0 and len(alerts.columns) == 22


def test_published_benign_capture(spark, tmp_path):
    path = tmp_path / "benign_baseline_dashboard.csv"
    times = ["42", "45", "48", "52", "55"]
    lines = [f"{i},benign_baseline,BENIGN,192.168.244.10,192.168.244.20,2026-08-14 10:55:{s},8000.0,3.0,0.0,9.0,5.0" for i, s in enumerate(times)]
    path.write_text("RowID,Scenario,GroundTruth,SourceIP,DestinationIP,Timestamp,Destination Port,SYN Flag Count,RST Flag Count,"
                    "ACK Flag Count,Total Backward Packets\n" + "\n".join(lines) + "\n")
    summary, alerts = correlate_files(spark, [str(path)])
    row = summary.first()
    assert row["InputFile"] == path.name and row["Scenario"] == "benign_baseline" and row["TotalFlows"] == 5
    assert row["FirstTimestamp"] == "2026-08-14T10:55:42+00:00" and row["LastTimestamp"] == "2026-08-14T10:55:55+00:00"
    assert row["DurationSeconds"] == 13.0 and row["AverageFlowsPerSecond"] == pytest.approx(0.38461538461538464)
    assert row["MaxFlowsInWindow"] == 4 and row["TotalSYNFlows"] == 5 and alerts.count() == 0


def test_aliases_and_defaults(spark):
    df = spark.createDataFrame([("a", "b", "2024-01-01 00:00:00", "80")], "src_ip string, dst_ip string, timestamp string, dst_port string")
    row = correlate.prepare_flows(df, F.lit("x.csv"), F.lit("x")).first()
    assert row["SYNCount"] == 0.0 and row["Scenario"] == "x" and row["GroundTruth"] == "UNKNOWN"
    with pytest.raises(ValueError, match="destination_port"):
        correlate.prepare_flows(df.drop("dst_port"), F.lit("x"), F.lit("x"))
    bad = df.withColumn("timestamp", F.lit("later"))
    with pytest.raises(ValueError, match="1 rows have invalid timestamps"):
        correlate.prepare_flows(bad, F.lit("x"), F.lit("x"))
    with pytest.raises(ValueError, match="invalid destination ports"):
        correlate.prepare_flows(df.withColumn("dst_port", F.lit("http")), F.lit("x"), F.lit("x"))
    nobody = correlate.prepare_flows(df.withColumn("src_ip", F.lit(None).cast("string")), F.lit("x"), F.lit("x"))
    assert nobody.first()["SourceIP"] == "MISSING"
