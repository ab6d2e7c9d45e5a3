"""Queries over the rolling source correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.operators import correlate
from flowspark.operators.correlate import ScanRule
from flowspark.plans.registry import query, r, rounded
from flowspark.plans.workload import flows, with_flows

DAY = 86_400
RULE = ScanRule(window_seconds=3.0 * DAY, minimum_unique_ports=5, minimum_syn_flows=5)


def _view(spark, sf, tied: bool = False):
    f = flows(spark, sf)
    time = F.date_trunc("day", "Timestamp") if tied else F.col("Timestamp")
    return f.select(
        F.lit("events").alias("InputFile"), "SourceIP", "DestinationIP", time.alias("Timestamp"), "DestinationPort",
        F.col("SYNCount").cast("double").alias("SYNCount"), F.col("RSTCount").cast("double").alias("RSTCount"),
        "BackwardPackets", "Scenario", F.when(F.col("BinaryLabel") == 1, "ATTACK").otherwise("BENIGN").alias("GroundTruth"),
        "RowID",
    )


def rolled_sql(tied: bool = False) -> str:
    time = """date_trunc('day', "Timestamp")""" if tied else '"Timestamp"'
    return f""",
v AS (SELECT "RowID" AS id, "SourceIP" AS src, "DestinationIP" AS dst, "DestinationPort" AS port, epoch_us({time}) AS us,
  "SYNCount" AS syn, "RSTCount" AS rst, "BackwardPackets" AS back, "Scenario" AS scenario,
  CASE WHEN "BinaryLabel" = 1 THEN 'ATTACK' ELSE 'BENIGN' END AS truth FROM flows),
rolled AS (SELECT a.src, a.id, a.us, a.dst, a.port, a.scenario, a.truth, a.syn, a.rst, a.back, count(*) AS flow_count,
  count(DISTINCT b.port) AS ports, count(DISTINCT b.dst || '|' || CAST(b.port AS VARCHAR)) AS endpoints,
  count(*) FILTER (b.syn > 0) AS syn_flows, count(*) FILTER (b.rst > 0) AS rst_flows, count(*) FILTER (b.back <= 0) AS silent_flows
  FROM v a JOIN v b ON a.src = b.src AND b.us >= a.us - {3 * DAY * 1_000_000} AND (b.us < a.us OR (b.us = a.us AND b.id <= a.id))
  GROUP BY ALL)"""


ROWS_SQL = "SELECT id AS row_id, src AS source, flow_count, ports, endpoints, syn_flows, rst_flows, silent_flows FROM rolled"
NAMES = dict(zip(correlate.COUNTS, ["flow_count", "ports", "endpoints", "syn_flows", "rst_flows", "silent_flows"]))


def _rows(rolled):
    return rolled.select(F.col("RowID").alias("row_id"), F.col("SourceIP").alias("source"),
                         *[F.col(c).alias(n) for c, n in NAMES.items()])


@query("rolling_source_counts", with_flows(rolled_sql() + ROWS_SQL))
def rolling_source_counts(spark, sf):
    return _rows(correlate.rolling_source_counts(_view(spark, sf), RULE))


@query("rolling_source_counts_tied", with_flows(rolled_sql(True) + ROWS_SQL))
def rolling_source_counts_tied(spark, sf):
    return _rows(correlate.rolling_source_counts(_view(spark, sf, tied=True), RULE))


ISO = """strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%S') ||
  CASE WHEN {0} % 1000000 <> 0 THEN '.' || lpad(CAST({0} % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00'"""
HEADS = """, heads AS (SELECT src, scenario, truth FROM (SELECT src, scenario, truth, row_number() OVER (PARTITION BY src ORDER BY us, id) AS k FROM v) WHERE k = 1)"""


@query("scan_alerts", with_flows(rolled_sql() + HEADS + f"""
SELECT {ISO.format('us')} AS "AlertTimestamp", a.src AS "SourceIP", dst AS "DestinationIP", CAST({3 * DAY} AS DOUBLE) AS "WindowSeconds",
  flow_count AS "WindowFlowCount", ports AS "WindowUniqueDestinationPorts", endpoints AS "WindowUniqueDestinationEndpoints",
  syn_flows AS "WindowSYNFlows", rst_flows AS "WindowRSTFlows", silent_flows AS "WindowNoResponseFlows",
  port AS "TriggerDestinationPort", id AS "TriggerRowID", 'Cross-flow behavioral correlation' AS "Detector", 'PORT_SCAN' AS "Detection",
  'High' AS "Severity", 'Reconnaissance' AS "MITRETactic", 'T1595' AS "MITRETechniqueID", 'Active Scanning' AS "MITRETechniqueName",
  'At least 5 SYN-bearing flows reached at least 5 unique destination ports within 259200 seconds.' AS "Reason",
  'events' AS "InputFile", h.scenario AS "Scenario", h.truth AS "GroundTruth"
FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY us, id) AS k FROM rolled WHERE ports >= 5 AND syn_flows >= 5) a
JOIN heads h ON h.src = a.src WHERE k = 1"""))
def scan_alerts(spark, sf):
    return correlate.correlate(_view(spark, sf), RULE)[1]


@query("source_summary", with_flows(rolled_sql() + HEADS + f"""
SELECT 'events' AS "InputFile", h.scenario AS "Scenario", h.truth AS "GroundTruth", a.src AS "SourceIP",
  {ISO.format('lo')} AS "FirstTimestamp", {ISO.format('hi')} AS "LastTimestamp", {r('(hi - lo) / 1000000.0', 'DurationSeconds')},
  n AS "TotalFlows", up AS "TotalUniqueDestinationPorts", ue AS "TotalUniqueDestinationEndpoints", ts AS "TotalSYNFlows",
  tr AS "TotalRSTFlows", tn AS "TotalNoResponseFlows",
  {r('CASE WHEN hi > lo THEN n / ((hi - lo) / 1000000.0) ELSE n END', 'AverageFlowsPerSecond')}, CAST({3 * DAY} AS DOUBLE) AS "WindowSeconds",
  mf AS "MaxFlowsInWindow", mp AS "MaxUniqueDestinationPortsInWindow", me AS "MaxUniqueDestinationEndpointsInWindow",
  ms AS "MaxSYNFlowsInWindow", mr AS "MaxRSTFlowsInWindow", mn AS "MaxNoResponseFlowsInWindow", 5 AS "MinimumUniquePortsThreshold",
  5 AS "MinimumSYNFlowsThreshold", hit AS "CrossFlowScanFlag", CASE WHEN hit THEN 'PORT_SCAN' ELSE 'NO_SCAN_PATTERN' END AS "Detection",
  CASE WHEN hit THEN 'T1595 - Active Scanning' ELSE '' END AS "MITREGroundTruth"
FROM (SELECT src, min(us) AS lo, max(us) AS hi, count(*) AS n, count(DISTINCT port) AS up,
  count(DISTINCT dst || '|' || CAST(port AS VARCHAR)) AS ue, count(*) FILTER (syn > 0) AS ts, count(*) FILTER (rst > 0) AS tr,
  count(*) FILTER (back <= 0) AS tn, max(flow_count) AS mf, max(ports) AS mp, max(endpoints) AS me, max(syn_flows) AS ms,
  max(rst_flows) AS mr, max(silent_flows) AS mn, bool_or(ports >= 5 AND syn_flows >= 5) AS hit FROM rolled GROUP BY 1) a
JOIN heads h ON h.src = a.src"""))
def source_summary(spark, sf):
    return rounded(correlate.correlate(_view(spark, sf), RULE)[0], "DurationSeconds", "AverageFlowsPerSecond")


@query("correlation_view", with_flows("""
SELECT "RowID" AS row_id, coalesce("SourceIP", 'MISSING') AS source, "DestinationIP" AS target, epoch_us("Timestamp") AS us,
  "DestinationPort" AS port, CAST("SYNCount" AS DOUBLE) AS syn, 0.0::DOUBLE AS ack, "Scenario" AS scenario, 'UNKNOWN' AS truth FROM flows"""))
def correlation_view(spark, sf):
    f = flows(spark, sf).select(
        "RowID", F.col("SourceIP").alias("src_ip"), F.col("DestinationIP").alias("dst_ip"), F.col("Timestamp").alias("timestamp"),
        F.col("DestinationPort").cast("string").alias("dst_port"), F.col("SYNCount").cast("string").alias("syn_flag_cnt"), "Scenario")
    view = correlate.prepare_flows(f, F.lit("events"), F.lit("none"))
    return view.select(
        F.col("RowID").alias("row_id"), F.col("SourceIP").alias("source"), F.col("DestinationIP").alias("target"),
        F.unix_micros("Timestamp").alias("us"), F.col("DestinationPort").alias("port"), F.col("SYNCount").alias("syn"),
        F.col("ACKCount").alias("ack"), F.col("Scenario").alias("scenario"), F.col("GroundTruth").alias("truth"))
