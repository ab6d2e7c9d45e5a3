"""Queries over detector fusion, enrichment and analyst reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.operators import scoring, soc
from flowspark.plans import catalog_correlate
from flowspark.plans.registry import query, r, rounded
from flowspark.plans.workload import flows, table, with_flows
from flowspark.sources import lookups
from flowspark.techniques import TECHNIQUES, default_techniques

BINARY, ANOMALY = 0.5, 0.9


def scored(spark, sf):
    f = flows(spark, sf)
    return f.select(
        "RowID", "Scenario", "SourceIP", "Timestamp", "Label", "BinaryLabel", F.col("Score").alias("KnownAttackProbability"),
        F.col("FamilyGuess").alias("_family"), (F.col("Score") / 2 + 0.5).alias("_confidence"), "AnomalyScore",
    )


def ledger(spark, sf):
    return scoring.finish_ledger(scored(spark, sf), default_techniques(spark), BINARY, ANOMALY)


def _case(values: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


IDS = {f: "; ".join(i for i, _ in t) for f, (_, t, _) in TECHNIQUES.items()}
LABELS = {f: "; ".join(n for _, n in t) for f, (_, t, _) in TECHNIQUES.items()}
TACTICS = {f: tactic for f, (tactic, _, _) in TECHNIQUES.items()}
LEDGER_SQL = f""",
fused AS (SELECT *, "Score" >= {BINARY} AS known, "AnomalyScore" >= {ANOMALY} AS odd FROM flows),
entries AS (SELECT *, CASE WHEN known THEN CASE WHEN "FamilyGuess" = 'Mystery Family' THEN 'Other Malicious' ELSE "FamilyGuess" END
  WHEN odd THEN 'Anomalous / Unmapped' ELSE 'BENIGN' END AS entry,
  CASE WHEN known AND odd THEN 'Critical' WHEN known THEN 'High' WHEN odd THEN 'Medium' ELSE 'Low' END AS severity FROM fused),
ledger AS (SELECT "RowID" AS row_id, "SourceIP" AS source, "Score" AS probability, CASE WHEN known THEN 'ATTACK' ELSE 'BENIGN' END AS prediction,
  CASE WHEN known THEN "FamilyGuess" ELSE 'Not run' END AS family, {r('CASE WHEN known THEN "Score" / 2 + 0.5 END', 'confidence')},
  {r(f'"AnomalyScore" - {ANOMALY}', 'margin')}, odd AS anomaly, severity,
  {_case(TACTICS, 'entry')} AS tactic, {_case(IDS, 'entry')} AS technique, {_case(LABELS, 'entry')} AS technique_name,
  "BinaryLabel" = CASE WHEN known THEN 1 ELSE 0 END AS correct, "Scenario" AS scenario, "BinaryLabel" AS binary_label FROM entries)
"""


@query("prediction_ledger", with_flows(LEDGER_SQL + """
SELECT row_id, source, probability, prediction, family, confidence, margin, anomaly, severity, tactic, technique, technique_name, correct FROM ledger"""))
def prediction_ledger(spark, sf):
    found = ledger(spark, sf).select(
        F.col("RowID").alias("row_id"), F.col("SourceIP").alias("source"), F.col("KnownAttackProbability").alias("probability"),
        F.col("BinaryPrediction").alias("prediction"), F.col("PredictedAttackFamily").alias("family"),
        F.col("FamilyConfidence").alias("confidence"), F.col("AnomalyMargin").alias("margin"), F.col("AnomalyFlag").alias("anomaly"),
        F.col("AlertSeverity").alias("severity"), F.col("MITRETactic").alias("tactic"), F.col("MITRETechniqueID").alias("technique"),
        F.col("MITRETechniqueName").alias("technique_name"), F.col("BinaryCorrect").alias("correct"))
    return rounded(found, "confidence", "margin")


@query("key_figures", with_flows(LEDGER_SQL + """
SELECT count(*) AS flows_analyzed, count(*) FILTER (prediction = 'ATTACK') AS known_attacks, count(*) FILTER (anomaly) AS anomaly_flags,
  count(*) FILTER (severity IN ('Critical', 'High')) AS critical_or_high, count(*) FILTER (severity = 'Medium') AS anomaly_only FROM ledger"""))
def key_figures(spark, sf):
    return soc.key_figures(ledger(spark, sf))


@query("severity_counts", with_flows(LEDGER_SQL + """
SELECT s.position, s.severity, count(l.row_id) AS flow_count FROM (VALUES (0, 'Critical'), (1, 'High'), (2, 'Medium'), (3, 'Low')) s(position, severity)
LEFT JOIN ledger l ON l.severity = s.severity GROUP BY 1, 2"""))
def severity_counts(spark, sf):
    return soc.severity_counts(ledger(spark, sf)).withColumnsRenamed({"AlertSeverity": "severity", "flows": "flow_count"})


@query("family_counts", with_flows(LEDGER_SQL + """
SELECT family, count(*) AS flow_count FROM ledger WHERE prediction = 'ATTACK' GROUP BY 1"""))
def family_counts(spark, sf):
    return soc.family_counts(ledger(spark, sf)).withColumnsRenamed({"PredictedAttackFamily": "family", "flows": "flow_count"})


@query("top_sources", with_flows(LEDGER_SQL + """
SELECT source, count(*) AS alerts FROM ledger WHERE severity <> 'Low' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"""))
def top_sources(spark, sf):
    return soc.top_sources(ledger(spark, sf))


@query("technique_counts", with_flows(LEDGER_SQL + """
SELECT technique, count(*) AS flow_count FROM ledger WHERE technique <> '' GROUP BY 1"""))
def technique_counts(spark, sf):
    return soc.technique_counts(ledger(spark, sf)).withColumnsRenamed({"MITRETechniqueID": "technique", "flows": "flow_count"})


@query("alert_queue", with_flows(LEDGER_SQL + f"""
SELECT row_id, severity, probability, {r('margin', 'margin')}, technique FROM ledger WHERE severity <> 'Low'
ORDER BY CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 ELSE 2 END, probability DESC, margin DESC, row_id LIMIT {soc.QUEUE_LIMIT}"""))
def alert_queue(spark, sf):
    rows = rounded(ledger(spark, sf), "AnomalyMargin")
    found = soc.alert_queue(rows).select(
        F.col("RowID").alias("row_id"), F.col("AlertSeverity").alias("severity"), F.col("KnownAttackProbability").alias("probability"),
        F.col("AnomalyMargin").alias("margin"), F.col("MITRETechniqueID").alias("technique"))
    return found


@query("run_summary", with_flows(LEDGER_SQL + """
SELECT scenario, count(*) AS row_count, count(*) FILTER (prediction = 'ATTACK') AS known_attack_alerts,
  count(*) FILTER (anomaly) AS anomaly_alerts, count(*) FILTER (severity IN ('Critical', 'High')) AS critical_or_high_alerts FROM ledger GROUP BY 1"""))
def run_summary(spark, sf):
    return soc.run_summary(ledger(spark, sf), ["Scenario"]).withColumnsRenamed({"Scenario": "scenario", "rows": "row_count"})


@query("error_ledger", with_flows(LEDGER_SQL + "SELECT scenario, row_id, prediction, binary_label FROM ledger WHERE NOT correct"))
def error_ledger(spark, sf):
    return scoring.error_ledger(ledger(spark, sf), "BinaryCorrect").select(
        F.col("Scenario").alias("scenario"), F.col("RowID").alias("row_id"), F.col("BinaryPrediction").alias("prediction"),
        F.col("BinaryLabel").alias("binary_label"))


@query("benign_counts", with_flows("""
SELECT "Scenario" AS scenario, count(*) FILTER ("BinaryLabel" = 0) AS benign_rows FROM flows GROUP BY 1"""))
def benign_counts(spark, sf):
    return soc.benign_counts(flows(spark, sf)).withColumnRenamed("Scenario", "scenario")


def sensor_alerts(spark, sf):
    e = table(spark, sf, "events")
    return e.where(F.col("event_type") == "error").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+0000'").alias("timestamp"), F.col("event_id").alias("flow_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src_ip"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("dest_port"),
        F.concat(F.lit("SIG "), (F.col("user_id") % 7).cast("string")).alias("signature"),
    )


@query("signature_counts", """
SELECT 'SIG ' || CAST(user_id % 7 AS VARCHAR) AS signature, count(*) AS alerts FROM events WHERE event_type = 'error' GROUP BY 1""")
def signature_counts(spark, sf):
    return lookups.signature_counts(sensor_alerts(spark, sf))


@query("technique_usage", with_flows(LEDGER_SQL + f"""
SELECT technique_id, count(*) AS flow_count FROM (SELECT unnest(string_split(technique, '; ')) AS technique_id FROM ledger WHERE technique <> '') GROUP BY 1"""))
def technique_usage(spark, sf):
    rows = lookups.technique_rows(default_techniques(spark)).where(F.col("TechniqueID") != "")
    counts = ledger(spark, sf).where(F.col("BinaryPrediction") == "ATTACK").groupBy("PredictedAttackFamily").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(rows), F.col("PredictedAttackFamily") == F.col("Category")).groupBy(
        F.col("TechniqueID").alias("technique_id")).agg(F.sum("n").alias("flow_count"))


LAYERS = ["Known-attack model", "Anomaly detector", "Cross-flow correlation", "Sensor"]
LAYER_SQL = with_flows(LEDGER_SQL + catalog_correlate.rolled_sql() + catalog_correlate.HEADS + """,
truths AS (SELECT row_id, scenario, CASE WHEN binary_label = 1 THEN 'ATTACK' ELSE 'BENIGN' END AS truth, prediction, anomaly, source,
  CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END AS rank,
  CASE WHEN technique <> '' THEN technique || ' ' || technique_name ELSE '' END AS named FROM ledger),
raised AS (
  SELECT scenario, truth, 'Known-attack model' AS layer, prediction = 'ATTACK' AS hit, rank, named FROM truths
  UNION ALL SELECT scenario, truth, 'Anomaly detector', anomaly, rank, named FROM truths
  UNION ALL SELECT h.scenario, h.truth, 'Cross-flow correlation', hit, 1, 'T1595 - Active Scanning' FROM heads h
    JOIN (SELECT src, bool_or(ports >= 5 AND syn_flows >= 5) AS hit FROM rolled GROUP BY 1) s ON s.src = h.src
  UNION ALL SELECT t.scenario, t.truth, 'Sensor', e.event_type = 'error', NULL, '' FROM truths t JOIN events e ON e.event_id = t.row_id),
layer AS (
  SELECT scenario, truth, layer, count(*) AS records, count(*) FILTER (hit) AS events,
    CASE min(rank) FILTER (hit) WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' WHEN 3 THEN 'Low' ELSE '' END AS severity,
    coalesce(array_to_string(list_sort(list(DISTINCT named) FILTER (hit AND named <> '')), '; '), '') AS techniques
  FROM raised GROUP BY 1, 2, 3)""")


def _layers(spark, sf):
    f, book = flows(spark, sf), ledger(spark, sf)
    truth = F.when(F.col("BinaryLabel") == 1, "ATTACK").otherwise("BENIGN")
    judged = book.withColumn("GroundTruth", truth)
    sensor = f.withColumn("GroundTruth", truth).select("Scenario", "GroundTruth", "DestinationIP")
    severity = F.col("AlertSeverity")
    named = F.when(F.col("MITRETechniqueID") != "", F.concat_ws(" ", "MITRETechniqueID", "MITRETechniqueName")).otherwise("")
    return [
        soc.layer_counts(LAYERS[0], judged, F.col("BinaryPrediction") == "ATTACK", severity, named),
        soc.layer_counts(LAYERS[1], judged, F.col("AnomalyFlag"), severity, named),
        soc.layer_counts(LAYERS[2], catalog_correlate.source_summary(spark, sf), F.col("CrossFlowScanFlag"), F.lit("High"),
                         F.col("MITREGroundTruth")),
        soc.layer_counts(LAYERS[3], sensor, F.col("DestinationIP") == "error"),
    ]


@query("layer_comparison", LAYER_SQL + """
SELECT scenario AS "Scenario", truth AS "GroundTruth", layer AS "DetectionLayer", events > 0 AS "AnalystFacingDetection", records AS "Records",
  events AS "EventCount", CAST(events AS VARCHAR) || ' of ' || CAST(records AS VARCHAR) || ' records flagged' AS "Result",
  severity AS "Severity", techniques AS "Techniques",
  CASE WHEN truth = 'ATTACK' THEN CASE WHEN events > 0 THEN 'Detected' ELSE 'Missed' END
    ELSE CASE WHEN events > 0 THEN 'False alarm' ELSE 'Correctly quiet' END END AS "Interpretation" FROM layer""")
def layer_comparison(spark, sf):
    return soc.compare_layers(_layers(spark, sf))


@query("layer_matrix", LAYER_SQL + "SELECT scenario AS \"Scenario\", truth AS \"GroundTruth\", " + ", ".join(
    f"""CAST(coalesce(sum(events) FILTER (layer = '{n}'), 0) AS BIGINT) AS "{n}" """ for n in LAYERS) + " FROM layer GROUP BY 1, 2")
def layer_matrix(spark, sf):
    return soc.layer_matrix(soc.compare_layers(_layers(spark, sf)), LAYERS)
