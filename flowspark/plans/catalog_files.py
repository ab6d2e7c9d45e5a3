"""Queries that go through files: reports, technique maps, sensor logs, digests, live captures and batch scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.operators import extractor, scoring
from flowspark.plans import score
from flowspark.plans.catalog_models import feature_flows, saved_bundle
from flowspark.plans.catalog_soc import LEDGER_SQL, ledger, sensor_alerts
from flowspark.plans.registry import query
from flowspark.plans.workload import flows, table, with_flows
from flowspark.schema import EXTRACTOR_COLUMNS, EXTRACTOR_CONTEXT, FEATURES, OPERATIONAL_FAMILIES, TIME_FEATURES
from flowspark.session import scratch_path
from flowspark.sources import lookups, tables
from flowspark.techniques import default_techniques


@query("report_files", with_flows("""
SELECT kind, "Label" AS label, count(*) AS row_count FROM flows, (VALUES ('csv'), ('json')) k(kind) GROUP BY 1, 2"""))
def report_files(spark, sf):
    """A report written as CSV and as JSON lines, and read back."""
    report = flows(spark, sf).groupBy(F.col("Label").alias("label")).agg(F.count("*").alias("row_count"))
    path = scratch_path(spark, "report")
    for kind in ("csv", "json"):
        tables.write_report(report, f"{path}/{kind}", kind)
    schema = "label string, row_count long"
    read = [spark.read.schema(schema).option("header", True).csv(f"{path}/csv").withColumn("kind", F.lit("csv")),
            spark.read.schema(schema).json(f"{path}/json").withColumn("kind", F.lit("json"))]
    return read[0].unionByName(read[1])


@query("technique_file", with_flows(LEDGER_SQL + """
SELECT technique, tactic, count(*) AS flow_count FROM ledger GROUP BY 1, 2"""))
def technique_file(spark, sf):
    """The ledger enriched by a technique map that was written as JSON and read from there."""
    record = F.struct("tactic", "techniques", "note")
    text = default_techniques(spark).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("family"), record)))).alias("value"))
    path = scratch_path(spark, "techniques")
    tables.write_report(text, path, "text")
    bare = ledger(spark, sf).drop("MITRETactic", "MITRETechniqueID", "MITRETechniqueName", "MITREReference", "MITREMappingNote")
    enriched = scoring.enrich(bare, lookups.read_technique_map(spark, path))
    return enriched.groupBy(F.col("MITRETechniqueID").alias("technique"), F.col("MITRETactic").alias("tactic")).agg(
        F.count("*").alias("flow_count"))


@query("sensor_log", """
SELECT 'SIG ' || CAST(user_id % 7 AS VARCHAR) AS signature, count(*) AS alerts FROM events WHERE event_type = 'error' GROUP BY 1""")
def sensor_log(spark, sf):
    """Signatures of a sensor log that was written as JSON lines and read by its reader."""
    path = scratch_path(spark, "sensor")
    tables.write_report(sensor_alerts(spark, sf), path, "json", single_file=False)
    return lookups.signature_counts(lookups.read_sensor_alerts(spark, path))


@query("file_digests", """
SELECT n_nationkey AS nation_key, octet_length(CAST(n_name || chr(10) AS BLOB)) AS size_bytes, sha256(n_name || chr(10)) AS digest FROM nation""")
def file_digests(spark, sf):
    """Digests of small files, one per nation."""
    path = scratch_path(spark, "nations")
    names = table(spark, sf, "nation").select(F.col("n_name").alias("value"), "n_nationkey")
    names.repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    files = tables.file_digests(spark, [f"{path}/*/*.txt"])
    key = F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int")
    return files.select(key.alias("nation_key"), F.col("bytes").alias("size_bytes"), F.col("sha256").alias("digest"))


@query("document_file_digests", """
SELECT doc_id % 64 AS bucket, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS size_bytes,
  sha256(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1""")
def document_file_digests(spark, sf):
    """Digests of the documents' texts, written into 64 files."""
    path = scratch_path(spark, "texts")
    docs = table(spark, sf, "documents").select((F.col("doc_id") % 64).alias("bucket"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    docs.repartition(64, "bucket").sortWithinPartitions("bucket", "doc_id").drop("doc_id").write.partitionBy("bucket").text(path)
    files = tables.file_digests(spark, [f"{path}/*/*.txt"])
    key = F.regexp_extract("path", "bucket=([0-9]+)", 1).cast("long")
    return files.select(key.alias("bucket"), F.col("bytes").alias("size_bytes"), F.col("sha256").alias("digest"))


def _raw(position: int) -> str:
    return f"event_id % {position + 1} + 0.5"


_RAW_SUM = " + ".join(f"({_raw(k)}) * {1_000_000 if f in TIME_FEATURES else 1}" for k, f in enumerate(FEATURES, 1))


@query("live_capture", f"""
SELECT event_id AS row_id, 'live' AS scenario, CAST(user_id AS VARCHAR) AS source, round(CAST({_RAW_SUM} AS DOUBLE), 1) AS feature_sum FROM events""")
def live_capture(spark, sf):
    """Extractor output mapped to the training features, in the order of the manifest."""
    names = extractor.load_manifest(extractor.feature_manifest(spark))
    positions = {f: k for k, f in enumerate(FEATURES, 1)}
    context = {raw: F.col("user_id").cast("string") for raw in EXTRACTOR_CONTEXT}
    cells = {EXTRACTOR_COLUMNS[f]: F.expr(_raw(positions[f])).cast("string") for f in names}
    raw = table(spark, sf, "events").select(F.col("event_id").alias("RowID"), *[v.alias(c) for c, v in (context | cells).items()])
    mapped = extractor.map_extractor_schema(raw, "live", "UNKNOWN")
    total = sum((F.col(f"`{f}`").cast("double") for f in names), F.lit(0.0))
    return mapped.select(F.col("RowID").alias("row_id"), F.col("Scenario").alias("scenario"), F.col("SourceIP").alias("source"),
                         F.round(total, 1).alias("feature_sum"))


@query("mapping_quality", f"""
SELECT count(*) AS model_rows, {len(FEATURES)} AS model_features, {len(TIME_FEATURES)} AS time_features_scaled,
  count(*) FILTER (event_id % 10 = 3) AS numeric_coercion_failures,
  count(*) FILTER (event_id % 10 = 3) + count(*) FILTER (event_id % 10 = 4) AS missing_model_cells,
  count(*) FILTER (event_id % 10 IN (3, 4)) AS rows_with_missing_model_values FROM events""")
def mapping_quality(spark, sf):
    """Cells lost when extractor output becomes features: one column holds text and gaps."""
    dirty = F.when(F.col("event_id") % 10 == 3, "n/a").when(F.col("event_id") % 10 != 4, F.lit("1.5"))
    cells = {c: F.lit("2") for c in EXTRACTOR_COLUMNS.values()} | {EXTRACTOR_COLUMNS[FEATURES[5]]: dirty}
    context = {raw: F.col("user_id").cast("string") for raw in EXTRACTOR_CONTEXT}
    raw = table(spark, sf, "events").select(*[v.alias(c) for c, v in (context | cells).items()])
    return extractor.mapping_quality(raw)


@query("alert_columns", with_flows(LEDGER_SQL + """
SELECT severity AS "AlertSeverity", CASE severity WHEN 'Critical' THEN 'Known attack pattern and anomalous relative to benign behavior'
    WHEN 'High' THEN 'Known supervised attack pattern' WHEN 'Medium' THEN 'Unusual relative to the learned benign profile'
    ELSE 'No known attack pattern and no anomaly flag' END AS "AlertReason",
  prediction AS "BinaryPrediction", family AS "PredictedAttackFamily", anomaly AS "AnomalyFlag", tactic AS "MITRETactic",
  technique AS "MITRETechniqueID", technique_name AS "MITRETechniqueName", scenario AS "Scenario", binary_label AS "BinaryLabel",
  correct AS "BinaryCorrect", count(*) AS flow_count FROM ledger GROUP BY ALL"""))
def alert_columns(spark, sf):
    """The alert view of the ordered ledger, counted by its columns that aren't continuous."""
    view = scoring.alert_view(scoring.order_ledger(ledger(spark, sf)))
    continuous = {"KnownAttackProbability", "FamilyConfidence", "AnomalyScore", "AnomalyMargin", "Timestamp", "Label"}
    return view.groupBy(*[c for c in view.columns if c not in continuous]).agg(F.count("*").alias("flow_count"))


@query("batch_scoring", with_flows("""
SELECT "RowID" AS row_id, true AS decided_by_threshold, true AS severity_follows FROM flows"""))
def batch_scoring(spark, sf):
    """Flows written as CSV, scored by a loaded bundle into CSV ledger parts; decisions are recomputed from the scores."""
    path = scratch_path(spark, "batch")
    feature_flows(spark, sf).write.option("header", True).csv(f"{path}/in")
    score.score_files(spark, [f"{path}/in/*.csv"], f"{path}/out", saved_bundle(spark, sf))
    rows = spark.read.option("header", True).csv(f"{path}/out")
    known = F.col("KnownAttackProbability").cast("double") >= F.col("BinaryDecisionThreshold").cast("double")
    odd = F.col("AnomalyScore").cast("double") >= F.col("AnomalyThreshold").cast("double")
    return rows.select(
        F.col("RowID").cast("long").alias("row_id"), ((F.col("BinaryPrediction") == "ATTACK") == known).alias("decided_by_threshold"),
        (F.col("AlertSeverity") == scoring.severity(known, odd)).alias("severity_follows"))


@query("batch_ledger", with_flows("""
SELECT "RowID" AS row_id, "Scenario" AS scenario, "Label" AS label, "BinaryLabel" AS binary_label, true AS correct_follows,
  true AS family_follows, true AS margin_follows, true AS technique_follows FROM flows"""))
def batch_ledger(spark, sf):
    """The ledger that batch scoring wrote: its context columns, and what follows from its scores and labels recomputed."""
    path = scratch_path(spark, "batch")
    feature_flows(spark, sf).write.option("header", True).csv(f"{path}/in")
    score.score_files(spark, [f"{path}/in/*.csv"], f"{path}/out", saved_bundle(spark, sf))
    rows = spark.read.option("header", True).csv(f"{path}/out")
    attack = F.col("KnownAttackProbability").cast("double") >= F.col("BinaryDecisionThreshold").cast("double")
    score_, threshold = F.col("AnomalyScore").cast("double"), F.col("AnomalyThreshold").cast("double")
    family = F.col("PredictedAttackFamily")
    runs = F.when(attack, family.isin(OPERATIONAL_FAMILIES) & F.col("FamilyConfidence").cast("double").between(0.2, 1.0001)).otherwise(
        (family == "Not run") & F.col("FamilyConfidence").isNull())
    quiet = ~attack & (score_ < threshold)
    return rows.select(
        F.col("RowID").cast("long").alias("row_id"), F.col("Scenario").alias("scenario"), F.col("Label").alias("label"),
        F.col("BinaryLabel").cast("int").alias("binary_label"),
        ((F.col("BinaryCorrect") == "true") == (F.col("BinaryLabel").cast("int") == attack.cast("int"))).alias("correct_follows"),
        runs.alias("family_follows"), (F.abs(F.col("AnomalyMargin").cast("double") - (score_ - threshold)) < 1e-9).alias("margin_follows"),
        (quiet == F.coalesce(F.col("MITRETactic") == "", F.lit(True))).alias("technique_follows"))
