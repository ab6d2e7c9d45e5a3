"""Queries over cleaning, labels, sources and data-quality profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.functions import labels, text, times
from flowspark.functions.numeric import feature_value
from flowspark.operators import profile
from flowspark.plans.registry import query, r, rounded
from flowspark.plans.workload import (
    RAW_COLUMNS, RAW_FEATURES, flows, label_sql, raw_flows, table, with_flows, with_raw,
)
from flowspark.schema import q
from flowspark.session import scratch_path
from flowspark.sources import csv_flows, tables

KEEP = ['"Destination Port"', '"Flow Duration"', '"Total Fwd Packets"', '"Total Backward Packets"', '"Fwd Header Length"']
NUMBER = "regexp_matches(trim({0}), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')"
INF = "coalesce(regexp_matches(trim({0}), '^[+-]?(inf|infinity|Inf|Infinity|INF)$'), false)"
VALUE = f"CASE WHEN {NUMBER} THEN CAST(trim({{0}}) AS DOUBLE) END"
COERCED = f"({{0}} IS NOT NULL AND NOT {INF} AND NOT {NUMBER})"
EMPTY = " AND ".join(f'"{c}" IS NULL' for c in RAW_COLUMNS)


def _sum(template: str, columns=None) -> str:
    return " + ".join(f"CAST({template.format(c)} AS INTEGER)" for c in (columns or KEEP))


@query("label_cleaning", with_raw(f"""
SELECT "RowID", {label_sql('"Label"')} AS label,
  CASE WHEN {label_sql('"Label"')} <> 'BENIGN' THEN 1 ELSE 0 END AS binary_label FROM raw"""))
def label_cleaning(spark, sf):
    label = labels.normalize_label(F.col("Label"))
    return raw_flows(spark, sf).select("RowID", label.alias("label"), labels.binary_label(label).alias("binary_label"))


@query("label_families", with_flows("""
SELECT "Label" AS label, "AttackFamily" AS attack_family, "OperationalFamily" AS operational_family,
  CASE WHEN "BinaryLabel" = 0 THEN 'BENIGN' ELSE 'ATTACK' END AS class_name, count(*) AS row_count
FROM flows GROUP BY ALL"""))
def label_families(spark, sf):
    return flows(spark, sf).groupBy(
        F.col("Label").alias("label"), F.col("AttackFamily").alias("attack_family"),
        F.col("OperationalFamily").alias("operational_family"),
        labels.class_name(F.col("BinaryLabel")).alias("class_name"),
    ).agg(F.count("*").alias("row_count"))


@query("feature_cells", with_raw(f"""
SELECT "RowID", {VALUE.format('"Flow Duration"')} AS flow_duration, {VALUE.format('"Total Fwd Packets"')} AS fwd_packets,
  {VALUE.format('"Destination Port"')} AS port FROM raw WHERE NOT ({EMPTY})"""))
def feature_cells(spark, sf):
    clean = raw_flows(spark, sf).where(~csv_flows.all_missing(RAW_COLUMNS))
    return clean.select(
        "RowID", feature_value(F.col("`Flow Duration`")).cast("double").alias("flow_duration"),
        feature_value(F.col("`Total Fwd Packets`")).cast("double").alias("fwd_packets"),
        feature_value(F.col("`Destination Port`")).cast("double").alias("port"),
    )


@query("feature_quality", with_raw(f"""
SELECT "Scenario" AS scenario, count(*) AS row_count, CAST(sum({_sum(INF)}) AS BIGINT) AS infinity_values,
  CAST(sum({_sum(COERCED)}) AS BIGINT) AS coerced_values, CAST(sum({_sum('((' + VALUE + ') IS NULL)')}) AS BIGINT) AS missing_values
FROM raw GROUP BY 1"""))
def feature_quality(spark, sf):
    return profile.feature_quality(raw_flows(spark, sf), RAW_FEATURES, ["Scenario"]).withColumnsRenamed(
        {"Scenario": "scenario", "rows": "row_count"})


@query("duplicate_columns", with_raw("""
SELECT CAST(count(*) FILTER ("Fwd Header Length" IS DISTINCT FROM "Fwd Header Length.1") AS BIGINT) AS differing_rows,
  6 AS columns_left FROM raw"""))
def duplicate_columns(spark, sf):
    raw = raw_flows(spark, sf).select(*[q(c) for c in RAW_COLUMNS])
    left = csv_flows.drop_duplicate_columns(raw)
    return csv_flows.mismatched_copies(raw).select(
        F.col("`Fwd Header Length.1`").alias("differing_rows"), F.lit(len(left.columns)).alias("columns_left"))


@query("file_profile", with_raw(f"""
SELECT "Scenario" AS scenario, count(*) AS physical_rows, count(*) FILTER (NOT ({EMPTY})) AS valid_rows,
  count(*) FILTER ({EMPTY}) AS empty_rows,
  CAST(sum(CASE WHEN {EMPTY} THEN 0 ELSE {_sum('({0} IS NULL)', [f'"{c}"' for c in RAW_COLUMNS])} END) AS BIGINT) AS missing_cells,
  count(*) FILTER ("Flow Duration" IN ('Infinity', '-inf')) AS infinite_values,
  7 AS "columns", 6 AS unique_columns, 6 AS predictive_columns_before_cleaning,
  'Fwd Header Length' AS duplicate_header_names, 'Label' AS label_column,
  sha256('{chr(10).join(RAW_COLUMNS)}') AS schema_sha256, 'OK' AS status
FROM raw GROUP BY 1"""))
def file_profile(spark, sf):
    header = [c.removesuffix(".1") for c in RAW_COLUMNS]
    return profile.profile_files(raw_flows(spark, sf), RAW_COLUMNS, header, ["Scenario"]).withColumnRenamed("Scenario", "scenario")


@query("label_counts_by_file", with_flows(f"""
SELECT "Scenario" AS scenario, "Label" AS label, count(*) AS row_count,
  {r('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY "Scenario")', 'percentage')} FROM flows GROUP BY 1, 2"""))
def label_counts_by_file(spark, sf):
    table_ = profile.label_counts(flows(spark, sf), ["Scenario"]).withColumnsRenamed(
        {"Scenario": "scenario", "Label": "label", "count": "row_count"})
    return rounded(table_, "percentage")


@query("label_distribution", with_flows(f"""
SELECT "Label" AS label, count(*) AS row_count, {r('count(*) * 100.0 / sum(count(*)) OVER ()', 'percentage')}
FROM flows GROUP BY 1"""))
def label_distribution(spark, sf):
    table_ = profile.label_counts(flows(spark, sf), []).withColumnsRenamed({"Label": "label", "count": "row_count"})
    return rounded(table_.orderBy(F.desc("row_count"), "label"), "percentage")


@query("schema_presence", """
WITH cells AS (
  SELECT 'c' || CAST(c_nationkey % 3 AS VARCHAR) AS collection, c_nationkey AS file, c_mktsegment AS "column" FROM customer)
SELECT collection, "column", count(DISTINCT file) AS files_present,
  (SELECT count(DISTINCT file) FROM cells b WHERE b.collection = a.collection) AS total_files,
  count(DISTINCT file) = (SELECT count(DISTINCT file) FROM cells b WHERE b.collection = a.collection) AS present_in_all_files
FROM cells a GROUP BY collection, "column" """)
def schema_presence(spark, sf):
    c = table(spark, sf, "customer")
    cells = c.select(F.concat(F.lit("c"), (F.col("c_nationkey") % 3).cast("string")).alias("collection"),
                     F.col("c_nationkey").alias("file"), F.col("c_mktsegment").alias("column"))
    return profile.schema_presence(cells)


@query("schema_hashes", with_flows("""
SELECT "Scenario" AS scenario, sha256(string_agg("Label", chr(10) ORDER BY "Label")) AS schema_sha256
FROM (SELECT DISTINCT "Scenario", "Label" FROM flows) GROUP BY 1"""))
def schema_hashes(spark, sf):
    names = flows(spark, sf).select("Scenario", "Label").distinct().groupBy("Scenario").agg(
        F.array_sort(F.collect_list("Label")).alias("names"))
    return names.select(F.col("Scenario").alias("scenario"), profile.schema_hash(F.col("names")).alias("schema_sha256"))


@query("collection_summary", with_raw(f"""
SELECT CASE WHEN "Scenario" < 's4' THEN 'machine_learning' ELSE 'generated_flows' END AS collection,
  count(DISTINCT "Scenario") AS files, count(DISTINCT "Scenario") AS successful_files, count(*) AS physical_rows,
  count(*) FILTER (NOT ({EMPTY})) AS valid_rows, count(*) FILTER ({EMPTY}) AS empty_rows,
  CAST(sum(CASE WHEN {EMPTY} THEN 0 ELSE {_sum('({0} IS NULL)', [f'"{c}"' for c in RAW_COLUMNS])} END) AS BIGINT) AS missing_cells,
  count(*) FILTER ("Flow Duration" IN ('Infinity', '-inf')) AS infinite_values
FROM raw GROUP BY 1"""))
def collection_summary(spark, sf):
    profiles = profile.profile_files(raw_flows(spark, sf), RAW_COLUMNS, RAW_COLUMNS, ["Scenario"])
    side = F.when(F.col("Scenario") < "s4", "machine_learning").otherwise("generated_flows")
    return profile.collection_summary(profiles.withColumn("collection", side))


@query("binary_summary", with_flows(f"""
SELECT count(*) FILTER ("BinaryLabel" = 0) AS "BENIGN", count(*) FILTER ("BinaryLabel" = 1) AS "ATTACK",
  {r('count(*) FILTER ("BinaryLabel" = 0) * 100.0 / count(*)', 'BENIGN_percentage')},
  {r('count(*) FILTER ("BinaryLabel" = 1) * 100.0 / count(*)', 'ATTACK_percentage')},
  count(DISTINCT "Label") AS distinct_labels FROM flows"""))
def binary_summary(spark, sf):
    return rounded(profile.binary_summary(flows(spark, sf)), "BENIGN_percentage", "ATTACK_percentage")


@query("preprocessing_summary", with_raw(f"""
SELECT count(*) AS row_count, CAST(sum({_sum(INF)}) AS BIGINT) AS infinity_values,
  CAST(sum({_sum(COERCED)}) AS BIGINT) AS coerced_values, CAST(sum({_sum('((' + VALUE + ') IS NULL)')}) AS BIGINT) AS missing_values,
  count(*) FILTER ("RowID" % 1001 = 8) = 0 AS all_pairs_match FROM raw"""))
def preprocessing_summary(spark, sf):
    raw = raw_flows(spark, sf)
    # The second collection lost some rows.
    left, right = (profile.fingerprint(profile.alignment_rows(side, "Label")) for side in (raw, raw.where("RowID % 1001 <> 8")))
    quality = profile.feature_quality(raw, RAW_FEATURES, ["Scenario"])
    return profile.preprocessing_summary(quality, profile.pair_fingerprints(left, right)).withColumnRenamed("rows", "row_count")


def _digits(column: str) -> str:
    return f"coalesce(format('{{:.12e}}', {VALUE.format(column)}), '')"


DIGEST = f"""md5(CAST("RowID" AS VARCHAR) || '|' || {_digits('"Destination Port"')} || '|' || {_digits('"Flow Duration"')} || '|' ||
  {_digits('"Total Fwd Packets"')} || '|' || {_digits('"Total Backward Packets"')} || '|' || {label_sql('"Label"')})"""


@query("alignment_fingerprint", with_raw(f"""
SELECT "Scenario" AS scenario, count(*) AS row_count, bit_xor(CAST('0x' || substr(d, 1, 15) AS BIGINT)) AS xor_word,
  CAST(CAST(sum(CAST('0x' || substr(d, 16, 8) AS BIGINT)) AS BIGINT) AS VARCHAR) AS sum_word
FROM (SELECT "Scenario", {DIGEST} AS d FROM raw) GROUP BY 1"""))
def alignment_fingerprint(spark, sf):
    rows = profile.alignment_rows(raw_flows(spark, sf), "Label")
    return profile.fingerprint(rows).withColumnsRenamed({"Scenario": "scenario", "rows": "row_count"})


@query("pair_fingerprints", with_flows("""
SELECT "Scenario" AS scenario, count(*) AS left_rows, count(*) FILTER ("RowID" % 1001 <> 8) AS right_rows,
  count(*) = count(*) FILTER ("RowID" % 1001 <> 8) AS row_counts_match,
  count(*) = count(*) FILTER ("RowID" % 1001 <> 8) AND count(*) FILTER ("RowID" % 997 = 3) = 0 AS fingerprints_match
FROM flows GROUP BY 1"""))
def pair_fingerprints(spark, sf):
    # The second collection lost some rows and had a label changed in others.
    left = raw_flows(spark, sf)
    changed = F.when(F.col("RowID") % 997 == 3, "altered").otherwise(F.col("Label"))
    right = left.where(F.col("RowID") % 1001 != 8).withColumn("Label", changed)
    a, b = (profile.fingerprint(profile.alignment_rows(side, "Label")) for side in (left, right))
    return profile.pair_fingerprints(a, b).withColumnRenamed("Scenario", "scenario")


@query("differing_rows", with_raw("""
SELECT "Scenario" AS scenario, "RowID" AS row_id, "RowID" % 1001 = 8 AS missing_right FROM raw
WHERE "RowID" % 997 = 3 OR "RowID" % 1001 = 8"""))
def differing_rows(spark, sf):
    left = raw_flows(spark, sf)
    changed = F.when(F.col("RowID") % 997 == 3, "altered").otherwise(F.col("Label"))
    right = left.where(F.col("RowID") % 1001 != 8).withColumn("Label", changed)
    found = profile.differing_rows(profile.alignment_rows(left, "Label"), profile.alignment_rows(right, "Label"))
    return found.select(F.col("Scenario").alias("scenario"), F.col("RowID").alias("row_id"),
                        F.col("right_digest").isNull().alias("missing_right"))


@query("pair_compare", """
WITH l AS (SELECT c_custkey % 40 AS scenario_key, count(*) AS valid_rows,
    list_sort(list(c_mktsegment)) AS labels FROM customer WHERE c_custkey % 40 <> 7 GROUP BY 1),
  rr AS (SELECT c_custkey % 40 AS scenario_key, count(*) AS valid_rows,
    list_sort(list(CASE WHEN c_custkey % 40 = 9 THEN 'OTHER' ELSE c_mktsegment END)) AS labels FROM customer
    WHERE c_custkey % 40 <> 11 AND NOT (c_custkey % 40 = 5 AND c_acctbal < 0) GROUP BY 1)
SELECT coalesce(l.scenario_key, rr.scenario_key) AS scenario_key, l.valid_rows AS left_valid_rows,
  rr.valid_rows AS right_valid_rows, rr.valid_rows - l.valid_rows AS valid_row_difference,
  CASE WHEN l.scenario_key IS NULL OR rr.scenario_key IS NULL THEN 0 ELSE 3 END AS common_columns,
  CASE WHEN l.scenario_key IS NULL THEN 'c_acctbal; c_custkey; c_mktsegment; c_name; c_nationkey'
       WHEN rr.scenario_key IS NULL THEN '' ELSE 'c_name; c_nationkey' END AS right_extra_columns,
  CASE WHEN rr.scenario_key IS NULL THEN 'c_acctbal; c_custkey; c_mktsegment' ELSE '' END AS left_only_columns,
  l.labels = rr.labels AS label_counts_match
FROM l FULL OUTER JOIN rr ON l.scenario_key = rr.scenario_key""")
def pair_compare(spark, sf):
    c = table(spark, sf, "customer").withColumn("scenario_key", F.col("c_custkey") % 40)
    left = profile.label_profile(c.where(F.col("scenario_key") != 7), "scenario_key", "c_mktsegment",
                                 ["c_custkey", "c_acctbal", "c_mktsegment"])
    other = c.withColumn("c_mktsegment", F.when(F.col("scenario_key") == 9, "OTHER").otherwise(F.col("c_mktsegment")))
    kept = (F.col("scenario_key") != 11) & ~((F.col("scenario_key") == 5) & (F.col("c_acctbal") < 0))
    right = profile.label_profile(other.where(kept), "scenario_key", "c_mktsegment",
                                  ["c_custkey", "c_acctbal", "c_mktsegment", "c_name", "c_nationkey"])
    return profile.pair_compare(left, right)


@query("aligned_context", with_flows("""
SELECT "Scenario" AS scenario, "RowID" AS row_id, "Label" AS label, "SourceIP" AS source_ip, "DestinationPort" AS port FROM flows"""))
def aligned_context(spark, sf):
    f = flows(spark, sf)
    joined = profile.align(f.select("Scenario", "RowID", "Label"), f.select("Scenario", "RowID", "SourceIP", "DestinationPort"))
    return joined.select(F.col("Scenario").alias("scenario"), F.col("RowID").alias("row_id"), F.col("Label").alias("label"),
                         F.col("SourceIP").alias("source_ip"), F.col("DestinationPort").alias("port"))


@query("bucketed_alignment", with_flows("""
SELECT "Scenario" AS scenario, "RowID" AS row_id, "Label" AS label, "SourceIP" AS source_ip, "DestinationPort" AS port FROM flows"""))
def bucketed_alignment(spark, sf):
    """Features and context stored in buckets of their keys, then aligned without a shuffle."""
    f = flows(spark, sf)
    features = tables.write_bucketed(f.select("Scenario", "RowID", "Label"), "features", buckets=16)
    context = tables.write_bucketed(f.select("Scenario", "RowID", "SourceIP", "DestinationPort"), "context", buckets=16)
    return profile.align(features, context).select(
        F.col("Scenario").alias("scenario"), F.col("RowID").alias("row_id"), F.col("Label").alias("label"),
        F.col("SourceIP").alias("source_ip"), F.col("DestinationPort").alias("port"))


@query("scenario_keys", r"""
SELECT trim(regexp_replace(replace(replace(regexp_replace(lower(f), '\([0-9]+\)', '', 'g'), '.pcap_iscx.csv', ''), '.csv', ''),
    '[^a-z0-9]+', '-', 'g'), '-') AS scenario_key,
  regexp_replace(regexp_replace(f, '[.][^.]*$', ''), '[^A-Za-z0-9._-]+', '_', 'g') AS safe_stem,
  translate(lower(f), ' -/', '___') AS slug, count(*) AS row_count
FROM (SELECT 'Day ' || source || '-' || lang || ' (' || CAST(doc_id % 3 AS VARCHAR) || ').pcap_ISCX.csv' AS f FROM documents)
GROUP BY ALL""")
def scenario_keys(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(
        F.lit("Day "), "source", F.lit("-"), "lang", F.lit(" ("), (F.col("doc_id") % 3).cast("string"), F.lit(").pcap_ISCX.csv")
    ).alias("f"))
    f = F.col("f")
    return d.groupBy(text.scenario_key(f).alias("scenario_key"), text.safe_stem(f).alias("safe_stem"),
                     text.slug(f).alias("slug")).agg(F.count("*").alias("row_count"))


@query("mixed_timestamps", """
SELECT event_id, CASE event_id % 6
  WHEN 0 THEN epoch_us(date_trunc('minute', ts)) WHEN 1 THEN epoch_us(date_trunc('second', ts))
  WHEN 2 THEN epoch_us(ts) WHEN 3 THEN epoch_us(date_trunc('day', ts)) WHEN 4 THEN NULL
  ELSE epoch_us(date_trunc('second', ts)) END AS parsed_us FROM events""")
def mixed_timestamps(spark, sf):
    e, ts, kind = table(spark, sf, "events"), F.col("ts"), F.col("event_id") % 6
    written = (
        F.when(kind == 0, F.date_format(ts, "d/M/yyyy H:mm"))
        .when(kind == 1, F.concat(F.lit(" "), F.date_format(ts, "d/M/yyyy H:mm:ss")))
        .when(kind == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(kind == 3, F.date_format(ts, "yyyy-MM-dd")).when(kind == 4, F.lit("not a time"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    )
    return e.select("event_id", F.unix_micros(times.parse_mixed_timestamp(written)).alias("parsed_us"))


@query("session_groups", with_flows("""
SELECT "Scenario" || '|' || "SourceIP" || '|' || "DestinationIP" || '|' || CAST(CAST("DestinationPort" AS DOUBLE) AS VARCHAR) || '|' ||
    coalesce(CAST("Protocol" AS VARCHAR), 'MISSING') || '|' ||
    CASE WHEN "RowID" % 50 = 0 THEN 'NO_TIME' ELSE
      strftime(make_timestamp((epoch_us("Timestamp") // 900000000) * 900000000), '%Y-%m-%d %H:%M:%S') END AS group_id,
  "Scenario" || '::' || CAST("BinaryLabel" AS VARCHAR) AS stratum, count(*) AS row_count
FROM flows GROUP BY ALL"""))
def session_groups(spark, sf):
    time = F.when(F.col("RowID") % 50 != 0, F.col("Timestamp"))
    group = times.session_group_id(F.col("Scenario"), F.col("SourceIP"), F.col("DestinationIP"),
                                   F.col("DestinationPort").cast("double"), F.col("Protocol"), time, 15)
    stratum = times.strata_key(F.col("Scenario"), F.col("BinaryLabel"))
    return flows(spark, sf).groupBy(group.alias("group_id"), stratum.alias("stratum")).agg(F.count("*").alias("row_count"))


@query("time_buckets", with_flows("""
SELECT (epoch_us("Timestamp") // 900000000) * 900000000 AS bucket_us, count(*) AS flow_count FROM flows GROUP BY 1"""))
def time_buckets(spark, sf):
    bucket = F.unix_micros(times.bucket_start(F.col("Timestamp"), 15))
    return flows(spark, sf).groupBy(bucket.alias("bucket_us")).agg(F.count("*").alias("flow_count"))


@query("text_digests", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def text_digests(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("first_rows_per_scenario", with_flows("""
SELECT scenario, row_id, label FROM (SELECT "Scenario" AS scenario, "RowID" AS row_id, "Label" AS label,
  row_number() OVER (PARTITION BY "Scenario" ORDER BY "RowID") AS n FROM flows) WHERE n <= 20"""))
def first_rows_per_scenario(spark, sf):
    rows = flows(spark, sf).select(F.col("Scenario").alias("scenario"), F.col("RowID").alias("row_id"), F.col("Label").alias("label"))
    return tables.preview(rows, ["scenario"], ["row_id"], 20)


@query("selected_positions", with_flows("""
SELECT "Scenario" AS scenario, "RowID" AS row_id, "Score" AS score FROM flows
WHERE "RowID" IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"""))
def selected_positions(spark, sf):
    f = flows(spark, sf).select("Scenario", "RowID", "Score")
    wanted = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(
        F.concat(F.lit("s"), (F.col("o_orderkey") % 8).cast("string")).alias("Scenario"), F.col("o_orderkey").alias("RowID"))
    return tables.take_positions(f, wanted).select(
        F.col("Scenario").alias("scenario"), F.col("RowID").alias("row_id"), F.col("Score").alias("score"))


@query("csv_ingest", with_raw(f"""
SELECT "Scenario" AS scenario, count(*) AS row_count, CAST(sum({_sum('({0} IS NULL)', [f'"{c}"' for c in RAW_COLUMNS])}) AS BIGINT) AS missing_cells,
  true AS row_ids_contiguous, CAST(sum({VALUE.format('"Destination Port"')}) AS BIGINT) AS port_sum
FROM raw WHERE NOT ({EMPTY}) GROUP BY 1"""))
def csv_ingest(spark, sf):
    """Write the raw flows as CSV files, read them back, drop empty rows and number the rest."""
    folder = scratch_path(spark, "flow-csv")
    raw = raw_flows(spark, sf)
    header = [c.removesuffix(".1") for c in RAW_COLUMNS]
    raw.select("Scenario", *[F.col(q(c)).alias(f"c{i}") for i, c in enumerate(RAW_COLUMNS)]) \
        .write.partitionBy("Scenario").option("header", False).option("nullValue", "").csv(folder)
    lines = csv_flows.read_headerless(spark, folder, header)
    clean = csv_flows.drop_empty_rows(csv_flows.drop_duplicate_columns(lines))
    numbered = csv_flows.with_row_id(clean.withColumn("Scenario", F.regexp_extract("_path", "Scenario=([^/]+)", 1)))
    per_file = numbered.groupBy("Scenario", "_file").agg(
        F.count("*").alias("n"), F.max("RowID").alias("top"), F.count_distinct("RowID").alias("ids"),
        F.sum(profile.missing_cells(numbered, [c for c in RAW_COLUMNS if not c.endswith(".1")])).alias("gaps"),
        F.sum(F.col("`Fwd Header Length`").isNull().cast("int")).alias("copy_gaps"),
        F.sum(feature_value(F.col("`Destination Port`")).cast("double")).alias("ports"))
    return per_file.groupBy(F.col("Scenario").alias("scenario")).agg(
        F.sum("n").alias("row_count"), F.sum(F.col("gaps") + F.col("copy_gaps")).alias("missing_cells"),
        F.bool_and((F.col("top") + 1 == F.col("n")) & (F.col("ids") == F.col("n"))).alias("row_ids_contiguous"),
        F.sum("ports").cast("long").alias("port_sum"))


@query("processed_table", with_flows("""
SELECT "Scenario" AS scenario, "AttackFamily" AS family, count(*) AS row_count FROM flows
WHERE "Scenario" IN ('s1', 's7') AND "BinaryLabel" = 1 GROUP BY 1, 2"""))
def processed_table(spark, sf):
    path = scratch_path(spark, "features")
    tables.write_table(flows(spark, sf), path)
    back = tables.read_table(spark, path, ["Scenario", "AttackFamily", "BinaryLabel"], ["s1", "s7"])
    return back.where(F.col("BinaryLabel") == 1).groupBy(
        F.col("Scenario").alias("scenario"), F.col("AttackFamily").alias("family")).agg(F.count("*").alias("row_count"))


@query("context_table", with_flows("""
SELECT "RowID" AS row_id, "Scenario" AS scenario, CAST(NULL AS VARCHAR) AS flow_id, "SourceIP" AS source_ip,
  CAST(NULL AS DOUBLE) AS source_port, CAST("DestinationPort" AS DOUBLE) AS port, "Protocol" AS protocol, "Label" AS label FROM flows"""))
def context_table(spark, sf):
    f = flows(spark, sf).withColumnsRenamed({"SourceIP": "Source IP", "DestinationPort": "Destination Port"})
    context = tables.context_table(f.withColumn("SourceFile", F.col("Scenario")))
    return context.select(
        F.col("RowID").alias("row_id"), F.col("Scenario").alias("scenario"), F.col("`Flow ID`").alias("flow_id"),
        F.col("`Source IP`").alias("source_ip"), F.col("`Source Port`").alias("source_port"),
        F.col("`Destination Port`").alias("port"), F.col("Protocol").alias("protocol"), F.col("Label").alias("label"))


@query("truthy_text", """
SELECT o_orderpriority, lower(o_orderpriority) LIKE '%medium%' AS has_medium, count(*) AS row_count,
  count(*) FILTER (o_orderstatus = 'F') AS truthy_rows FROM orders GROUP BY 1, 2""")
def truthy_text(spark, sf):
    o = table(spark, sf, "orders")
    flag = F.when(F.col("o_orderstatus") == "F", " Yes ").when(F.col("o_orderstatus") == "P", "no")
    return o.groupBy("o_orderpriority", text.contains_text(F.col("o_orderpriority"), "MEDIUM").alias("has_medium")).agg(
        F.count("*").alias("row_count"), F.count_if(text.truthy(flag)).alias("truthy_rows"))
