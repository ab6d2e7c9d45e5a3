import pytest
from pyspark.sql import functions as F

from flowspark.operators import extractor, profile
from flowspark.schema import EXTRACTOR_COLUMNS, EXTRACTOR_CONTEXT, FEATURES
from flowspark.sources import tables

NAMES = ["f1", "f2"]
CONTEXT = ["'a' AS SourceIP", "'b' AS DestinationIP", "'2024-01-01 00:00:00' AS Timestamp", "'80' AS DestinationPort", "'1' AS `SYN Flag Count`"]


def statuses(report):
    return [r["status"] for r in profile.validation_checks(report).orderBy("position").collect()]


def test_ready_table(spark):
    df = spark.createDataFrame([("1", "2")], "f1 string, f2 string").selectExpr("*", *CONTEXT)
    report = profile.validate_flows(df, NAMES)
    row = report.first()
    assert row["status"] == "PASS" and row["model_ready"] and row["cross_flow_ready"] and row["rows_with_feature_gaps"] == 0
    assert row["context_mapping"]["syn_count"] == "SYN Flag Count" and row["invalid_context_counts"]["timestamp"] == 0
    assert len(row["extra_columns"]) == 5 and statuses(report) == ["PASS"] * 5


def test_warnings(spark):
    df = spark.createDataFrame([("1", "x"), ("Infinity", "2")], "f1 string, f2 string")
    report = profile.validate_flows(df, NAMES)
    row = report.first()
    assert row["status"] == "PASS WITH WARNINGS" and row["missing_feature_cells_after_coercion"] == 2 and row["rows_with_feature_gaps"] == 2
    assert statuses(report) == ["PASS", "PASS", "PASS", "WARNING", "NOT READY"]


def test_failures(spark):
    unusable = spark.createDataFrame([("1", "x")], "f1 string, f2 string")
    row = profile.validate_flows(unusable, NAMES).first()
    assert row["status"] == "FAIL" and row["unusable_required_features"] == ["f2"]
    absent = profile.validate_flows(unusable.select("f1"), NAMES)
    assert absent.first()["missing_required_features"] == ["f2"]
    assert profile.validation_checks(absent).where("position = 3").first()["detail"] == "1/2 required features present; 1 missing"
    twice = unusable.toDF("f1", "﻿f1 ")
    assert profile.validate_flows(twice, ["f1"]).first()["duplicate_columns"] == ["f1"]
    assert statuses(profile.validate_flows(twice, ["f1"]))[1] == "FAIL"
    empty = profile.validate_flows(unusable.limit(0), NAMES)
    assert empty.first()["status"] == "FAIL" and statuses(empty)[0] == "FAIL"


def test_bad_context_values(spark):
    df = spark.createDataFrame([("1", "2")], "f1 string, f2 string").selectExpr("*", *CONTEXT).withColumn("Timestamp", F.lit("soon"))
    report = profile.validate_flows(df, NAMES)
    assert report.first()["invalid_context_counts"]["timestamp"] == 1 and not report.first()["cross_flow_ready"]
    assert profile.validation_checks(report).where("position = 5").first()["detail"] == "Invalid or blank context values: 1"


def test_schema_gate(spark):
    df = spark.createDataFrame([("1", "inf", "keep")], ["﻿f1", " f2", "other"])
    row = profile.prepare_features(df, NAMES).first()
    assert (row["f1"], row["f2"], row["other"]) == (1.0, None, "keep")
    with pytest.raises(ValueError, match=r"\+5 more"):
        profile.prepare_features(df, [f"g{i}" for i in range(20)])
    with pytest.raises(ValueError, match="repeated"):
        profile.prepare_features(df.toDF("a", "a ", "b"), NAMES)
    quality = profile.input_quality(df, NAMES).first()
    assert quality["infinity_values_converted_to_missing"] == 1 and quality["missing_feature_cells_after_coercion"] == 1


def capture(spark):
    values = {c: "2" for c in EXTRACTOR_COLUMNS.values()} | {c: "x" for c in EXTRACTOR_CONTEXT}
    values |= {"flow_duration": "0.5", "flow_byts_s": "inf", "down_up_ratio": "bad"}
    return spark.createDataFrame([values]).withColumn("RowID", F.lit(0))


def test_extractor_mapping(spark):
    mapped = extractor.map_extractor_schema(capture(spark), "lab", "BENIGN")
    assert mapped.columns[:8] == ["RowID", "Scenario", "GroundTruth", "SourceIP", "DestinationIP", "SourcePort", "ProtocolNumber", "Timestamp"]
    assert mapped.columns[8:] == FEATURES
    row = mapped.first()
    assert row["Flow Duration"] == 500_000.0 and row["Idle Min"] == 2_000_000.0 and row["SYN Flag Count"] == 2.0
    assert row["Flow Bytes/s"] is None and row["Down/Up Ratio"] is None
    quality = extractor.mapping_quality(capture(spark)).first()
    assert quality["numeric_coercion_failures"] == 1 and quality["missing_model_cells"] == 2 and quality["rows_with_missing_model_values"] == 1
    with pytest.raises(ValueError, match="idle_min"):
        extractor.map_extractor_schema(capture(spark).drop("idle_min"), "lab", "BENIGN")
    assert extractor.mapping_report(spark).where("transform = 'seconds_to_microseconds'").count() == 23


def test_manifest(spark):
    table = extractor.feature_manifest(spark)
    assert extractor.load_manifest(table.orderBy(F.desc("position"))) == FEATURES
    for broken in (table.limit(76), table.withColumn("feature", F.when(F.col("position") == 1, "Idle Min").otherwise(F.col("feature"))),
                   table.withColumn("feature", F.when(F.col("position") == 1, "New").otherwise(F.col("feature"))), table.drop("position")):
        with pytest.raises(ValueError):
            extractor.load_manifest(broken)


def test_alignment(spark):
    rows = spark.range(6).select(F.lit("s").alias("Scenario"), F.col("id").alias("RowID"), F.col("id").alias("v"))
    other = rows.select("Scenario", "RowID", (F.col("v") * 2).alias("w"))
    assert profile.align(rows, other).count() == 6
    with pytest.raises(ValueError, match="do not align"):
        profile.align(rows, other.where("RowID < 5"))


def test_bucketed_tables_align_without_a_shuffle(spark):
    rows = spark.range(900).select(F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("Scenario"), F.col("id").alias("RowID"), F.col("id").alias("v"))
    other = rows.select("Scenario", "RowID", (F.col("v") * 2).alias("w"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = (tables.write_bucketed(t, "aligned", buckets=8) for t in (rows, other))
        joined = profile.align(left, right)
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        check = left.select("Scenario", "RowID").join(right.select("Scenario", "RowID"), ["Scenario", "RowID"], "full_outer")
        assert "Exchange" not in check._jdf.queryExecution().executedPlan().toString()
        assert {(r.RowID, r.v, r.w) for r in joined.collect()} == {(k, k, 2 * k) for k in range(900)}
        with pytest.raises(ValueError, match="do not align"):
            profile.align(left, tables.write_bucketed(other.where("RowID <> 5"), "aligned", buckets=8))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_fingerprint_sees_order(spark):
    rows = spark.createDataFrame([("s", 0, "80", "BENIGN"), ("s", 1, "443", "BENIGN")], "Scenario string, RowID long, `Destination Port` string, Label string")
    swapped = rows.withColumn("RowID", 1 - F.col("RowID"))
    a, b, c = (profile.fingerprint(profile.alignment_rows(t, "Label")) for t in (rows, swapped, rows.repartition(3)))
    assert not profile.pair_fingerprints(a, b).first()["fingerprints_match"]
    assert profile.pair_fingerprints(a, c).first()["fingerprints_match"]
    only = profile.pair_fingerprints(a, c.where("false")).first()
    assert not only["row_counts_match"] and not only["fingerprints_match"] and only["right_rows"] is None
