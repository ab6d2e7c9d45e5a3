import math

import pytest
from pyspark.sql import functions as F

from flowspark import schema
from flowspark.functions import labels, numeric, text, times


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def evaluate(spark, values, expression, kind="string"):
    rows = column(spark, values, kind).withColumn("_n", F.monotonically_increasing_id())
    return [r[0] for r in rows.select(expression(F.col("x")).alias("y"), "_n").orderBy("_n").collect()]


def test_label_variants(spark):
    given = [None, " BENIGN ", "Web Attack � Brute Force", "Web Attack – XSS", "web attack  sql injection", "FTP-Patator",
             "SSH  -  Patator", "dos   HULK", "Something New", "A−B", "Web Attack XSS", "DoS slowloris\t"]
    expected = ["<MISSING>", "BENIGN", "Web Attack - Brute Force", "Web Attack - XSS", "Web Attack - SQL Injection", "FTP-Patator",
                "SSH-Patator", "DoS Hulk", "Something New", "A - B", "Web Attack - XSS", "DoS slowloris"]
    assert evaluate(spark, given, labels.normalize_label) == expected


def test_families(spark):
    given = ["BENIGN", "DDoS", "DoS Hulk", "Heartbleed", "PortScan", "Web Attack - XSS", "<MISSING>", "Bot"]
    assert evaluate(spark, given, labels.attack_family) == [
        "BENIGN", "DDoS", "DoS", "Exploit", "Port Scan", "Web Attack", "Other Attack", "Bot"]
    assert evaluate(spark, given, labels.operational_family) == [
        "Other Malicious", "Denial of Service", "Denial of Service", "Other Malicious", "Port Scan", "Web Attack",
        "Other Malicious", "Other Malicious"]
    assert evaluate(spark, given, labels.binary_label) == [0, 1, 1, 1, 1, 1, 1, 1]


def test_numbers(spark):
    given = ["1", " 2.5 ", "1e3", "-.5", "Infinity", "-inf", "iNf", "1e999", "5d", "0x10", "abc", None, "NaN", "3.", "1e39"]
    values = evaluate(spark, given, numeric.feature_value)
    assert values == [1.0, 2.5, 1000.0, -0.5, None, None, None, None, None, None, None, None, None, 3.0, None]
    assert evaluate(spark, given, numeric.is_infinite) == [
        False, False, False, False, True, True, True, True, False, False, False, False, False, False, True]
    assert evaluate(spark, given, numeric.is_coerced) == [
        False, False, False, False, False, False, False, False, True, True, True, False, True, False, False]


def test_numeric_input_columns(spark):
    given = [1.5, math.inf, -math.inf, math.nan, None]
    assert evaluate(spark, given, numeric.feature_value, "double") == [1.5, None, None, None, None]
    assert evaluate(spark, given, numeric.finite, "double") == [1.5, None, None, None, None]
    assert evaluate(spark, given, numeric.is_infinite, "double") == [False, True, True, False, False]


def test_timestamps(spark):
    given = ["4/7/2017 8:54", " 03/07/2017 08:55:58 ", "5/7/2017 1:02:03 PM", "2026-08-14 10:55:42", "2026-08-14T10:55:42+00:00",
             "2026-08-14 10:55:42.5", "nonsense", None]
    got = evaluate(spark, given, lambda c: times.iso_text(times.parse_mixed_timestamp(c)))
    assert got == ["2017-07-04T08:54:00+00:00", "2017-07-03T08:55:58+00:00", "2017-07-05T13:02:03+00:00",
                   "2026-08-14T10:55:42+00:00", "2026-08-14T10:55:42+00:00", "2026-08-14T10:55:42.500000+00:00", None, None]


def test_session_group(spark):
    df = spark.createDataFrame([("s", " a ", None, 80.0, 6.0, "2024-01-01 10:16:59"), ("s", "a", "b", None, None, None)],
                               "sc string, src string, dst string, port double, proto double, ts string")
    group = times.session_group_id(F.col("sc"), F.col("src"), F.col("dst"), F.col("port"), F.col("proto"),
                                   F.to_timestamp("ts"), 15)
    assert [r[0] for r in df.select(group).collect()] == [
        "s|a|MISSING|80.0|6.0|2024-01-01 10:15:00", "s|a|b|MISSING|MISSING|NO_TIME"]


def test_names(spark):
    given = ["Friday-WorkingHours-Afternoon-DDos.pcap_ISCX.csv", "Monday (1).csv", "Tuesday-WorkingHours.pcap_ISCX (2).csv"]
    assert evaluate(spark, given, text.scenario_key) == [
        "friday-workinghours-afternoon-ddos", "monday", "tuesday-workinghours-pcap-iscx"]
    assert evaluate(spark, ["a b!.csv", "x.tar.gz"], text.safe_stem) == ["a_b_", "x.tar"]
    assert evaluate(spark, ["Random Forest", "A-B/c"], text.slug) == ["random_forest", "a_b_c"]
    assert evaluate(spark, ["(a b)", "ok"], text.safe_name) == ["a_b", "ok"]
    assert evaluate(spark, [" TRUE", "1", "yes ", "no", None], text.truthy) == [True, True, True, False, False]


def test_headers():
    assert schema.parse_header('\ufeff Flow ID,"a,b",X, X ') == ["Flow ID", "a,b", "X", "X"]
    assert schema.unique_names(["X", "Y", "X", "X"]) == ["X", "Y", "X.1", "X.2"]
    assert schema.clean_header(["﻿ a ", "b"]) == ["a", "b"]
    assert schema.find_label_column(["a", " Label"]) == " Label"
    assert schema.find_label_column(["Class", "label"]) == "label"
    assert schema.find_label_column(["a", "traffic_LABEL"]) == "traffic_LABEL"
    assert schema.find_label_column(["a"]) is None
    assert schema.duplicate_pairs(["a", "a.1", "b.2", "c.x"]) == [("a", "a.1")]
    assert schema.resolve_alias(["src_ip", "x"], "source_ip") == "src_ip"
    with pytest.raises(ValueError):
        schema.resolve_alias(["x"], "source_ip", required=True)


def test_fixed_sizes():
    assert len(schema.FEATURES) == 77 and len(set(schema.EXTRACTOR_COLUMNS.values())) == 77
    assert len(schema.TIME_FEATURES) == 23
