import gzip
import hashlib
import json
import random
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from flowspark.sources import csv_flows, lookups, tables
from flowspark.techniques import default_techniques


def write(path, text):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_csv_header_and_cells(spark, tmp_path):
    raw = "﻿ Port, Len,Len,Label\r\n80,1,1,Web Attack \u0096 XSS\r\n,NaN,nan,BENIGN\r\n,,,\r\n".encode("utf-8").replace("\u0096".encode(), b"\x96")
    path = write(tmp_path / "a.csv", raw)
    df = csv_flows.read_flow_csv(spark, [path])
    assert csv_flows.data_columns(df) == ["Port", "Len", "Len.1", "Label"]
    rows = [tuple(r) for r in df.select("Port", "Len", "`Len.1`", "Label").collect()]
    assert rows[0] == ("80", "1", "1", "Web Attack � XSS")
    assert rows[1] == (None, None, None, "BENIGN") and rows[2] == (None,) * 4
    assert csv_flows.drop_empty_rows(df).count() == 2
    assert csv_flows.data_columns(csv_flows.drop_duplicate_columns(df)) == ["Port", "Len", "Label"]


def test_bad_lines(spark, tmp_path):
    path = write(tmp_path / "b.csv", 'a,b,c\n1,2,3\n4,5\n6,7,8,9\n"x,y",2,3\n')
    kept = csv_flows.read_flow_csv(spark, [path], "skip").select("a", "b", "c").collect()
    assert sorted(tuple(r) for r in kept) == sorted([("1", "2", "3"), ("4", "5", None), ("x,y", "2", "3")], key=str)
    with pytest.raises(Exception, match="more cells"):
        csv_flows.read_flow_csv(spark, [path], "error").collect()
    with pytest.raises(ValueError):
        csv_flows.read_flow_csv(spark, [path], "ignore")


def test_files_with_different_headers(spark, tmp_path):
    a = write(tmp_path / "a.csv", "x,y\n1,2\n")
    b = write(tmp_path / "b.csv", "y,x,z\n20,10,30\n")
    rows = csv_flows.read_flow_csv(spark, [a, b]).orderBy("_file").select("x", "y", "z").collect()
    assert [tuple(r) for r in rows] == [("1", "2", None), ("10", "20", "30")]


def test_unequal_copies_raise(spark, tmp_path):
    path = write(tmp_path / "c.csv", "a,a\n1,1\n2,3\n")
    with pytest.raises(ValueError, match="a.1"):
        csv_flows.drop_duplicate_columns(csv_flows.read_flow_csv(spark, [path]))


def test_row_ids_over_many_splits(spark, tmp_path):
    lines = [f"{i},{'x' * 40}" if i % 10 else "," for i in range(3000)]
    for name in ("one.csv", "two.csv"):
        write(tmp_path / name, "n,pad\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = csv_flows.read_flow_csv(spark, [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")])
        assert df.select("_start").distinct().count() > 3
        rows = csv_flows.with_row_id(csv_flows.drop_empty_rows(df)).select("_file", "RowID", "n").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wanted = [str(i) for i in range(3000) if i % 10]
    for name in ("one.csv", "two.csv"):
        mine = sorted((r["RowID"], r["n"]) for r in rows if r["_file"] == name)
        assert [i for i, _ in mine] == list(range(len(wanted))) and [n for _, n in mine] == wanted


def test_processed_tables(spark, tmp_path):
    df = spark.createDataFrame([(0, "f", "s1", "BENIGN", "BENIGN", 0, "BENIGN", "1.1.1.1", "80"), (0, "f", "s2", "x", "x", 1, "Other Attack", None, "bad")],
                               ["RowID", "SourceFile", "Scenario", "LabelRaw", "Label", "BinaryLabel", "AttackFamily", "Source IP", "Source Port"])
    context = tables.context_table(df)
    assert dict(context.dtypes)["Flow ID"] == "string" and dict(context.dtypes)["Protocol"] == "double"
    assert {r["Source Port"] for r in context.collect()} == {80.0, None}
    path = str(tmp_path / "t")
    tables.write_table(context, path)
    back = tables.read_table(spark, path, ["Scenario", "Label"], ["s2"])
    assert [tuple(r) for r in back.collect()] == [("s2", "x")]
    assert "PartitionFilters: [isnotnull(Scenario" in back._jdf.queryExecution().toString()


def test_reports_and_digests(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, t string")
    for kind in ("csv", "json"):
        tables.write_report(df, str(tmp_path / kind), kind)
        assert len(list((tmp_path / kind).glob("part-*"))) == 1
    tables.write_report(df.select("t"), str(tmp_path / "text"), "text")
    with pytest.raises(ValueError):
        tables.write_report(df, str(tmp_path / "x"), "xlsx")
    path = write(tmp_path / "f.bin", b"hello")
    assert tables.file_digests(spark, [path]).first()["sha256"] == hashlib.sha256(b"hello").hexdigest()


def test_preview_beyond_trim_limit(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise("cold").alias("k"), F.col("id").alias("RowID"))
    for n in (10, 1500):
        rows = tables.preview(df, ["k"], ["RowID"], n).collect()
        assert sorted(r["RowID"] for r in rows if r["k"] == "hot") == list(range(n))
        assert sorted(r["RowID"] for r in rows if r["k"] == "cold") == list(range(4000, 4000 + min(n, 1000)))


def test_technique_map(spark, tmp_path):
    record = {"A": {"tactic": "t", "techniques": [{"id": "1", "name": "n", "url": "u"}, {"id": "2", "name": "m", "url": "v"}], "note": "x"},
              "B": {"tactic": "", "techniques": [], "note": "y"}}
    table = lookups.read_technique_map(spark, write(tmp_path / "m.json", json.dumps(record, indent=1)))
    rows = sorted(tuple(r) for r in lookups.technique_rows(table).collect())
    assert rows == [("A", "t", "1", "n", "u", "x"), ("A", "t", "2", "m", "v", "x"), ("B", "", "", "", "", "y")]
    assert lookups.technique_rows(default_techniques(spark)).count() == 8


def test_sensor_log(spark, tmp_path):
    lines = [{"timestamp": "2026-08-14T10:55:19.287741-0500", "flow_id": 1, "src_ip": "a", "src_port": None, "signature": "S"},
             {"timestamp": "t", "flow_id": 2, "interface": "ens37", "signature": "S"}, {"signature": "T", "dest_port": 80}]
    path = write(tmp_path / "s.json", "\n".join(json.dumps(x) for x in lines) + "\n\n  \n")
    alerts = lookups.read_sensor_alerts(spark, path)
    assert [tuple(r) for r in lookups.signature_counts(alerts).collect()] == [("S", 2), ("T", 1)]
    assert lookups.count_records(spark, path) == 3
    assert lookups.count_records(spark, str(tmp_path / "absent.json")) is None


@pytest.mark.parametrize("size", [4 << 20, 50])
def test_digests_pass_buffers_in_order(spark, tmp_path, size):
    rng = random.Random(size)
    long = b"".join(bytes(rng.randrange(256) for _ in range(rng.randrange(40))) + b"\n" for _ in range(3000))
    contents = {"a.csv": b"x\ny\n", "no end.csv": b"x\ny", "empty.csv": b"", "breaks.csv": b"\n\n\r\n", "long.csv": long,
                "long no end.csv": long[:-1] + b"z", "packed.csv.gz": gzip.compress(b"x\n" * 500, mtime=0)}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")  # a file in several splits
    try:
        rows = tables.file_digests(spark, [str(tmp_path)], size).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {unquote(r["path"]).rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in rows}
    assert got == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items() if c}
