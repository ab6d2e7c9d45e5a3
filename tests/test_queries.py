import duckdb
import glob
import os
import re

import pytest

import __spark_entry__ as entry

TABLES = "/root/testdata/sf0.001"
SAMPLE = ["label_families", "file_profile", "pair_compare", "ranking_metrics_by_scenario", "threshold_choice", "proportional_sample",
          "grouped_split", "rolling_source_counts_tied", "scan_alerts", "prediction_ledger", "layer_matrix", "feature_medians",
          "family_split", "document_file_digests"]

needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="test tables absent")


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90
    assert all(re.fullmatch("[a-z][a-z0-9_]*", name) for name in queries)


@needs_tables
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for file in glob.glob(f"{TABLES}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    df = entry.queries()[name](spark, TABLES)
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    wanted = sorted((tuple(row[i] for i in order) for row in cursor.fetchall()), key=str)
    got = sorted((tuple(row) for row in df.collect()), key=str)
    assert len(got) == len(wanted) and len(got) > 0
    for a, b in zip(got, wanted):
        for x, y in zip(a, b):
            assert x == pytest.approx(y) if isinstance(x, float) else x == y


@needs_tables
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
