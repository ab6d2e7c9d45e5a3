import glob
import os

import duckdb
import pytest

from flowspark.llm import catalog

TABLES = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="test tables absent")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for file in glob.glob(f"{TABLES}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    df = catalog.QUERIES[name](spark, TABLES)
    cursor = db.execute(catalog.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    assert sorted(tuple(row[i] for i in order) for row in cursor.fetchall()) == sorted(tuple(r) for r in df.collect())
