from collections import defaultdict

import pytest

from flowspark.operators import prefix


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_kept_rows_have_the_totals_of_all_rows(spark, parts):
    """Most rows only add; many of them share their place in the order, also where a range ends."""
    rows = [(None if k % 3 == 0 else f"k{k % 2}", k // 40, int(k % 40 == 39), k, k % 5 - 1) for k in range(6000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "name string, at long, own int, id long, delta int").repartition(7)
        found = prefix.running_totals(df, ["name"], ["at", "own"], ["delta"], keep="own")
        assert found.columns == ["name", "at", "own", "id", "cum_delta"]
        got = {r.id: r.cum_delta for r in found.collect()}
        whole = prefix.running_totals(df, ["name"], ["at", "own"], ["delta"])
        assert {r.id: r.cum_delta for r in whole.where("own = 1").collect()} == got and whole.count() == 6000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total, wanted = defaultdict(int), {}
    for name, at, own, id_, delta in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        total[name] += delta
        if own:
            wanted[id_] = total[name]
    assert got == wanted and len(got) == 150
