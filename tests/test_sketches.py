import numpy as np
import pytest

from flowspark.operators import sketches


def test_merged_sketches_stay_within_their_bounds(spark):
    rng = np.random.default_rng(5)
    values = np.round(rng.lognormal(size=20_000), 3)
    rows = [(f"s{k % 3}", k % 11, float(v) if k % 50 else None) for k, v in enumerate(values)]
    stored = sketches.sketch_table(spark.createDataFrame(rows, "s string, d int, `a.b` double"), ["s", "d"], ["a.b"], ["a.b"])
    assert stored.count() == 33 and sum(r["rows"] for r in stored.collect()) == 20_000
    probs = [0.01, 0.5, 0.9]
    for keys in ([], ["s"]):
        for r in sketches.merged_quantiles(stored, "a.b", probs, keys).collect():
            own = np.array([v for s, _, v in rows if v is not None and (not keys or s == r["s"])])
            assert abs((own <= r["quantile"]).mean() - r["prob"]) <= sketches.RANK_ERROR + 1 / len(own)
        for r in sketches.merged_distinct(stored, "a.b", keys).collect():
            own = {v for s, _, v in rows if v is not None and (not keys or s == r["s"])}
            assert r["distinct"] == pytest.approx(len(own), rel=sketches.DISTINCT_ERROR)


def test_groups_without_values(spark):
    rows = [("a", 1, None), ("a", 2, 4.0), ("b", 1, None)]
    stored = sketches.sketch_table(spark.createDataFrame(rows, "s string, d int, v double"), ["s", "d"], ["v"], ["v"])
    got = {r["s"]: r["distinct"] for r in sketches.merged_distinct(stored, "v", ["s"]).collect()}
    assert got == {"a": 1, "b": 0}
    found = {r["s"]: r["quantile"] for r in sketches.merged_quantiles(stored, "v", [0.5], ["s"]).collect()}
    assert found["a"] == 4.0 and found.get("b") is None
    assert sketches.sketch_table(spark.createDataFrame(rows[:1], "s string, d int, v double").limit(0), ["s"], ["v"]).count() == 0
