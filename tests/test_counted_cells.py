from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.operators import models, prefix, sampling, trees
from flowspark.plans import evaluate

BOOSTING = replace(models.BINARY_CANDIDATES[3], iterations=3)


def flows(spark, rows=3000):
    return spark.range(rows).select(
        F.col("id").alias("RowID"), F.concat(F.lit("s"), F.col("id") % 3).alias("Scenario"), F.lit("x").alias("Label"),
        F.lit("f").alias("AttackFamily"), (F.col("id") * 7 % 5 < 2).cast("int").alias("BinaryLabel"),
        F.when(F.col("id") % 11 > 0, F.sin("id")).alias("a"), (F.col("id") * 7 % 5).cast("double").alias("b"))


def test_edges_lie_between_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    x = np.stack([rng.normal(size=40_000), rng.integers(0, 9, 40_000), np.floor(rng.exponential(300, 40_000))], axis=1)
    df = spark.createDataFrame(x.tolist(), "x0 double, x1 double, x2 double").repartition(7)
    for found, column in zip(trees.bin_edges(df, df.columns), np.sort(x, axis=0).T):
        ranks = np.maximum(-(-len(column) * np.arange(trees.BINS) // (trees.BINS - 1)), 1) - 1
        values = np.unique(column[ranks])
        assert found.tolist() == ((values[:-1] / 2 + values[1:] / 2)).tolist()


def test_all_rows_are_a_sample_without_ranks(spark, monkeypatch):
    df = flows(spark)
    monkeypatch.setattr(sampling, "hash_segments", lambda *others, **more: pytest.fail("rows ranked"))
    for size in (3000, 1 << 40):
        assert sampling.proportional_sample(df, size).exceptAll(df).isEmpty() and sampling.proportional_sample(df, size).count() == 3000


def test_holdout_counts_cells_once_and_keeps_no_rows(spark, monkeypatch):
    df, names = flows(spark), ["a", "b"]
    train = df.where("Scenario <> 's1'")
    alone = models.fit_detector(train, BOOSTING, names, "BinaryLabel")
    told = models.fit_detector(train, BOOSTING, names, "BinaryLabel",
                               counts=prefix.cell_counts(df, names, ["Scenario"]).where("Scenario <> 's1'"))
    present = sorted(r["a"] for r in train.where("a IS NOT NULL").collect())
    assert alone.medians == told.medians and told.medians["a"] == pytest.approx(float(np.median(present)))
    for left, right in zip(alone.ensemble.edges, told.ensemble.edges):
        assert left.tolist() == right.tolist()
    points = np.random.default_rng(1).uniform(-1, 4, (50, 2))
    assert (alone.ensemble.probabilities(points) == told.ensemble.probabilities(points)).all()
    monkeypatch.setattr(models, "cell_counts", lambda *others: pytest.fail("cells counted in a fold"))
    monkeypatch.setattr(models, "spread", lambda *others: pytest.fail("training rows dealt and cached"))
    found = {r["Scenario"]: r for r in evaluate.evaluate_holdout(df, names, BOOSTING, 1 << 40)["metrics"].collect()}
    assert {k: r["training_rows"] for k, r in found.items() if k.startswith("s")} == {"s0": 2000, "s1": 2000, "s2": 2000}
    assert found[evaluate.ALL_FOLDS]["test_rows"] == 3000 and found[evaluate.ALL_FOLDS]["errors"] == 0
