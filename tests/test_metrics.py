import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.operators import metrics, prefix
from flowspark.schema import OPERATIONAL_FAMILIES


def cells(spark, tn, fp, fn, tp):
    return spark.createDataFrame([(tn, fp, fn, tp)], "true_negative long, false_positive long, false_negative long, true_positive long")


def test_published_binary_metrics(spark):
    got = metrics.binary_metrics(cells(spark, 64111, 95, 12, 15782)).first()
    wanted = {"accuracy": 0.9986625, "balanced_accuracy": 0.9988803026534776, "precision_attack": 0.9940165018580336,
              "recall_attack": 0.9992402178042294, "f1_attack": 0.9966215149505857, "f2_attack": 0.998191086992271,
              "specificity": 0.9985203875027256, "false_positive_rate": 0.001479612497274398,
              "false_negative_rate": 0.0007597821957705458, "matthews_correlation": 0.9957930434183587}
    for name, value in wanted.items():
        assert got[name] == pytest.approx(value, abs=1e-12), name
    assert got["errors"] == 107 and got["test_rows"] == 80000


def test_absent_class_rules(spark):
    none = metrics.binary_metrics(cells(spark, 5, 1, 0, 0)).first()
    assert none["recall_attack"] is None and none["f2_attack"] is None and none["balanced_accuracy"] is None
    assert none["matthews_correlation"] is None and none["precision_attack"] == 0.0
    zero = metrics.binary_metrics(cells(spark, 5, 1, 0, 0), "zero").first()
    assert zero["recall_attack"] == 0.0 and zero["f1_attack"] == 0.0 and zero["matthews_correlation"] == 0.0
    assert zero["balanced_accuracy"] == pytest.approx(5 / 6)


def test_published_family_report(spark):
    table = [[48981, 1, 0, 1, 0], [12, 19985, 0, 3, 0], [0, 0, 2866, 0, 0], [13, 1, 0, 200, 0], [0, 0, 0, 0, 402]]
    pairs = spark.createDataFrame([(OPERATIONAL_FAMILIES[i], OPERATIONAL_FAMILIES[j], n)
                                   for i, row in enumerate(table) for j, n in enumerate(row) if n], "actual string, predicted string, n long")
    got = metrics.multiclass_metrics(pairs).first()
    wanted = {"accuracy": 0.9995722072724764, "balanced_accuracy": 0.9867577217520249, "macro_precision": 0.9959563900410309,
              "macro_recall": 0.9867577217520249, "macro_f1": 0.9912474239481979, "macro_f2": 0.9885282835665278,
              "weighted_f1": 0.9995692416245102}
    for name, value in wanted.items():
        assert got[name] == pytest.approx(value, abs=1e-9), name
    report = {r["class"]: r for r in metrics.classification_report(pairs).collect()}
    assert report["Web Attack"]["precision"] == pytest.approx(0.9803921568627451)
    assert report["weighted avg"]["precision"] == pytest.approx(0.9995696454009553)
    assert report["accuracy"]["support"] == pytest.approx(0.9995722072724764)
    assert report["macro avg"]["support"] == 72465.0


def brute_ranking(labels, scores):
    pos = [s for l, s in zip(labels, scores) if l]
    neg = [s for l, s in zip(labels, scores) if not l]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, last = 0.0, 0.0
    for t in sorted(set(scores), reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(n >= t for n in neg)
        ap += (tp / len(pos) - last) * tp / (tp + fp)
        last = tp / len(pos)
    return auc, ap


def test_ranking_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for key in ("a", "b"):
        for i in range(300):
            label = int(rng.random() < 0.4)
            # Most scores crowd into a tiny range, so the bins are cut a second time.
            score = round(rng.random() * 1e-4, 7) if i % 10 else rng.random()
            rows.append((key, label, score + label * 1e-5))
    rows += [("one", 0, 0.1), ("one", 0, 0.2)]
    df = spark.createDataFrame(rows, "k string, BinaryLabel int, Score double")
    got = {r["k"]: r for r in metrics.ranking_metrics(df, ["k"]).collect()}
    for key in ("a", "b"):
        auc, ap = brute_ranking([r[1] for r in rows if r[0] == key], [r[2] for r in rows if r[0] == key])
        assert got[key]["roc_auc"] == pytest.approx(auc) and got[key]["pr_auc"] == pytest.approx(ap)
    assert got["one"]["roc_auc"] is None and got["one"]["pr_auc"] is None


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    data = {"a": rng.normal(size=501), "b": np.round(rng.exponential(size=400), 2), "c": np.array([7.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None)], "k string, v double")
    probs = [0.0, 0.01, 0.5, 0.77, 0.99, 1.0]
    for row in prefix.exact_quantiles(df, "v", probs, ["k"]).collect():
        assert row["quantile"] == pytest.approx(np.quantile(data[row["k"]], row["prob"])), row


def test_threshold_sweep_and_choice(spark):
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 2, 500)
    scores = np.round(np.clip(labels * 0.3 + rng.random(500) * 0.7, 0, 1), 3)
    df = spark.createDataFrame([(int(l), float(s)) for l, s in zip(labels, scores)], "BinaryLabel int, Score double")
    grid = metrics.grid_thresholds(df)
    expected = sorted(set(i / 100 for i in range(1, 100)) | set(np.quantile(scores, [i / 100 for i in range(1, 100)])))
    assert np.allclose(sorted(grid), expected) or abs(len(grid) - len(expected)) <= 3
    for row in metrics.threshold_sweep(df, grid).collect():
        flagged = scores >= row["threshold"]
        assert row["true_positive"] == int((flagged & (labels == 1)).sum())
        assert row["false_positive"] == int((flagged & (labels == 0)).sum())
        assert row["true_negative"] == int((~flagged & (labels == 0)).sum())
    sweep = metrics.threshold_sweep(df, grid)
    best = metrics.pick_threshold(sweep, 0.1).first()
    rows = [r for r in sweep.collect() if r["false_positive_rate"] <= 0.1]
    assert best["f2_attack"] == max(r["f2_attack"] for r in rows)
    fallback = metrics.pick_threshold(sweep, -1.0).first()
    assert fallback["f2_attack"] == max(r["f2_attack"] for r in sweep.collect())


def test_histogram_matches_numpy(spark):
    values = {0: [0.1, 0.2, 0.2, 0.9], 1: [0.5, 0.5]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "BinaryLabel int, Score double")
    got = {(r["BinaryLabel"], r["bin"]): r["rows"] for r in metrics.score_histogram(df, bins=10).collect()}
    for key, vs in values.items():
        counts, _ = np.histogram(vs, bins=10)
        assert {b: n for (k, b), n in got.items() if k == key} == {i: int(n) for i, n in enumerate(counts) if n}


def test_quantile_threshold(spark):
    scores = np.random.default_rng(2).random(1000)
    df = spark.createDataFrame([(float(s),) for s in scores], "Score double")
    row = metrics.quantile_threshold(df, 0.01).first()
    assert row["threshold"] == pytest.approx(np.quantile(scores, 0.99))
    assert row["observed_rate"] == pytest.approx((scores >= np.quantile(scores, 0.99)).mean())


def test_fold_report_uses_fold_thresholds(spark):
    rows = [("a", 1, 0.9, 0.5), ("a", 0, 0.4, 0.5), ("b", 1, 0.3, 0.2), ("b", 0, 0.1, 0.2)]
    df = spark.createDataFrame(rows, "Scenario string, BinaryLabel int, Score double, Threshold double")
    got = {r["Scenario"]: r for r in metrics.fold_report(df, "Scenario").collect()}
    assert got["ALL_SCENARIOS_AGGREGATED"]["accuracy"] == 1.0
    assert got["ALL_SCENARIOS_AGGREGATED"]["roc_auc"] == pytest.approx(0.75)


def test_designs_tolerate_absent_runs(spark):
    a = spark.createDataFrame([(0.5, 0.6)], "accuracy double, roc_auc double")
    b = spark.createDataFrame([(0.7,)], "accuracy double")
    rows = metrics.compare_designs({"x": a, "y": None, "z": b}, ["accuracy", "roc_auc"]).collect()
    assert [tuple(r) for r in rows] == [("x", 0.5, 0.6), ("z", 0.7, None)]


def test_normalised_confusion(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "x string, y string")
    rows = metrics.confusion_matrix(df, "x", "y", ["a", "b", "c"], normalize=True).orderBy("position").collect()
    assert [tuple(r)[2:] for r in rows] == [(0.5, 0.5, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 0.0)]


def test_running_totals_keep_all_columns(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("o"), F.lit(1).alias("n"))
    rows = prefix.running_totals(df, ["k"], "o", ["n"]).collect()
    for row in rows:
        assert row["cum_n"] == int(row["o"]) // 3 + 1


def test_keys_may_be_null_and_values_crowd(spark):
    rng = random.Random(12)
    rows = [(None if k % 3 else "a", k % 2, 10 ** rng.uniform(-6, 6)) for k in range(400)]
    df = spark.createDataFrame(rows, "k string, BinaryLabel int, Score double")
    assert metrics.ranking_metrics(df, ["k"]).count() == 2
    for row in prefix.exact_quantiles(df, "Score", [0.1, 0.5], ["k"]).collect():
        values = [s for k, _, s in rows if k == row["k"]]
        assert row["quantile"] == pytest.approx(np.quantile(values, row["prob"]))
