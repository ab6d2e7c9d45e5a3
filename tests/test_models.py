import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.operators import iforest, models, scoring, soc
from flowspark.plans import catalog_models, evaluate, preprocess, score
from flowspark.schema import OPERATIONAL_FAMILIES, SEVERITIES
from flowspark.streaming.incremental import score_new_files
from flowspark.techniques import default_techniques

FEATURES = ["Flow Bytes/s", "a.b", "c"]
SMALL = dict(trees=5, depth=4, iterations=5)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(1200):
        attack = int(rng.random() < 0.4)
        family = OPERATIONAL_FAMILIES[i % 5]
        x = float(rng.normal(3 * attack, 1))
        rows.append((f"s{i % 4}", i, f"g{i % 150}", "BENIGN" if not attack else "DDoS", "BENIGN" if not attack else "DDoS", attack, family,
                     x if i % 9 else None, float(OPERATIONAL_FAMILIES.index(family) + rng.normal(0, 0.2)), float(rng.random())))
    df = spark.createDataFrame(rows, "Scenario string, RowID long, GroupID string, Label string, AttackFamily string, BinaryLabel int, "
                                     "OperationalFamily string, `Flow Bytes/s` double, `a.b` double, c double")
    return df.withColumn("Stratum", F.concat_ws("::", "Scenario", F.col("BinaryLabel").cast("string"))).cache()


def test_medians_and_moments(spark, data):
    medians = models.feature_medians(data, FEATURES)
    pdf = data.select(*[f"`{f}`" for f in FEATURES]).toPandas()
    for f in FEATURES:
        assert medians[f] == pytest.approx(pdf[f].median())
    moments = models.feature_moments(data, medians)
    filled = pdf["Flow Bytes/s"].fillna(medians["Flow Bytes/s"])
    assert moments["Flow Bytes/s"] == pytest.approx((filled.mean(), filled.std(ddof=0)))
    empty = spark.createDataFrame([(None,)], "x double")
    assert models.feature_medians(empty, ["x"]) == {"x": 0.0}
    assert models.impute(data, medians).where("`Flow Bytes/s` IS NULL").count() == 0


@pytest.mark.parametrize("candidate", models.BINARY_CANDIDATES, ids=lambda c: c.name)
def test_binary_candidates(spark, data, candidate, tmp_path):
    detector = models.fit_detector(data, replace(candidate, **SMALL), FEATURES, "BinaryLabel")
    scored = models.score_binary(detector, data)
    report = models.binary_report(scored, 0.5).first()
    if candidate.kind == "prior":
        assert report["roc_auc"] == 0.5
    else:
        assert report["roc_auc"] > 0.95
    models.save_detector(spark, detector, str(tmp_path / "m"))
    again = models.load_detector(spark, str(tmp_path / "m"))
    assert again.features == FEATURES and again.threshold == 0.5
    a, b = ({r["RowID"]: r["AttackProbability"] for r in models.score_binary(d, data).collect()} for d in (detector, again))
    assert a == pytest.approx(b)


@pytest.mark.parametrize("candidate", models.FAMILY_CANDIDATES, ids=lambda c: c.name)
def test_family_candidates(data, candidate):
    attacks = data.where("BinaryLabel = 1")
    detector = models.fit_detector(attacks, replace(candidate, **SMALL), FEATURES, "OperationalFamily", OPERATIONAL_FAMILIES)
    scored = models.score_family(detector, attacks)
    total = sum(F.col(f"`Probability::{c}`") for c in OPERATIONAL_FAMILIES)
    low, high = scored.agg(F.min(total), F.max(total)).first()
    assert low == pytest.approx(1.0) and high == pytest.approx(1.0)
    accuracy = models.family_report(scored).first()["accuracy"]
    assert accuracy > 0.9 if candidate.kind != "prior" else accuracy < 0.4


def test_comparison_ranks_by_f2(data):
    few = [replace(c, **SMALL) for c in models.BINARY_CANDIDATES[:3]]
    table, winner = models.compare_binary(data.where("RowID < 800"), data.where("RowID >= 800"), FEATURES, few)
    rows = table.collect()
    assert len(rows) == 3 and rows[0]["model"] == winner and winner != "Prior"
    assert [r["f2_attack"] for r in rows] == sorted((r["f2_attack"] for r in rows), reverse=True)
    assert rows[0]["prediction_throughput_flows_per_second"] > 0


def test_tree_samples_are_exact(spark, data):
    ids = ["Scenario", "RowID"]
    rows = iforest.tree_samples(data.select(*ids), ids, 7, 100, data.count())
    assert {r["tree"]: r["count"] for r in rows.groupBy("tree").count().collect()} == {t: 100 for t in range(7)}
    assert rows.select("tree", "RowID").distinct().count() == 700


def test_tree_shape():
    rng = np.random.default_rng(0)
    points = rng.normal(size=(256, 3))
    points[:, 2] = 1.0
    tree = iforest.grow_tree(points, 8, np.random.default_rng(1)).set_index("node")
    assert not (tree["feature"] == 2).any()
    inner = tree[tree["feature"] >= 0]
    for _, node in inner.iterrows():
        assert tree.loc[int(node["left"]), "rows"] + tree.loc[int(node["left"]) + 1, "rows"] == node["rows"]
    assert tree[tree["feature"] < 0]["rows"].sum() == 256
    flat = iforest.grow_tree(np.ones((5, 2)), 3, rng)
    assert len(flat) == 1 and flat["path"][0] == pytest.approx(float(iforest.mean_path(5)))


def test_forest(spark, data, tmp_path):
    benign = data.where("BinaryLabel = 0")
    forest = iforest.fit_isolation_forest(benign, FEATURES, trees=40, max_samples=128)
    again = iforest.fit_isolation_forest(benign.repartition(5), FEATURES, trees=40, max_samples=128)
    assert forest.nodes.sort_values(["tree", "node"]).reset_index(drop=True).equals(again.nodes.sort_values(["tree", "node"]).reset_index(drop=True))
    outliers = spark.createDataFrame([(90.0, -50.0, 9.0), (0.0, 2.0, 0.5)], "`Flow Bytes/s` double, `a.b` double, c double")
    far, near = (r["AnomalyScore"] for r in forest.score(outliers).orderBy(F.desc("c")).collect())
    assert far > near and 0 < near < far < 1
    threshold, observed = iforest.calibrate(forest, benign, 0.05)
    assert observed == pytest.approx(0.05, abs=0.02) and forest.threshold == threshold
    forest.save(spark, str(tmp_path / "f"))
    loaded = iforest.IsolationForest.load(spark, str(tmp_path / "f"))
    a, b = ({r["RowID"]: r["AnomalyScore"] for r in f.score(data).collect()} for f in (forest, loaded))
    assert a == b and loaded.threshold == threshold
    # Reference score of one row by walking the trees in plain Python.
    row = data.where("RowID = 1").first()
    point = [row[f] if row[f] is not None else forest.medians[f] for f in FEATURES]
    paths = []
    for _, tree in forest.nodes.groupby("tree"):
        tree, at = tree.set_index("node"), 0
        while tree.loc[at, "feature"] >= 0:
            at = int(tree.loc[at, "left"]) + int(point[int(tree.loc[at, "feature"])] > tree.loc[at, "cut"])
        paths.append(tree.loc[at, "path"])
    assert a[1] == pytest.approx(2 ** (-np.mean(paths) / float(iforest.mean_path(forest.sample_rows))))
    with pytest.raises(ValueError):
        iforest.fit_isolation_forest(benign.where("false"), FEATURES)


@pytest.fixture(scope="module")
def bundle(spark, data):
    binary = models.fit_detector(data, replace(models.BINARY_CANDIDATES[3], **SMALL), FEATURES, "BinaryLabel")
    family = models.fit_detector(data.where("BinaryLabel = 1"), replace(models.FAMILY_CANDIDATES[2], **SMALL), FEATURES,
                                 "OperationalFamily", OPERATIONAL_FAMILIES)
    forest = iforest.fit_isolation_forest(data.where("BinaryLabel = 0"), FEATURES, trees=20, max_samples=64)
    iforest.calibrate(forest, data.where("BinaryLabel = 0"), 0.05)
    return score.Bundle(binary, family, forest, default_techniques(spark))


def test_ledger(spark, data, bundle, tmp_path):
    ledger = score.analyze(data, bundle)
    rows = ledger.collect()
    assert len(rows) == 1200 and ledger.columns[:5] == ["RowID", "Scenario", "Label", "AttackFamily", "BinaryLabel"]
    for r in rows:
        known, odd = r["KnownAttackProbability"] >= 0.5, r["AnomalyScore"] >= bundle.anomaly.threshold
        assert r["BinaryPrediction"] == ("ATTACK" if known else "BENIGN") and r["AnomalyFlag"] == odd
        assert r["AlertSeverity"] == ("Critical" if known and odd else "High" if known else "Medium" if odd else "Low")
        assert (r["PredictedAttackFamily"] == "Not run") == (not known) and (r["FamilyConfidence"] is None) == (not known)
        assert r["BinaryCorrect"] == (r["BinaryLabel"] == int(known))
    score.save_bundle(spark, bundle, str(tmp_path / "b"))
    loaded = score.load_bundle(spark, str(tmp_path / "b"))
    assert {r["RowID"]: r["AlertSeverity"] for r in score.analyze(data, loaded).collect()} == {r["RowID"]: r["AlertSeverity"] for r in rows}
    quality = score.quality_report(data, ledger, bundle).first()
    assert quality["known_attack_alerts"] == sum(r["BinaryPrediction"] == "ATTACK" for r in rows)
    with pytest.raises(FileNotFoundError):
        score.load_bundle(spark, str(tmp_path / "nothing"))
    with pytest.raises(ValueError):
        score.Bundle(replace(bundle.binary, features=["x"]), bundle.family, bundle.anomaly, bundle.techniques)


def test_scoring_files_and_chunks(spark, data, bundle, tmp_path):
    source = tmp_path / "in"
    data.select("RowID", *[f"`{f}`" for f in FEATURES]).repartition(3).write.option("header", True).csv(str(source))
    files = [str(p) for p in sorted(source.glob("*.csv"))]
    totals = score.score_files(spark, files, str(tmp_path / "out"), bundle)
    expected = soc.run_summary(score.analyze(data, bundle)).first()
    assert totals == {k: expected[k] for k in totals} and totals["rows"] == 1200
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1200
    args = (spark, str(source), ["RowID", *FEATURES], bundle, str(tmp_path / "chunks"), str(tmp_path / "state"), 1)
    assert score_new_files(*args) == 3 and score_new_files(*args) == 0
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    assert chunks.count() == 1200 and chunks.where("BinaryPrediction = 'ATTACK'").count() == totals["known_attack_alerts"]


def test_fusion_and_enrichment(spark):
    rows = [(0.9, "Port Scan", 0.8, 0.9), (0.9, "Unheard Of", 0.7, 0.1), (0.1, "Port Scan", 0.9, 0.9), (0.1, "x", 0.9, 0.1), (0.5, "Denial of Service", 0.6, 0.5)]
    df = spark.createDataFrame(rows, "KnownAttackProbability double, _family string, _confidence double, AnomalyScore double")
    got = scoring.finish_ledger(df, default_techniques(spark), 0.5, 0.5).collect()
    by_probability = {(r["KnownAttackProbability"], r["AnomalyScore"]): r for r in got}
    assert by_probability[(0.9, 0.9)]["AlertSeverity"] == "Critical" and by_probability[(0.9, 0.9)]["MITRETechniqueID"] == "T1046"
    assert by_probability[(0.9, 0.1)]["MITRETactic"] == "Analyst Review"
    assert by_probability[(0.1, 0.9)]["MITRETactic"] == "Unmapped" and by_probability[(0.1, 0.9)]["AlertSeverity"] == "Medium"
    assert by_probability[(0.1, 0.1)]["MITRETactic"] == "" and by_probability[(0.1, 0.1)]["PredictedAttackFamily"] == "Not run"
    assert by_probability[(0.5, 0.5)]["MITRETechniqueID"] == "T1498; T1499" and by_probability[(0.5, 0.5)]["AlertSeverity"] == "Critical"
    with pytest.raises(ValueError):
        scoring.enrich(scoring.fuse(df, 0.5, 0.5), default_techniques(spark).where("family <> 'BENIGN'"))


def test_analyst_reports(spark):
    df = spark.createDataFrame([("High", "a", 0.9, 0.1, 1), ("Low", "a", 0.1, -0.1, 2), ("Critical", None, 0.8, 0.1, 3), ("High", "a", 0.95, 0.0, 4)],
                               "AlertSeverity string, SourceIP string, KnownAttackProbability double, AnomalyMargin double, RowID long")
    assert [r["RowID"] for r in soc.alert_queue(df).collect()] == [3, 4, 1]
    assert [tuple(r) for r in soc.top_sources(df).collect()] == [("a", 2), ("MISSING", 1)]
    levels = {r["AlertSeverity"]: r["flows"] for r in soc.severity_counts(df).collect()}
    assert levels == dict(zip(SEVERITIES, [1, 2, 0, 1]))


def test_evaluation_jobs(data):
    linear = replace(models.BINARY_CANDIDATES[1], **SMALL)
    grouped = evaluate.evaluate_grouped(data, FEATURES, linear, sample_size=1000, max_fpr=0.05)
    row = grouped.metrics.first()
    assert row["recall_attack"] > 0.6 and grouped.detector.threshold > 0 and grouped.ledger.count() == row["test_rows"]
    binary = evaluate.evaluate_binary(data, FEATURES, 1000, [linear])
    assert binary.detector.name == linear.name and binary.metrics.first()["test_rows"] == 240
    folds = evaluate.evaluate_holdout(data, FEATURES, linear, 800)
    assert folds["metrics"].count() == 5 and folds["ledger"].count() == 1200
    assert folds["errors"].count() == folds["metrics"].where("Scenario LIKE 'ALL%'").first()["errors"]
    forest, tables = evaluate.evaluate_anomaly(data, FEATURES, 500, trees=10, max_samples=64)
    assert tables["metrics"].count() == 5 and 0 < forest.threshold < 1
    family = evaluate.evaluate_family(data.where("BinaryLabel = 1"), FEATURES, 80, [replace(models.FAMILY_CANDIDATES[2], trees=20, depth=8)])
    assert family.tables["confusion"].count() == 5 and family.metrics.first()["accuracy"] > 0.8


def captures(folder, extra=""):
    folder.mkdir()
    for name, label in (("Monday.pcap_ISCX.csv", "BENIGN"), ("Friday.pcap_ISCX.csv", "PortScan")):
        head = f" Destination Port, Flow Duration,Total Fwd Packets,Total Backward Packets,Fwd Header Length,Fwd Header Length{extra and ',Source IP,Timestamp'}, Label"
        rows = [f"{80 + i},{'Infinity' if i == 3 else i},{i},1,20,20{extra},{label if i % 2 else 'BENIGN'}" for i in range(10)]
        (folder / name).write_text("\n".join([head, *rows, "," * (head.count(",")), ""]))
    return [str(p) for p in sorted(folder.glob("*.csv"))]


def test_preprocessing_and_audit(spark, tmp_path):
    features, context = captures(tmp_path / "a"), captures(tmp_path / "b", ",10.0.0.1,4/7/2017 8:54")
    summary = preprocess.preprocess(spark, features, context, str(tmp_path / "out")).first()
    assert summary["rows"] == 20 and summary["infinity_values"] == 2 and summary["all_pairs_match"]
    rows = spark.read.parquet(str(tmp_path / "out" / "features"))
    assert rows.columns == ["RowID", "SourceFile", "Destination Port", "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
                            "Fwd Header Length", "LabelRaw", "Label", "BinaryLabel", "AttackFamily", "Scenario"]
    assert sorted(r["RowID"] for r in rows.where("Scenario = 'friday'").collect()) == list(range(10))
    side = spark.read.parquet(str(tmp_path / "out" / "context"))
    grouped = evaluate.with_groups(rows.withColumn("BinaryLabel", F.col("BinaryLabel").cast("int")), side)
    assert grouped.where("Scenario = 'monday' AND RowID = 0").first()["GroupID"] == "monday|10.0.0.1|MISSING|80.0|MISSING|2017-07-04 08:45:00"
    tables = preprocess.audit(spark, {"machine_learning": features, "generated_flows": context})
    inventory = {(r["collection"], r["scenario_key"]): r for r in tables["inventory"].collect()}
    one = inventory[("machine_learning", "friday")]
    assert (one["physical_rows"], one["valid_rows"], one["empty_rows"], one["columns"], one["unique_columns"]) == (11, 10, 1, 7, 6)
    assert one["duplicate_header_names"] == "Fwd Header Length" and one["infinite_values"] == 1
    pairs = tables["pairs"].collect()
    assert all(r["label_counts_match"] and r["right_extra_columns"] == "Source IP; Timestamp" for r in pairs)
    assert {r["label"]: r["count"] for r in tables["label_distribution"].where("collection = 'machine_learning'").collect()} == {"BENIGN": 15, "PortScan": 5}
    assert tables["schema_presence"].where("NOT present_in_all_files").count() == 0
    with pytest.raises(ValueError, match="order"):
        preprocess.preprocess_features(spark, features, ["x"])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables absent")
def test_family_queries_try_all_candidates_and_test_on_other_groups(spark, monkeypatch):
    seen = {}

    def watched(attacks, features, candidates=models.FAMILY_CANDIDATES):
        seen["kinds"] = [c.kind for c in candidates]
        return evaluate.Evaluation(None, None, None, {"report": None})

    monkeypatch.setattr(evaluate, "evaluate_family", watched)
    catalog_models.family_evaluation(spark, "/root/testdata/sf0.001")
    assert seen["kinds"] == ["prior", "linear", "forest", "boosting"]
    monkeypatch.setattr(models, "fit_detector", lambda df, *others: seen.update(fit=df))
    monkeypatch.setattr(models, "score_family", lambda detector, df: df)
    monkeypatch.setattr(models, "family_report", lambda df: df)
    test = catalog_models.family_boosting(spark, "/root/testdata/sf0.001")
    groups = [{r[0] for r in df.select("GroupID").distinct().collect()} for df in (seen["fit"], test)]
    assert all(groups) and not groups[0] & groups[1]
