"""Queries that train, score and evaluate models on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.operators import iforest, models, profile, sampling, soc
from flowspark.plans import evaluate, score
from flowspark.plans.registry import query, r, rounded
from flowspark.plans.workload import flows, table, with_flows
from flowspark.schema import OPERATIONAL_FAMILIES
from flowspark.session import materialize, scratch_path
from flowspark.techniques import default_techniques

FEATURES = ["port", "response", "hour", "syn", "reset", "protocol"]
BINARY, FAMILY = models.BINARY_CANDIDATES, models.FAMILY_CANDIDATES
FOREST, BOOSTING = BINARY[2], BINARY[3]


def feature_flows(spark, sf):
    """Flows with six numeric features, one of them with missing cells."""
    return flows(spark, sf).select(
        "RowID", "Scenario", "Label", "AttackFamily", "OperationalFamily", "BinaryLabel", "GroupID", "Stratum",
        F.col("DestinationPort").cast("double").alias("port"), F.col("BackwardPackets").cast("float").alias("response"),
        F.hour("Timestamp").cast("double").alias("hour"), F.col("SYNCount").cast("double").alias("syn"),
        F.col("RSTCount").cast("double").alias("reset"), F.col("Protocol").alias("protocol"),
    )


@query("feature_medians", f"""
SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, round(unnest([
  quantile_cont(l_quantity, 0.5), quantile_cont(l_extendedprice, 0.5), quantile_cont(l_discount, 0.5), quantile_cont(l_tax, 0.5)]), 6) AS median
FROM lineitem""")
def feature_medians(spark, sf):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    found = models.feature_medians(table(spark, sf, "lineitem"), names)
    return rounded(spark.createDataFrame(list(found.items()), "feature string, median double"), "median")


@query("imputed_features", with_flows(f"""
SELECT "RowID" AS row_id, {r('coalesce("Protocol", (SELECT quantile_cont("Protocol", 0.5) FROM flows))', 'protocol')} FROM flows"""))
def imputed_features(spark, sf):
    f = feature_flows(spark, sf).select("RowID", "protocol")
    filled = models.impute(f, models.feature_medians(f, ["protocol"]))
    return rounded(filled.withColumnRenamed("RowID", "row_id"), "protocol")


@query("feature_moments", f"""
SELECT feature, {r('m', 'mean')}, {r('s', 'deviation')} FROM (SELECT unnest(['l_quantity', 'l_discount']) AS feature,
  unnest([avg(l_quantity), avg(l_discount)]) AS m, unnest([stddev_pop(l_quantity), stddev_pop(l_discount)]) AS s FROM lineitem)""")
def feature_moments(spark, sf):
    items = table(spark, sf, "lineitem")
    found = models.feature_moments(items, {"l_quantity": 0.0, "l_discount": 0.0})
    rows = spark.createDataFrame([(f, m, s) for f, (m, s) in found.items()], "feature string, mean double, deviation double")
    return rounded(rows, "mean", "deviation")


@query("binary_evaluation")
def binary_evaluation(spark, sf):
    f = feature_flows(spark, sf)
    return evaluate.evaluate_binary(f, FEATURES, candidates=BINARY).metrics


@query("binary_comparison")
def binary_comparison(spark, sf):
    split = sampling.stratified_split(feature_flows(spark, sf), ["BinaryLabel"], ["RowID"])
    train, validation = (split.where(F.col("split") == s) for s in ("train", "validation"))
    return models.compare_binary(train, validation, FEATURES, BINARY)[0]


@query("grouped_evaluation")
def grouped_evaluation(spark, sf):
    return evaluate.evaluate_grouped(feature_flows(spark, sf), FEATURES, BOOSTING).metrics


@query("family_evaluation")
def family_evaluation(spark, sf):
    attacks = evaluate.attack_population(feature_flows(spark, sf)).select(*evaluate.IDS, "Label", "OperationalFamily", "GroupID", *FEATURES)
    return evaluate.evaluate_family(attacks, FEATURES, candidates=FAMILY).tables["report"]


@query("family_boosting")
def family_boosting(spark, sf):
    attacks = materialize(
        feature_flows(spark, sf).where(F.col("BinaryLabel") == 1).select("GroupID", "OperationalFamily", *FEATURES), "attacks")
    divided, _ = sampling.grouped_split_all_classes(attacks)
    split = materialize(divided, "boosting-split")
    sampling.require_isolation(split)
    train, test = split.where(F.col("split") != "test"), split.where(F.col("split") == "test")
    detector = models.fit_detector(train, FAMILY[3], FEATURES, "OperationalFamily", OPERATIONAL_FAMILIES)
    return models.family_report(models.score_family(detector, test))


@query("scenario_holdout")
def scenario_holdout(spark, sf):
    return evaluate.evaluate_holdout(feature_flows(spark, sf), FEATURES, BOOSTING)["metrics"]


@query("holdout_rows", with_flows("""
SELECT "Scenario" AS scenario, (SELECT count(*) FROM flows) - count(*) AS training_rows, count(*) AS test_rows,
  count(*) FILTER ("BinaryLabel" = 0) AS actual_benign, count(*) FILTER ("BinaryLabel" = 1) AS actual_attack, true AS cells_add_up,
  true AS timed FROM flows GROUP BY 1
UNION ALL
SELECT 'ALL_SCENARIOS_AGGREGATED', NULL, count(*), count(*) FILTER ("BinaryLabel" = 0), count(*) FILTER ("BinaryLabel" = 1), true, true FROM flows"""))
def holdout_rows(spark, sf):
    """What of a holdout does not depend on the fit: each fold's rows, and that its cells and errors add up to them. The pool
    takes in all flows."""
    table_ = evaluate.evaluate_holdout(feature_flows(spark, sf), FEATURES, BOOSTING, pool_size=1 << 40)["metrics"]
    cells = F.col("true_negative") + F.col("false_positive") + F.col("false_negative") + F.col("true_positive")
    return table_.select(
        F.col("Scenario").alias("scenario"), "training_rows", "test_rows", "actual_benign", "actual_attack",
        ((cells == F.col("test_rows")) & (F.col("errors") == F.col("false_positive") + F.col("false_negative"))).alias("cells_add_up"),
        ((F.col("fit_seconds") > 0) & (F.col("prediction_seconds") > 0) & (F.col("prediction_throughput_flows_per_second") > 0)).alias("timed"))


@query("anomaly_holdout")
def anomaly_holdout(spark, sf):
    _, tables = evaluate.evaluate_anomaly(feature_flows(spark, sf), FEATURES)
    return tables["metrics"]


@query("forest_scores")
def forest_scores(spark, sf):
    """Isolation forest over the embeddings: fit on one half of the labels, score all vectors."""
    e = table(spark, sf, "embeddings")
    names = [f"d{i}" for i in range(64)]
    wide = e.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    forest = iforest.fit_isolation_forest(wide.where(F.col("label") < 5), names, ["vec_id"])
    return forest.score(wide).select("vec_id", "label", "AnomalyScore")


@query("feature_importance")
def feature_importance(spark, sf):
    f = materialize(feature_flows(spark, sf).select("BinaryLabel", *FEATURES), "importance-flows")
    detector = models.fit_detector(f, FOREST, FEATURES, "BinaryLabel")
    return models.feature_importance(detector, spark, 20)


def bundle(spark, sf) -> score.Bundle:
    f = materialize(feature_flows(spark, sf).select("RowID", "BinaryLabel", "OperationalFamily", *FEATURES), "bundle-flows")
    binary = models.fit_detector(f, BOOSTING, FEATURES, "BinaryLabel")
    family = models.fit_detector(f.where(F.col("BinaryLabel") == 1), FAMILY[2], FEATURES, "OperationalFamily", OPERATIONAL_FAMILIES)
    benign = f.where(F.col("BinaryLabel") == 0)
    forest = iforest.fit_isolation_forest(benign, FEATURES, ["RowID"])
    iforest.calibrate(forest, benign, 0.01)
    return score.Bundle(binary, family, forest, default_techniques(spark))


_saved: dict[tuple[str, str], str] = {}


def saved_bundle(spark, sf) -> score.Bundle:
    """The bundle of a folder of tables, fitted and saved once per application and loaded from there."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _saved:
        path = scratch_path(spark, "bundle")
        score.save_bundle(spark, bundle(spark, sf), path)
        _saved[key] = path
    return score.load_bundle(spark, _saved[key])


@query("hybrid_ledger")
def hybrid_ledger(spark, sf):
    return score.analyze(feature_flows(spark, sf), saved_bundle(spark, sf))


@query("hybrid_quality")
def hybrid_quality(spark, sf):
    f, b = feature_flows(spark, sf), saved_bundle(spark, sf)
    return score.quality_report(f, score.analyze(f, b), b)


@query("hybrid_queue")
def hybrid_queue(spark, sf):
    return soc.alert_queue(score.analyze(feature_flows(spark, sf), saved_bundle(spark, sf)))


@query("readiness_checks", with_flows("""
SELECT * FROM (VALUES
  (1, 'Data rows', 'PASS', format('{:,}', (SELECT count(*) FROM flows)) || ' rows loaded'),
  (2, 'Column-name integrity', 'PASS', 'No duplicate names after BOM/whitespace cleanup'),
  (3, 'Trained model schema', 'PASS', '6/6 required features present'),
  (4, 'Numeric feature quality', 'WARNING', format('{:,}', (SELECT count(*) FILTER ("Protocol" IS NULL) FROM flows)) || ' feature cells require training-time imputation'),
  (5, 'Dynamic cross-flow context', 'NOT READY', 'Missing: source_ip, destination_ip, timestamp, destination_port, syn_count')) t(position, "check", status, detail)"""))
def readiness_checks(spark, sf):
    return profile.validation_checks(profile.validate_flows(feature_flows(spark, sf), FEATURES))


@query("input_quality", with_flows("""
SELECT count(*) AS rows_received, 6 AS required_feature_count, count(*) FILTER ("Protocol" IS NULL) AS missing_feature_cells_after_coercion,
  0 AS infinity_values_converted_to_missing, 0 AS non_numeric_values_coerced_to_missing FROM flows"""))
def input_quality(spark, sf):
    return profile.input_quality(feature_flows(spark, sf), FEATURES)
