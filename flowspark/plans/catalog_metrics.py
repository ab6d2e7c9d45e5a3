"""Queries over metrics, thresholds and reports of classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.operators import metrics, sketches
from flowspark.operators.prefix import exact_quantiles
from flowspark.plans.registry import query, r, rounded
from flowspark.plans.workload import flows, table, with_flows
from flowspark.schema import OPERATIONAL_FAMILIES
from flowspark.session import beside

METRICS = [
    "accuracy", "balanced_accuracy", "precision_attack", "recall_attack", "f1_attack", "f2_attack", "specificity",
    "false_positive_rate", "false_negative_rate", "matthews_correlation",
]


def metric_sql(null_rules: bool = True) -> str:
    """Metric columns over tn, fp, fn, tp (doubles)."""
    both, attack = "(tn + fp) > 0 AND (tp + fn) > 0", "(tp + fn) > 0" if null_rules else "true"
    empty = "NULL" if null_rules else "0"

    def safe(n, d, other="0"):
        return f"CASE WHEN ({d}) <> 0 THEN ({n}) / ({d}) ELSE {other} END"

    balanced_else = "NULL" if null_rules else f"coalesce({safe('tp', 'tp + fn', 'NULL')}, {safe('tn', 'tn + fp', 'NULL')})"
    mcc = safe("tp * tn - fp * fn", "sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)")
    return ", ".join([
        "CAST(tn + fp + fn + tp AS BIGINT) AS test_rows", "CAST(tn + fp AS BIGINT) AS actual_benign",
        "CAST(tp + fn AS BIGINT) AS actual_attack", "CAST(fp + fn AS BIGINT) AS errors",
        "CAST(tn AS BIGINT) AS true_negative", "CAST(fp AS BIGINT) AS false_positive",
        "CAST(fn AS BIGINT) AS false_negative", "CAST(tp AS BIGINT) AS true_positive",
        r("(tn + tp) / (tn + fp + fn + tp)", "accuracy"),
        r(f"CASE WHEN {both} THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 ELSE {balanced_else} END", "balanced_accuracy"),
        r(safe("tp", "tp + fp"), "precision_attack"), r(safe("tp", "tp + fn", empty), "recall_attack"),
        r(f"CASE WHEN {attack} THEN {safe('2 * tp', '2 * tp + fn + fp')} END", "f1_attack"),
        r(f"CASE WHEN {attack} THEN {safe('5 * tp', '5 * tp + 4 * fn + fp')} END", "f2_attack"),
        r(safe("tn", "tn + fp", empty), "specificity"), r(safe("fp", "tn + fp", empty), "false_positive_rate"),
        r(safe("fn", "tp + fn", empty), "false_negative_rate"),
        r(f"CASE WHEN {both} OR {str(not null_rules).lower()} THEN {mcc} END", "matthews_correlation"),
    ])


def cells_sql(score: str = '"Score"', threshold: str = "0.5", label: str = '"BinaryLabel"') -> str:
    return ", ".join(
        f"CAST(count(*) FILTER ({label} = {y} AND {score} {op} {threshold}) AS DOUBLE) AS {name}"
        for name, y, op in (("tn", 0, "<"), ("fp", 0, ">="), ("fn", 1, "<"), ("tp", 1, ">="))
    )


@query("binary_confusion", with_flows("""
SELECT "Scenario" AS scenario, count(*) FILTER ("BinaryLabel" = 0 AND "Score" < 0.5) AS true_negative,
  count(*) FILTER ("BinaryLabel" = 0 AND "Score" >= 0.5) AS false_positive,
  count(*) FILTER ("BinaryLabel" = 1 AND "Score" < 0.5) AS false_negative,
  count(*) FILTER ("BinaryLabel" = 1 AND "Score" >= 0.5) AS true_positive FROM flows GROUP BY 1"""))
def binary_confusion(spark, sf):
    return metrics.binary_confusion(flows(spark, sf), ["Scenario"]).withColumnRenamed("Scenario", "scenario")


@query("binary_metrics", with_flows(f"""
SELECT scenario, {metric_sql()} FROM (SELECT "Scenario" AS scenario, {cells_sql()} FROM flows GROUP BY 1)"""))
def binary_metrics(spark, sf):
    found = metrics.binary_metrics(metrics.binary_confusion(flows(spark, sf), ["Scenario"]))
    return rounded(found.withColumnRenamed("Scenario", "scenario"), *METRICS)


@query("binary_metrics_zero_rule", with_flows(f"""
SELECT scenario, {metric_sql(False)} FROM (SELECT "Scenario" AS scenario, {cells_sql()} FROM flows GROUP BY 1)"""))
def binary_metrics_zero_rule(spark, sf):
    found = metrics.binary_metrics(metrics.binary_confusion(flows(spark, sf), ["Scenario"]), "zero")
    return rounded(found.withColumnRenamed("Scenario", "scenario"), *METRICS)


@query("document_label_agreement", f"""
SELECT source, {metric_sql()} FROM (
  SELECT source, {cells_sql("CAST(1 - quality AS DOUBLE)", "0.5", "toxic")} FROM labels JOIN documents USING (doc_id) GROUP BY 1)""")
def document_label_agreement(spark, sf):
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    found = metrics.binary_confusion(joined.withColumn("s", 1.0 - F.col("quality")), ["source"], "toxic", "s")
    return rounded(metrics.binary_metrics(found), *METRICS)


RANK_SQL = """
SELECT {keys} {auc}, {ap} FROM (
  SELECT {keys} pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (
    SELECT {raw} "Score" AS s, CAST(count(*) FILTER ("BinaryLabel" = 1) AS DOUBLE) AS pos,
      CAST(count(*) FILTER ("BinaryLabel" = 0) AS DOUBLE) AS neg FROM flows GROUP BY ALL)
  WINDOW w AS ({part} ORDER BY s DESC)) {group}"""
AUC = r("CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) END", "roc_auc")
AP = r("CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * tp / (tp + fp)) / sum(pos) END", "pr_auc")


@query("ranking_metrics_by_scenario", with_flows(RANK_SQL.format(
    keys="scenario,", raw='"Scenario" AS scenario,', part="PARTITION BY scenario", group="GROUP BY 1", auc=AUC, ap=AP)))
def ranking_metrics_by_scenario(spark, sf):
    found = metrics.ranking_metrics(flows(spark, sf), ["Scenario"])
    return rounded(found.withColumnRenamed("Scenario", "scenario"), "roc_auc", "pr_auc")


@query("ranking_metrics", with_flows(RANK_SQL.format(keys="", raw="", part="", group="", auc=AUC, ap=AP)))
def ranking_metrics(spark, sf):
    return rounded(metrics.ranking_metrics(flows(spark, sf)), "roc_auc", "pr_auc")


@query("curve_points", with_flows(f"""
SELECT s AS threshold, {r('fp / n', 'false_positive_rate')}, {r('tp / p', 'true_positive_rate')},
  {r('tp / (tp + fp)', 'precision')}, {r('tp / p', 'recall')} FROM (
  SELECT s, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM (
    SELECT "Score" AS s, CAST(count(*) FILTER ("BinaryLabel" = 1) AS DOUBLE) AS pos,
      CAST(count(*) FILTER ("BinaryLabel" = 0) AS DOUBLE) AS neg FROM flows GROUP BY 1)
  WINDOW w AS (ORDER BY s DESC))"""))
def curve_points(spark, sf):
    return rounded(metrics.curve_points(flows(spark, sf)), "false_positive_rate", "true_positive_rate", "precision", "recall")


SWEEP_SQL = f"""
thresholds AS (SELECT CAST(i AS DOUBLE) / 100 AS threshold FROM range(1, 100) t(i)),
sweep AS (SELECT threshold, {metric_sql()} FROM (
  SELECT threshold, {cells_sql(threshold='threshold')} FROM thresholds, flows GROUP BY 1))"""


@query("threshold_sweep", with_flows(f", {SWEEP_SQL} SELECT * FROM sweep"))
def threshold_sweep(spark, sf):
    f = flows(spark, sf)
    return rounded(metrics.threshold_sweep(f, metrics.grid_thresholds(f, quantiles=False)), *METRICS)


@query("threshold_choice", with_flows(f""", {SWEEP_SQL}
SELECT * FROM sweep ORDER BY false_positive_rate <= 0.02 DESC, f2_attack DESC, recall_attack DESC, precision_attack DESC, threshold LIMIT 1"""))
def threshold_choice(spark, sf):
    f = flows(spark, sf)
    sweep = rounded(metrics.threshold_sweep(f, metrics.grid_thresholds(f, quantiles=False)), *METRICS)
    return metrics.pick_threshold(sweep, 0.02)


@query("quantile_grid_sweep", with_flows(f""",
thresholds AS (SELECT DISTINCT threshold FROM (
  SELECT CAST(i AS DOUBLE) / 100 AS threshold FROM range(1, 100) t(i) UNION ALL
  SELECT unnest(quantile_cont("Score", [{", ".join(f"{i / 100}" for i in range(1, 100))}])) FROM flows))
SELECT round(threshold, 6) AS threshold, CAST(fp AS BIGINT) AS false_positive, CAST(tp AS BIGINT) AS true_positive FROM (
  SELECT threshold, {cells_sql(threshold='threshold')} FROM thresholds, flows GROUP BY 1)"""))
def quantile_grid_sweep(spark, sf):
    f = flows(spark, sf)
    found = metrics.threshold_sweep(f, metrics.grid_thresholds(f))
    return rounded(found.select("threshold", "false_positive", "true_positive"), "threshold")


@query("quantile_threshold", with_flows(f"""
SELECT a.scenario, {r('a.t', 'threshold')}, {r('avg(CASE WHEN f."AnomalyScore" >= a.t THEN 1.0 ELSE 0.0 END)', 'observed_rate')},
  count(*) AS row_count FROM flows f JOIN (
  SELECT "Scenario" AS scenario, quantile_cont("AnomalyScore", 0.99) AS t FROM flows GROUP BY 1) a ON a.scenario = f."Scenario"
GROUP BY a.scenario, a.t"""))
def quantile_threshold(spark, sf):
    found = metrics.quantile_threshold(flows(spark, sf), 0.01, ["Scenario"], "AnomalyScore")
    return rounded(found.withColumnsRenamed({"Scenario": "scenario", "rows": "row_count"}), "threshold", "observed_rate")


@query("price_quantiles", f"""
SELECT l_returnflag, prob, {r('v', 'quantile')}, row_count FROM (
  SELECT l_returnflag, count(*) AS row_count, unnest([0.01, 0.5, 0.9, 0.999]) AS prob,
    unnest(quantile_cont(l_extendedprice, [0.01, 0.5, 0.9, 0.999])) AS v FROM lineitem GROUP BY 1)""")
def price_quantiles(spark, sf):
    found = exact_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", [0.01, 0.5, 0.9, 0.999], ["l_returnflag"])
    return rounded(found.withColumnRenamed("rows", "row_count"), "quantile")


@query("score_histogram", with_flows("""
SELECT "BinaryLabel" AS binary_label, least(CAST(floor(("Score" - lo) / (hi - lo) * 50) AS BIGINT), 49) AS bin, count(*) AS row_count
FROM flows JOIN (SELECT "BinaryLabel" AS b, min("Score") AS lo, max("Score") AS hi FROM flows GROUP BY 1) ON b = "BinaryLabel"
GROUP BY 1, 2"""))
def score_histogram(spark, sf):
    return metrics.score_histogram(flows(spark, sf)).withColumnsRenamed({"BinaryLabel": "binary_label", "rows": "row_count"})


RATES_SQL = f"""
SELECT scenario, {{0}}, CASE WHEN a = 1 THEN 'ATTACK' ELSE 'BENIGN' END AS actual_class, row_count, predicted_attack_rows,
  {r('predicted_attack_rows / row_count', 'attack_prediction_rate')},
  {r('CASE WHEN a = 1 THEN predicted_attack_rows / row_count END', 'detection_rate_if_attack')},
  {r('CASE WHEN a = 0 THEN predicted_attack_rows / row_count END', 'false_positive_rate_if_benign')}
FROM (SELECT "Scenario" AS scenario, {{1}} AS {{0}}, max("BinaryLabel") AS a, count(*) AS row_count,
  count(*) FILTER ("Score" >= 0.5) AS predicted_attack_rows FROM flows GROUP BY 1, 2)"""
RATES = ["attack_prediction_rate", "detection_rate_if_attack", "false_positive_rate_if_benign"]


def _flagged(spark, sf):
    return flows(spark, sf).withColumn("PredictedBinaryLabel", (F.col("Score") >= 0.5).cast("int"))


@query("detection_rates_by_label", with_flows(RATES_SQL.format("label", '"Label"')))
def detection_rates_by_label(spark, sf):
    found = metrics.detection_rates(_flagged(spark, sf), ["Scenario", "Label"])
    return rounded(found.withColumnsRenamed({"Scenario": "scenario", "Label": "label", "rows": "row_count"}), *RATES)


@query("detection_rates_by_family", with_flows(RATES_SQL.format("family", '"AttackFamily"')))
def detection_rates_by_family(spark, sf):
    found = metrics.detection_rates(_flagged(spark, sf), ["Scenario", "AttackFamily"])
    return rounded(found.withColumnsRenamed({"Scenario": "scenario", "AttackFamily": "family", "rows": "row_count"}), *RATES)


@query("label_rollup_mean", with_flows(f"""
SELECT label, CAST(sum(n) AS BIGINT) AS row_count, {r('avg(hit / n)', 'detection_rate')} FROM (
  SELECT "Scenario", "Label" AS label, count(*) AS n, count(*) FILTER ("Score" >= 0.5) AS hit FROM flows
  WHERE "BinaryLabel" = 1 GROUP BY 1, 2) GROUP BY 1"""))
def label_rollup_mean(spark, sf):
    rates = metrics.detection_rates(_flagged(spark, sf), ["Scenario", "Label"])
    found = metrics.label_rollup(rates, "Label", weighted=False)
    return rounded(found.withColumnsRenamed({"Label": "label", "rows": "row_count"}), "detection_rate")


@query("label_rollup_pooled", with_flows(f"""
SELECT "Label" AS label, count(*) AS row_count, {r('avg(CASE WHEN "Score" >= 0.5 THEN 1.0 ELSE 0.0 END)', 'detection_rate')}
FROM flows WHERE "BinaryLabel" = 1 GROUP BY 1"""))
def label_rollup_pooled(spark, sf):
    rates = metrics.detection_rates(_flagged(spark, sf), ["Scenario", "Label"])
    found = metrics.label_rollup(rates, "Label", weighted=True)
    return rounded(found.withColumnsRenamed({"Label": "label", "rows": "row_count"}), "detection_rate")


@query("fold_report", with_flows(f""",
judged AS (SELECT *, 0.9 + CAST(substr("Scenario", 2) AS INTEGER) / 100.0 AS t FROM flows),
folds AS (SELECT "Scenario" AS scenario, * FROM judged UNION ALL SELECT 'ALL_SCENARIOS_AGGREGATED', * FROM judged),
ranked AS (SELECT scenario, {r('CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) END', 'roc_auc')},
    {r('CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * tp / (tp + fp)) / sum(pos) END', 'pr_auc')} FROM (
  SELECT scenario, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (
    SELECT scenario, "AnomalyScore" AS s, CAST(count(*) FILTER ("BinaryLabel" = 1) AS DOUBLE) AS pos,
      CAST(count(*) FILTER ("BinaryLabel" = 0) AS DOUBLE) AS neg FROM folds GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY scenario ORDER BY s DESC)) GROUP BY 1)
SELECT * FROM (SELECT scenario, {metric_sql()} FROM (
  SELECT scenario, {cells_sql('"AnomalyScore"', 't')} FROM folds GROUP BY 1)) JOIN ranked USING (scenario)"""))
def fold_report(spark, sf):
    limit = 0.9 + F.substring("Scenario", 2, 9).cast("int") / 100.0
    judged = flows(spark, sf).withColumn("Threshold", limit)
    found = metrics.fold_report(judged, "Scenario", score="AnomalyScore").withColumnRenamed("Scenario", "scenario")
    return rounded(found, *METRICS, "roc_auc", "pr_auc")


PAIRS_SQL = """,
pairs AS (SELECT "OperationalFamily" AS actual, "FamilyGuess" AS predicted, count(*) AS n FROM flows WHERE "BinaryLabel" = 1 GROUP BY 1, 2),
sides AS (SELECT class, sum(support) AS support, sum(predicted) AS predicted, sum(hits) AS hits FROM (
  SELECT actual AS class, n AS support, 0 AS predicted, CASE WHEN actual = predicted THEN n ELSE 0 END AS hits FROM pairs
  UNION ALL SELECT predicted, 0, n, 0 FROM pairs) GROUP BY 1),
per AS (SELECT class, CAST(support AS DOUBLE) AS support, CAST(predicted AS DOUBLE) AS predicted, CAST(hits AS DOUBLE) AS hits,
  CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS rc,
  2 * hits / (support + predicted) AS f1, 5 * hits / (4 * support + predicted) AS f2 FROM sides)
"""


def _pairs(spark, sf):
    return metrics.class_pairs(flows(spark, sf).where(F.col("BinaryLabel") == 1), "OperationalFamily", "FamilyGuess")


@query("multiclass_metrics", with_flows(PAIRS_SQL + f"""
SELECT CAST(sum(support) AS BIGINT) AS evaluation_rows, {r('sum(hits) / sum(support)', 'accuracy')},
  {r('avg(rc) FILTER (support > 0)', 'balanced_accuracy')}, {r('avg(p)', 'macro_precision')}, {r('avg(rc)', 'macro_recall')},
  {r('avg(f1)', 'macro_f1')}, {r('avg(f2)', 'macro_f2')}, {r('sum(f1 * support) / sum(support)', 'weighted_f1')},
  {r('(sum(hits) * sum(support) - sum(support * predicted)) / (sqrt(sum(support) * sum(support) - sum(predicted * predicted)) * sqrt(sum(support) * sum(support) - sum(support * support)))', 'matthews_correlation')}
FROM per"""))
def multiclass_metrics(spark, sf):
    found = metrics.multiclass_metrics(_pairs(spark, sf))
    return rounded(found, *[c for c in found.columns if c != "evaluation_rows"])


@query("classification_report", with_flows(PAIRS_SQL + f"""
SELECT class, {r('p', 'precision')}, {r('rc', 'recall')}, {r('f1', 'f1')}, {r('support', 'support')} FROM per
UNION ALL SELECT 'accuracy', {r('sum(hits) / sum(support)', 'a')}, {r('sum(hits) / sum(support)', 'b')},
  {r('sum(hits) / sum(support)', 'c')}, {r('sum(hits) / sum(support)', 'd')} FROM per
UNION ALL SELECT 'macro avg', {r('avg(p)', 'a')}, {r('avg(rc)', 'b')}, {r('avg(f1)', 'c')}, {r('sum(support)', 'd')} FROM per
UNION ALL SELECT 'weighted avg', {r('sum(p * support) / sum(support)', 'a')}, {r('sum(rc * support) / sum(support)', 'b')},
  {r('sum(f1 * support) / sum(support)', 'c')}, {r('sum(support)', 'd')} FROM per"""))
def classification_report(spark, sf):
    return rounded(metrics.classification_report(_pairs(spark, sf)), "precision", "recall", "f1", "support")


MATRIX = ", ".join(
    f"""count(*) FILTER ("FamilyGuess" = '{f}') AS "{f}" """ for f in OPERATIONAL_FAMILIES)
POSITIONS = "CASE \"OperationalFamily\" " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(OPERATIONAL_FAMILIES)) + " END"


@query("confusion_matrix", with_flows(f"""
SELECT {POSITIONS} AS position, "OperationalFamily" AS actual, {MATRIX} FROM flows WHERE "BinaryLabel" = 1 GROUP BY 1, 2"""))
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(flows(spark, sf).where(F.col("BinaryLabel") == 1), "OperationalFamily", "FamilyGuess",
                                    OPERATIONAL_FAMILIES)


KNOWN = "count(*) FILTER (\"FamilyGuess\" <> 'Mystery Family')"
SHARES = ", ".join(r(f"""count(*) FILTER ("FamilyGuess" = '{f}') / {KNOWN}""", f) for f in OPERATIONAL_FAMILIES)


@query("confusion_matrix_normalized", with_flows(f"""
SELECT {POSITIONS} AS position, "OperationalFamily" AS actual, {SHARES} FROM flows WHERE "BinaryLabel" = 1 GROUP BY 1, 2"""))
def confusion_matrix_normalized(spark, sf):
    found = metrics.confusion_matrix(flows(spark, sf).where(F.col("BinaryLabel") == 1), "OperationalFamily", "FamilyGuess",
                                     OPERATIONAL_FAMILIES, normalize=True)
    return rounded(found, *OPERATIONAL_FAMILIES)


@query("prior_baseline", with_flows(f"""
SELECT "OperationalFamily" AS family, count(*) AS row_count, {r('count(*) / sum(count(*)) OVER ()', 'probability')}
FROM flows WHERE "BinaryLabel" = 1 GROUP BY 1"""))
def prior_baseline(spark, sf):
    found = metrics.prior_baseline(flows(spark, sf).where(F.col("BinaryLabel") == 1), "OperationalFamily")
    return rounded(found.withColumnsRenamed({"OperationalFamily": "family", "rows": "row_count"}), "probability")


@query("evaluation_designs", with_flows(f"""
SELECT 'grouped' AS evaluation, accuracy, recall_attack, f2_attack, false_positive_rate, roc_auc FROM
  (SELECT {metric_sql()} FROM (SELECT {cells_sql()} FROM flows)), (SELECT roc_auc FROM ({RANK_SQL.format(keys="", raw="", part="", group="", auc=AUC, ap=AP)}))
UNION ALL SELECT 'anomaly', accuracy, recall_attack, f2_attack, false_positive_rate, NULL FROM
  (SELECT {metric_sql()} FROM (SELECT {cells_sql('"AnomalyScore"', '0.9')} FROM flows))"""))
def evaluation_designs(spark, sf):
    f = flows(spark, sf)
    grouped = beside(metrics.binary_metrics(metrics.binary_confusion(f)), metrics.ranking_metrics(f))
    anomaly = metrics.binary_metrics(metrics.binary_confusion(f, score="AnomalyScore", threshold=0.9))
    columns = ["accuracy", "recall_attack", "f2_attack", "false_positive_rate", "roc_auc"]
    found = metrics.compare_designs({"grouped": grouped, "scenario": None, "anomaly": anomaly}, columns)
    return rounded(found, *columns)


@query("candidate_ranking", with_flows(f""",
candidates AS (SELECT 'Score' AS model, "BinaryLabel", "Score" AS s FROM flows UNION ALL
  SELECT 'AnomalyScore', "BinaryLabel", "AnomalyScore" FROM flows UNION ALL SELECT 'Prior', "BinaryLabel", 0.6 FROM flows)
SELECT model, {metric_sql()} FROM (SELECT model, {cells_sql('s')} FROM candidates GROUP BY 1)
ORDER BY f2_attack DESC, recall_attack DESC, model LIMIT 1"""))
def candidate_ranking(spark, sf):
    f = flows(spark, sf)
    scores = F.explode(F.create_map(F.lit("Score"), F.col("Score"), F.lit("AnomalyScore"), F.col("AnomalyScore"),
                                    F.lit("Prior"), F.lit(0.6))).alias("model", "s")
    cells = metrics.binary_confusion(f.select("BinaryLabel", scores), ["model"], score="s")
    found = rounded(metrics.binary_metrics(cells), *METRICS)
    return metrics.rank_candidates(found, ["f2_attack", "recall_attack"]).limit(1)


@query("sketched_scores", """
SELECT 's' || CAST(event_id % 8 AS VARCHAR) AS scenario, prob, count(*) AS row_count, true AS quantile_within, true AS distinct_within
FROM events, (SELECT unnest([0.1, 0.5, 0.99]) AS prob) GROUP BY 1, 2""")
def sketched_scores(spark, sf):
    """Quantiles and users of every scenario from stored sketches by day, held against the exact ones by their error bounds."""
    e = table(spark, sf, "events").select(F.concat(F.lit("s"), (F.col("event_id") % 8).cast("string")).alias("scenario"),
                                          F.to_date("ts").alias("day"), "value", "user_id")
    stored = sketches.sketch_table(e, ["scenario", "day"], ["value"], ["user_id"])
    found = sketches.merged_quantiles(stored, "value", [0.1, 0.5, 0.99], ["scenario"]).join(
        F.broadcast(sketches.merged_distinct(stored, "user_id", ["scenario"])), "scenario")
    held = e.join(F.broadcast(found), "scenario").groupBy("scenario", "prob", "distinct").agg(
        F.count("*").alias("row_count"), F.count_if(F.col("value") < F.col("quantile")).alias("below"),
        F.count_if(F.col("value") <= F.col("quantile")).alias("upto"), F.count_distinct("user_id").alias("users"))
    goal, slack = F.col("prob") * F.col("row_count"), F.col("row_count") * sketches.RANK_ERROR + 1
    return held.select(
        "scenario", "prob", "row_count", ((F.col("below") <= goal + slack) & (F.col("upto") >= goal - slack)).alias("quantile_within"),
        (F.abs(F.col("distinct") - F.col("users")) <= F.col("users") * sketches.DISTINCT_ERROR + 1).alias("distinct_within"))
