"""Detection metrics as relational aggregates.

Scores collapse to one row per distinct value before anything is ordered, and orderings go
through :func:`running_totals`, so no metric depends on one task seeing all rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.numeric import ratio
from flowspark.operators.prefix import exact_quantiles, running_totals
from flowspark.session import lookup_join

CELLS = ["true_negative", "false_positive", "false_negative", "true_positive"]


def binary_confusion(df: DataFrame, keys: Sequence[str] = (), label: str = "BinaryLabel",
                     score: str = "Score", threshold: float | Column = 0.5) -> DataFrame:
    """The four confusion cells per key; a row is flagged at score >= threshold."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    flagged, attack = F.col(score) >= limit, F.col(label) == 1
    return df.groupBy(*keys).agg(
        F.count_if(~attack & ~flagged).alias("true_negative"),
        F.count_if(~attack & flagged).alias("false_positive"),
        F.count_if(attack & ~flagged).alias("false_negative"),
        F.count_if(attack & flagged).alias("true_positive"),
    )


def _fbeta(beta: int) -> Column:
    b2 = beta * beta
    hit = F.col("true_positive") * (1 + b2)
    return ratio(hit, hit + F.col("false_negative") * b2 + F.col("false_positive"), 0.0)


def binary_metrics(confusion: DataFrame, undefined: str = "null") -> DataFrame:
    """Metrics from confusion cells, other columns kept.

    `undefined` says what a metric of an absent class is: "null", or "zero" for the baseline
    comparison, which reports 0 and averages recall over the classes present.
    """
    tn, fp, fn, tp = (F.col(c).cast("double") for c in CELLS)
    benign, attack = tn + fp, tp + fn
    zero = undefined == "zero"
    empty = 0.0 if zero else None
    needs_attack = F.lit(True) if zero else attack > 0
    both = (benign > 0) & (attack > 0)
    recall, specificity = ratio(tp, attack), ratio(tn, benign)
    one_sided = F.coalesce(recall, specificity) if zero else F.lit(None)
    mcc = F.coalesce(
        ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(attack) * F.sqrt(benign) * F.sqrt(tn + fn)), F.lit(0.0)
    )
    return confusion.select(
        *confusion.columns,
        F.expr("true_negative + false_positive + false_negative + true_positive").alias("test_rows"),
        F.expr("true_negative + false_positive").alias("actual_benign"),
        F.expr("true_positive + false_negative").alias("actual_attack"),
        ratio(tn + tp, benign + attack).alias("accuracy"),
        F.when(both, (recall + specificity) / 2).otherwise(one_sided).alias("balanced_accuracy"),
        ratio(tp, tp + fp, 0.0).alias("precision_attack"),
        ratio(tp, attack, empty).alias("recall_attack"),
        F.when(needs_attack, _fbeta(1)).alias("f1_attack"),
        F.when(needs_attack, _fbeta(2)).alias("f2_attack"),
        ratio(tn, benign, empty).alias("specificity"),
        ratio(fp, benign, empty).alias("false_positive_rate"),
        ratio(fn, attack, empty).alias("false_negative_rate"),
        (mcc if zero else F.when(both, mcc)).alias("matthews_correlation"),
        F.expr("false_positive + false_negative").alias("errors"),
    )


def throughput(rows: Column, seconds: Column) -> Column:
    return F.coalesce(ratio(rows, seconds), F.lit(float("inf")))


def score_counts(df: DataFrame, keys: Sequence[str] = (), label: str = "BinaryLabel",
                 score: str = "Score") -> DataFrame:
    """Attacks and benign rows behind every distinct score."""
    return (
        df.where(F.col(score).isNotNull())
        .groupBy(*keys, F.col(score).cast("double").alias("score"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    )


def cumulative_scores(df: DataFrame, keys: Sequence[str] = (), label: str = "BinaryLabel",
                      score: str = "Score") -> DataFrame:
    """True and false positives when everything at or above each distinct score is flagged."""
    counts = score_counts(df, keys, label, score).withColumn("_down", -F.col("score"))
    totals = running_totals(counts, keys, "_down", ["pos", "neg"])
    return totals.withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp"}).drop("_down")


def ranking_metrics(df: DataFrame, keys: Sequence[str] = (), label: str = "BinaryLabel",
                    score: str = "Score") -> DataFrame:
    """ROC AUC with half credit for ties and step-wise average precision; null for one class."""
    points = cumulative_scores(df, keys, label, score)
    pos, neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    wins = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2.0))
    steps = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    both = (pos > 0) & (neg > 0)
    return points.groupBy(*keys).agg(
        F.when(both, ratio(wins, pos * neg)).alias("roc_auc"),
        F.when(both, ratio(steps, pos)).alias("pr_auc"),
    )


def curve_points(df: DataFrame, keys: Sequence[str] = (), label: str = "BinaryLabel",
                 score: str = "Score") -> DataFrame:
    """ROC and precision-recall coordinates at every distinct threshold."""
    points = cumulative_scores(df, keys, label, score)
    by = list(keys) or ["_all"]
    base = points if keys else points.withColumn("_all", F.lit(0))
    totals = base.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return lookup_join(base, totals, by).select(
        *keys, F.col("score").alias("threshold"),
        ratio(F.col("fp"), F.col("_n")).alias("false_positive_rate"),
        ratio(F.col("tp"), F.col("_p")).alias("true_positive_rate"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("_p")).alias("recall"),
    )


def grid_thresholds(df: DataFrame, score: str = "Score", quantiles: bool = True) -> list[float]:
    """0.01 … 0.99, plus the 99 score percentiles: at most 198 candidate thresholds."""
    steps = [i / 100 for i in range(1, 100)]
    if not quantiles:
        return steps
    rows = exact_quantiles(df, score, steps).collect()
    return sorted(set(steps) | {row["quantile"] for row in rows})


def threshold_sweep(df: DataFrame, thresholds: Sequence[float], label: str = "BinaryLabel",
                    score: str = "Score") -> DataFrame:
    """Metrics at every candidate threshold from one pass over the rows.

    Each row is counted in the interval between two thresholds; the confusion at a threshold is
    then a sum over at most len(thresholds) + 1 interval counts.
    """
    steps = sorted(set(float(t) for t in thresholds))
    cutter = Bucketizer(splits=[float("-inf"), *steps, float("inf")], inputCol="_s", outputCol="_cell")
    cells = (
        cutter.transform(df.select(F.col(label).alias("_y"), F.col(score).cast("double").alias("_s")))
        .groupBy("_cell")
        .agg(F.count_if(F.col("_y") == 1).alias("_pos"), F.count_if(F.col("_y") != 1).alias("_neg"))
    )
    grid = df.sparkSession.createDataFrame(
        [(float(i), t) for i, t in enumerate([float("-inf"), *steps])], "_cell double, threshold double"
    )
    filled = grid.join(cells, "_cell", "left").na.fill(0, ["_pos", "_neg"])
    # At most len(thresholds) + 1 rows: an ordering of them all is no burden for one task.
    above = Window.partitionBy(F.lit(0)).orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy(F.lit(0)).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    confusion = filled.select(
        "threshold",
        F.coalesce(F.sum("_neg").over(below), F.lit(0)).alias("true_negative"),
        F.sum("_neg").over(above).alias("false_positive"),
        F.coalesce(F.sum("_pos").over(below), F.lit(0)).alias("false_negative"),
        F.sum("_pos").over(above).alias("true_positive"),
    ).where(F.col("threshold") > float("-inf"))
    return binary_metrics(confusion)


def pick_threshold(sweep: DataFrame, max_fpr: float) -> DataFrame:
    """Best threshold by F2, recall, precision among those within the false-positive limit.

    If none is within it, the best of all. Equal candidates go to the lower threshold.
    """
    allowed = F.coalesce(F.col("false_positive_rate") <= F.lit(float(max_fpr)), F.lit(False))
    return sweep.orderBy(
        allowed.desc(), F.col("f2_attack").desc(), F.col("recall_attack").desc(),
        F.col("precision_attack").desc(), "threshold",
    ).limit(1)


def rank_candidates(table: DataFrame, by: Sequence[str], name: str = "model") -> DataFrame:
    """Candidates in order of merit; the first row wins."""
    return table.orderBy(*[F.col(c).desc() for c in by], name)


def quantile_threshold(df: DataFrame, max_fpr: float, keys: Sequence[str] = (), score: str = "Score") -> DataFrame:
    """Score above which a share of `max_fpr` lies, and the share really flagged by it."""
    limits = exact_quantiles(df, score, [1.0 - max_fpr], keys).select(
        *keys, F.col("quantile").alias("threshold"), "rows"
    )
    by = list(keys) or ["_all"]
    left = df if keys else df.withColumn("_all", F.lit(0))
    right = limits if keys else limits.withColumn("_all", F.lit(0))
    return (
        lookup_join(left, right, by).groupBy(*by, "threshold", "rows")
        .agg(F.count_if(F.col(score) >= F.col("threshold")).alias("_hit"))
        .select(*keys, "threshold", ratio(F.col("_hit"), F.col("rows")).alias("observed_rate"), "rows")
    )


def score_histogram(df: DataFrame, keys: Sequence[str] = ("BinaryLabel",), score: str = "Score",
                    bins: int = 50) -> DataFrame:
    """Equal-width histogram per key over that key's own score range."""
    ranges = df.groupBy(*keys).agg(F.min(score).alias("_a"), F.max(score).alias("_b"))
    flat = F.col("_a") == F.col("_b")
    ranges = ranges.select(
        *keys, F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_lo"),
        F.when(flat, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_hi"),
    )
    slot = F.floor((F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    return (
        lookup_join(df.where(F.col(score).isNotNull()), ranges, list(keys))
        .groupBy(*keys, F.least(slot, F.lit(bins - 1)).alias("bin"))
        .agg(F.count("*").alias("rows"))
    )


def detection_rates(df: DataFrame, by: Sequence[str], prediction: str = "PredictedBinaryLabel",
                    label: str = "BinaryLabel") -> DataFrame:
    """Share of rows flagged per group, split into detection rate and false-positive rate."""
    rate = ratio(F.col("predicted_attack_rows"), F.col("rows"))
    attack = F.col("_attack") == 1
    return (
        df.groupBy(*by)
        .agg(
            F.max(label).alias("_attack"), F.count("*").alias("rows"),
            F.count_if(F.col(prediction) == 1).alias("predicted_attack_rows"),
        )
        .select(
            *by, F.when(attack, "ATTACK").otherwise("BENIGN").alias("actual_class"), "rows",
            "predicted_attack_rows", rate.alias("attack_prediction_rate"),
            F.when(attack, rate).alias("detection_rate_if_attack"),
            F.when(~attack, rate).alias("false_positive_rate_if_benign"),
        )
    )


def label_rollup(rates: DataFrame, by: str, weighted: bool) -> DataFrame:
    """Detection rate of an attack label over all folds: ratio of sums, or mean of fold rates."""
    pooled = ratio(F.sum("predicted_attack_rows"), F.sum("rows"))
    rate = pooled if weighted else F.avg("detection_rate_if_attack")
    return (
        rates.where(F.col("actual_class") == "ATTACK").groupBy(by)
        .agg(F.sum("rows").alias("rows"), rate.alias("detection_rate"))
    )


def fold_report(scored: DataFrame, fold: str, threshold: str = "Threshold", label: str = "BinaryLabel",
                score: str = "Score", total: str = "ALL_SCENARIOS_AGGREGATED") -> DataFrame:
    """Metrics of every fold and of all folds pooled, each row judged by its fold's threshold."""
    flagged, attack = F.col(score) >= F.col(threshold), F.col(label) == 1
    cells = scored.rollup(fold).agg(
        F.count_if(~attack & ~flagged).alias("true_negative"),
        F.count_if(~attack & flagged).alias("false_positive"),
        F.count_if(attack & ~flagged).alias("false_negative"),
        F.count_if(attack & flagged).alias("true_positive"),
    ).withColumn(fold, F.coalesce(F.col(fold), F.lit(total)))
    pooled = scored.select(F.lit(total).alias(fold), label, score)
    ranked = ranking_metrics(scored, [fold], label, score).unionByName(
        ranking_metrics(pooled, [fold], label, score)
    )
    return binary_metrics(cells).join(ranked, fold, "left")


# ------------------------------------------------------------------------------ multi-class


def class_pairs(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows behind every (actual, predicted) pair."""
    return df.groupBy(*keys, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def per_class(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Support, predictions, hits and precision, recall, F1, F2 of every class."""
    sides = F.explode(F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
    ))
    counts = (
        pairs.select(*keys, sides.alias("_s")).select(*keys, "_s.*").groupBy(*keys, "class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )
    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    return counts.select(
        "*", ratio(hits, predicted, 0.0).alias("precision"), ratio(hits, support, 0.0).alias("recall"),
        ratio(hits * 2, support + predicted, 0.0).alias("f1"),
        ratio(hits * 5, support * 4 + predicted, 0.0).alias("f2"),
    )


def multiclass_metrics(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted scores and the correlation coefficient."""
    table = per_class(pairs, keys)
    rows, hits = F.sum("support").cast("double"), F.sum("hits").cast("double")
    cross = F.sum(F.col("support").cast("double") * F.col("predicted"))
    predicted_sq = F.sum(F.col("predicted").cast("double") * F.col("predicted"))
    actual_sq = F.sum(F.col("support").cast("double") * F.col("support"))
    spread = F.sqrt(rows * rows - predicted_sq) * F.sqrt(rows * rows - actual_sq)
    return table.groupBy(*keys).agg(
        F.sum("support").alias("evaluation_rows"),
        ratio(hits, rows).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        F.avg("f2").alias("macro_f2"),
        ratio(F.sum(F.col("f1") * F.col("support")), rows).alias("weighted_f1"),
        ratio(hits * rows - cross, spread, 0.0).alias("matthews_correlation"),
    )


def classification_report(pairs: DataFrame) -> DataFrame:
    """Per-class scores followed by accuracy, macro average and weighted average rows."""
    table = per_class(pairs)
    rows = F.sum("support")
    names = ["precision", "recall", "f1"]
    accuracy = ratio(F.sum("hits"), rows)
    summary = table.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("class"), *[accuracy.alias(n) for n in names],
                     accuracy.alias("support")),
            F.struct(F.lit("macro avg").alias("class"), *[F.avg(n).alias(n) for n in names],
                     rows.cast("double").alias("support")),
            F.struct(F.lit("weighted avg").alias("class"),
                     *[ratio(F.sum(F.col(n) * F.col("support")), rows).alias(n) for n in names],
                     rows.cast("double").alias("support")),
        ).alias("_r")
    ).select(F.inline("_r"))
    classes = table.select("class", *names, F.col("support").cast("double").alias("support"))
    return classes.unionByName(summary)


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels: Sequence[str],
                     normalize: bool = False) -> DataFrame:
    """Dense matrix in fixed label order, optionally as a share of each actual class."""
    order = df.sparkSession.createDataFrame([(i, l) for i, l in enumerate(labels)], "position int, actual string")
    wide = (
        df.groupBy(F.col(actual).cast("string").alias("actual"))
        .pivot(predicted, list(labels)).agg(F.count(F.lit(1)))
    )
    cells = [str(l) for l in labels]
    dense = F.broadcast(order).join(wide, "actual", "left").na.fill(0, cells)
    if normalize:
        total = reduce(lambda a, b: a + b, [F.col(f"`{c}`") for c in cells])
        dense = dense.select("position", "actual", *[ratio(F.col(f"`{c}`"), total, 0.0).alias(c) for c in cells])
    return dense.select("position", "actual", *[F.col(f"`{c}`") for c in cells])


def prior_baseline(train: DataFrame, label: str) -> DataFrame:
    """Class shares of the training rows: what a feature-blind classifier predicts."""
    counts = train.groupBy(label).agg(F.count("*").alias("rows"))
    share = ratio(F.col("rows"), F.sum("rows").over(Window.partitionBy(F.lit(0))))
    return counts.withColumn("probability", share)


def compare_designs(named: dict[str, DataFrame | None], columns: Sequence[str]) -> DataFrame:
    """One row per evaluation design; a design that was not run is skipped."""
    parts = [
        table.select(F.lit(name).alias("evaluation"), *[c for c in columns if c in table.columns])
        for name, table in named.items() if table is not None
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
