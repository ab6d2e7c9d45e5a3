"""Analyst reports over a scored ledger and over the detection layers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.labels import severity_rank
from flowspark.schema import SEVERITIES, q, resolve_alias

ALERTING = SEVERITIES[:3]
QUEUE_LIMIT = 5_000
TOP_SOURCES = 15


def key_figures(ledger: DataFrame) -> DataFrame:
    """Headline counts: one row."""
    return ledger.agg(
        F.count("*").alias("flows_analyzed"),
        F.count_if(F.col("BinaryPrediction") == "ATTACK").alias("known_attacks"),
        F.count_if(F.col("AnomalyFlag")).alias("anomaly_flags"),
        F.count_if(F.col("AlertSeverity").isin(SEVERITIES[:2])).alias("critical_or_high"),
        F.count_if(F.col("AlertSeverity") == "Medium").alias("anomaly_only"),
    )


def severity_counts(ledger: DataFrame) -> DataFrame:
    """Flows per severity; all four levels appear."""
    levels = ledger.sparkSession.createDataFrame(list(enumerate(SEVERITIES)), "position int, AlertSeverity string")
    counts = ledger.groupBy("AlertSeverity").agg(F.count("*").alias("flows"))
    return counts.join(levels, "AlertSeverity", "right").select(
        "position", "AlertSeverity", F.coalesce("flows", F.lit(0)).alias("flows")
    )


def family_counts(ledger: DataFrame) -> DataFrame:
    return (
        ledger.where(F.col("BinaryPrediction") == "ATTACK").groupBy("PredictedAttackFamily")
        .agg(F.count("*").alias("flows"))
    )


def top_sources(ledger: DataFrame, n: int = TOP_SOURCES) -> DataFrame:
    """Sources with most alerting flows; equal counts in name order."""
    source = F.coalesce(F.col(q(resolve_alias(ledger.columns, "source_ip", required=True))).cast("string"), F.lit("MISSING"))
    return (
        ledger.where(F.col("AlertSeverity").isin(ALERTING)).groupBy(source.alias("source"))
        .agg(F.count("*").alias("alerts")).orderBy(F.desc("alerts"), "source").limit(n)
    )


def technique_counts(ledger: DataFrame) -> DataFrame:
    return (
        ledger.where(F.col("MITRETechniqueID") != "").groupBy("MITRETechniqueID").agg(F.count("*").alias("flows"))
    )


def alert_queue(ledger: DataFrame, tie_break: Sequence[str] = ("RowID",), limit: int = QUEUE_LIMIT) -> DataFrame:
    """Most urgent alerts first: severity, probability, anomaly margin."""
    return (
        ledger.where(F.col("AlertSeverity").isin(ALERTING))
        .orderBy(
            severity_rank(F.col("AlertSeverity")), F.col("KnownAttackProbability").desc(),
            F.col("AnomalyMargin").desc(), *tie_break,
        )
        .limit(limit)
    )


def run_summary(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals of a scoring run."""
    return ledger.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("BinaryPrediction") == "ATTACK").alias("known_attack_alerts"),
        F.count_if(F.col("AnomalyFlag")).alias("anomaly_alerts"),
        F.count_if(F.col("AlertSeverity").isin(SEVERITIES[:2])).alias("critical_or_high_alerts"),
    )


def benign_counts(df: DataFrame, by: str = "Scenario") -> DataFrame:
    """Benign rows per scenario; a scenario without any shows 0."""
    return df.groupBy(by).agg(F.count_if(F.col("BinaryLabel") == 0).alias("benign_rows"))


def layer_counts(layer: str, df: DataFrame, flagged: Column, severity: Column | None = None, techniques: Column | None = None,
                 by: Sequence[str] = ("Scenario", "GroundTruth")) -> DataFrame:
    """Events a detection layer raised per scenario, out of the records it saw, with its own highest severity and the
    techniques it named (id, name and tactic joined by `|` in `techniques`)."""
    rank = F.lit(None).cast("int") if severity is None else F.when(flagged, severity_rank(severity))
    named = F.lit(None).cast("string") if techniques is None else F.when(flagged & (techniques != ""), techniques)
    return df.groupBy(*by).agg(
        F.count("*").alias("Records"), F.count_if(flagged).alias("EventCount"), F.min(rank).alias("_severity"),
        F.array_join(F.sort_array(F.collect_set(named)), "; ").alias("Techniques"),
    ).select(*by, F.lit(layer).alias("DetectionLayer"), "Records", "EventCount", "_severity", "Techniques")


def compare_layers(layers: Sequence[DataFrame], benign: str = "BENIGN") -> DataFrame:
    """Verdict of every detection layer against the ground truth of each scenario, from the layer's own facts."""
    table = reduce(lambda a, b: a.unionByName(b), layers)
    hit, attack = F.col("EventCount") > 0, F.col("GroundTruth") != benign
    names = F.lit(SEVERITIES)
    return table.select(
        "Scenario", "GroundTruth", "DetectionLayer", hit.alias("AnalystFacingDetection"), "Records", "EventCount",
        F.concat(F.col("EventCount"), F.lit(" of "), F.col("Records"), F.lit(" records flagged")).alias("Result"),
        F.coalesce(F.get(names, F.col("_severity")), F.lit("")).alias("Severity"), "Techniques",
        F.when(attack & hit, "Detected").when(attack, "Missed").when(hit, "False alarm").otherwise("Correctly quiet")
        .alias("Interpretation"),
    )


def layer_matrix(comparison: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Events of every layer side by side, one row per scenario."""
    return comparison.groupBy("Scenario", "GroundTruth").pivot("DetectionLayer", list(layers)).agg(F.sum("EventCount")).na.fill(0)
