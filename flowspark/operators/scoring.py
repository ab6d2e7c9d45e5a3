"""Fusion of the detectors into a severity-ranked, technique-enriched ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.schema import (
    ALERT_VIEW, LEDGER_CONTEXT, LEDGER_PREDICTIONS, REASON_ANOMALY, REASON_BOTH, REASON_KNOWN, REASON_NONE, q,
)
from flowspark.session import lookup_join

FALLBACK_FAMILY = "Other Malicious"
ANOMALY_ENTRY = "Anomalous / Unmapped"
BENIGN_ENTRY = "BENIGN"


def severity(known: Column, anomaly: Column) -> Column:
    return (
        F.when(known & anomaly, "Critical").when(known, "High").when(anomaly, "Medium").otherwise("Low")
    )


def reason(known: Column, anomaly: Column) -> Column:
    return (
        F.when(known & anomaly, REASON_BOTH)
        .when(known, REASON_KNOWN)
        .when(anomaly, REASON_ANOMALY)
        .otherwise(REASON_NONE)
    )


def fuse(scored: DataFrame, binary_threshold: float, anomaly_threshold: float) -> DataFrame:
    """Decisions, severity and reason from the three detector outputs.

    `scored` has ``KnownAttackProbability``, ``_family`` and ``_confidence`` (used only where the
    binary detector fires) and ``AnomalyScore``.
    """
    known = F.col("KnownAttackProbability") >= F.lit(float(binary_threshold))
    anomaly = F.col("AnomalyScore") >= F.lit(float(anomaly_threshold))
    kept = [F.col(q(c)) for c in scored.columns if c not in ("_family", "_confidence")]
    return scored.select(
        *kept, F.lit(float(binary_threshold)).alias("BinaryDecisionThreshold"),
        F.when(known, "ATTACK").otherwise("BENIGN").alias("BinaryPrediction"),
        F.when(known, F.col("_family")).otherwise("Not run").alias("PredictedAttackFamily"),
        F.when(known, F.col("_confidence")).alias("FamilyConfidence"),
        F.lit(float(anomaly_threshold)).alias("AnomalyThreshold"),
        (F.col("AnomalyScore") - F.lit(float(anomaly_threshold))).alias("AnomalyMargin"),
        anomaly.alias("AnomalyFlag"), severity(known, anomaly).alias("AlertSeverity"),
        reason(known, anomaly).alias("AlertReason"),
    )


def technique_lookup(techniques: DataFrame) -> DataFrame:
    """One row per family with its tactic, note and joined technique fields."""
    def joined(field: str) -> Column:
        parts = F.filter(F.transform("techniques", lambda t: t[field]), lambda v: v.isNotNull() & (v != ""))
        return F.coalesce(F.array_join(parts, "; "), F.lit(""))

    return techniques.select(
        F.col("family").alias("_entry"), F.coalesce("tactic", F.lit("")).alias("MITRETactic"),
        joined("id").alias("MITRETechniqueID"), joined("name").alias("MITRETechniqueName"),
        joined("url").alias("MITREReference"), F.coalesce("note", F.lit("")).alias("MITREMappingNote"),
    )


def enrich(fused: DataFrame, techniques: DataFrame) -> DataFrame:
    """Add tactic, technique and note: by family for known attacks, else by anomaly or benign."""
    table = technique_lookup(techniques)
    special = {row["_entry"]: row for row in table.where(F.col("_entry").isin(FALLBACK_FAMILY, ANOMALY_ENTRY, BENIGN_ENTRY)).collect()}
    absent = {FALLBACK_FAMILY, ANOMALY_ENTRY, BENIGN_ENTRY} - set(special)
    if absent:
        raise ValueError(f"technique map lacks {', '.join(sorted(absent))}")
    entry = (
        F.when(F.col("BinaryPrediction") == "ATTACK", F.col("PredictedAttackFamily"))
        .when(F.col("AnomalyFlag"), ANOMALY_ENTRY).otherwise(BENIGN_ENTRY)
    )
    joined = lookup_join(fused.withColumn("_entry", entry), table.withColumn("_found", F.lit(True)), ["_entry"], "left")
    fallback = special[FALLBACK_FAMILY]
    filled = {c: F.when(F.col("_found"), F.col(c)).otherwise(F.lit(fallback[c])) for c in table.columns if c != "_entry"}
    return joined.withColumns(filled).drop("_entry", "_found")


def add_correctness(df: DataFrame, label: str = "BinaryLabel", prediction: Column | None = None,
                    name: str = "BinaryCorrect") -> DataFrame:
    """Whether the prediction equals the label; a label that is no number is never correct."""
    predicted = (F.col("BinaryPrediction") == "ATTACK").cast("double") if prediction is None else prediction
    actual = F.col(q(label)).cast("string").try_cast("double")
    return df.withColumn(name, F.coalesce(actual == predicted.cast("double"), F.lit(False)))


def order_ledger(df: DataFrame) -> DataFrame:
    """Context columns, then predictions, then everything else."""
    context = [c for c in LEDGER_CONTEXT if c in df.columns]
    predictions = [c for c in [*LEDGER_PREDICTIONS, "BinaryCorrect"] if c in df.columns]
    rest = [c for c in df.columns if c not in context and c not in predictions]
    return df.select(*[q(c) for c in context + predictions + rest])


def finish_ledger(scored: DataFrame, techniques: DataFrame, binary_threshold: float, anomaly_threshold: float
                  ) -> DataFrame:
    """Fuse, enrich, judge where labels exist, and order the columns."""
    ledger = enrich(fuse(scored, binary_threshold, anomaly_threshold), techniques)
    if "BinaryLabel" in ledger.columns:
        ledger = add_correctness(ledger)
    return order_ledger(ledger)


def alert_view(ledger: DataFrame, columns: Sequence[str] = tuple(ALERT_VIEW)) -> DataFrame:
    return ledger.select(*[q(c) for c in columns if c in ledger.columns])


def error_ledger(df: DataFrame, correct: str = "Correct") -> DataFrame:
    """Wrong predictions only."""
    return df.where(~F.col(correct))
