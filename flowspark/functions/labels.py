"""Label cleaning and class mapping as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowspark.schema import ATTACK_FAMILIES, CANONICAL_LABELS, SEVERITIES

MISSING_LABEL = "<MISSING>"
BENIGN = "BENIGN"


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)


def normalize_label(raw: Column) -> Column:
    """Repair encoding damage in a traffic label and bring it to its canonical spelling."""
    dashed = F.translate(raw, "�–—−", "----")
    spaced = F.regexp_replace(dashed, r"(?U)\s*-\s*", " - ")
    text = F.trim(F.regexp_replace(spaced, r"(?U)\s+", " "))
    repaired = F.regexp_replace(
        text, r"(?i)^web attack (brute force|xss|sql injection)$", "Web Attack - $1"
    )
    known = _lookup(CANONICAL_LABELS, F.lower(repaired))
    return F.when(raw.isNull(), MISSING_LABEL).otherwise(F.coalesce(known, repaired))


def binary_label(label: Column) -> Column:
    """0 for benign traffic, 1 for everything else."""
    return (label != BENIGN).cast("int")


def attack_family(label: Column) -> Column:
    return F.coalesce(_lookup(ATTACK_FAMILIES, label), F.lit("Other Attack"))


def operational_family(label: Column) -> Column:
    """Coarse family an analyst works with."""
    return (
        F.when((label == "DDoS") | label.startswith("DoS "), "Denial of Service")
        .when(label == "PortScan", "Port Scan")
        .when(label.isin("FTP-Patator", "SSH-Patator"), "Brute Force")
        .when(label.startswith("Web Attack - "), "Web Attack")
        .otherwise("Other Malicious")
    )


def class_name(prediction: Column) -> Column:
    return F.when(prediction == 0, BENIGN).when(prediction == 1, "ATTACK")


def severity_rank(severity: Column) -> Column:
    """Position of a severity in the fixed order, worst first."""
    rank = F.when(severity == SEVERITIES[0], 0)
    for position, level in enumerate(SEVERITIES[1:], start=1):
        rank = rank.when(severity == level, position)
    return rank.otherwise(len(SEVERITIES))
