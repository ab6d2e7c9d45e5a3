"""Technique enrichment per operational family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowspark.sources.lookups import TECHNIQUE_RECORD

# Family -> (tactic, [(technique id, name)], note). The address of a technique
# follows from its id.
TECHNIQUE_URL = "https://attack.mitre.org/techniques/{}/"
TECHNIQUES = {
    "Denial of Service": (
        "Impact",
        [("T1498", "Network Denial of Service"), ("T1499", "Endpoint Denial of Service")],
        "The broad project family contains DDoS and several DoS variants. Packet, service, and endpoint "
        "evidence is required to choose the most specific technique or sub-technique.",
    ),
    "Port Scan": (
        "Discovery",
        [("T1046", "Network Service Discovery")],
        "Operational enrichment for service/port discovery behavior. External active scanning may require "
        "a different ATT&CK context.",
    ),
    "Brute Force": (
        "Credential Access",
        [("T1110", "Brute Force")],
        "The dataset family combines FTP-Patator and SSH-Patator. The exact T1110 sub-technique requires "
        "authentication evidence.",
    ),
    "Web Attack": (
        "Initial Access",
        [("T1190", "Exploit Public-Facing Application")],
        "Family-level enrichment for SQL injection, XSS, and web brute-force records. Not every web request "
        "proves successful exploitation.",
    ),
    "Other Malicious": (
        "Analyst Review",
        [],
        "This combined family contains Bot, Infiltration, and Heartbleed. There is no defensible single "
        "ATT&CK technique without the original label and supporting network/host evidence.",
    ),
    "Anomalous / Unmapped": (
        "Unmapped",
        [],
        "An anomaly is a behavioral deviation, not an ATT&CK technique. Analyst investigation is required "
        "before mapping.",
    ),
    "BENIGN": ("", [], "No ATT&CK enrichment is applied to non-alerting traffic."),
}


def default_techniques(spark: SparkSession) -> DataFrame:
    """The built-in technique map in the form :func:`read_technique_map` returns."""
    rows = [
        (family, (tactic, [(i, n, TECHNIQUE_URL.format(i)) for i, n in techniques], note))
        for family, (tactic, techniques, note) in TECHNIQUES.items()
    ]
    return spark.createDataFrame(rows, f"family string, r {TECHNIQUE_RECORD}").select("family", "r.*")
