"""Names, fixed lookup values and header handling for flow tables."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Sequence

# --------------------------------------------------------------------------------------
# Fixed values. They define the published data set and must match it exactly.
# --------------------------------------------------------------------------------------

# Text that a flow CSV uses for a missing cell.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Text that a flow CSV uses for an infinite value.
INFINITY_TOKENS = [
    "Infinity", "+Infinity", "-Infinity", "inf", "+inf", "-inf", "INF", "+INF", "-INF",
]

# Names a label column may have, in order of preference.
LABEL_COLUMN_NAMES = ["label", "class", "target", "attack", "attack_cat", "category"]

# Context columns of the generated-flow collection.
CONTEXT_COLUMNS = [
    ("Flow ID", "string"),
    ("Source IP", "string"),
    ("Source Port", "double"),
    ("Destination IP", "string"),
    ("Destination Port", "double"),
    ("Protocol", "double"),
    ("Timestamp", "string"),
]

# Columns both collections share, used to prove that their rows align.
ALIGNMENT_COLUMNS = [
    "Destination Port", "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
]

# Lower-case cleaned label -> canonical label.
CANONICAL_LABELS = {
    "benign": "BENIGN",
    "bot": "Bot",
    "ddos": "DDoS",
    "dos goldeneye": "DoS GoldenEye",
    "dos hulk": "DoS Hulk",
    "dos slowhttptest": "DoS Slowhttptest",
    "dos slowloris": "DoS slowloris",
    "ftp-patator": "FTP-Patator",
    "ftp - patator": "FTP-Patator",
    "heartbleed": "Heartbleed",
    "infiltration": "Infiltration",
    "portscan": "PortScan",
    "ssh-patator": "SSH-Patator",
    "ssh - patator": "SSH-Patator",
    "web attack - brute force": "Web Attack - Brute Force",
    "web attack - sql injection": "Web Attack - SQL Injection",
    "web attack - xss": "Web Attack - XSS",
}

# Canonical label -> attack family; anything else is "Other Attack".
ATTACK_FAMILIES = {
    "BENIGN": "BENIGN",
    "DDoS": "DDoS",
    "DoS GoldenEye": "DoS",
    "DoS Hulk": "DoS",
    "DoS Slowhttptest": "DoS",
    "DoS slowloris": "DoS",
    "Heartbleed": "Exploit",
    "PortScan": "Port Scan",
    "FTP-Patator": "Brute Force",
    "SSH-Patator": "Brute Force",
    "Web Attack - Brute Force": "Web Attack",
    "Web Attack - SQL Injection": "Web Attack",
    "Web Attack - XSS": "Web Attack",
    "Bot": "Bot",
    "Infiltration": "Infiltration",
}

# Operational families in report order.
OPERATIONAL_FAMILIES = [
    "Denial of Service", "Port Scan", "Brute Force", "Web Attack", "Other Malicious",
]

# Severity levels from worst to mildest.
SEVERITIES = ["Critical", "High", "Medium", "Low"]

# Reasons that the ledger states, by known attack pattern and anomaly.
REASON_BOTH = "Known attack pattern and anomalous relative to benign behavior"
REASON_KNOWN = "Known supervised attack pattern"
REASON_ANOMALY = "Unusual relative to the learned benign profile"
REASON_NONE = "No known attack pattern and no anomaly flag"

# Names of the readiness checks and the sentences they may state.
CHECK_NAMES = ["Data rows", "Column-name integrity", "Trained model schema", "Numeric feature quality", "Dynamic cross-flow context"]
CHECK_CONTEXT_USABLE = "Source IP, destination IP, timestamp, destination port, and SYN count are usable"
CHECK_NO_DUPLICATES = "No duplicate names after BOM/whitespace cleanup"
CHECK_IMPUTATION = " feature cells require training-time imputation"
CHECK_FEATURES_PRESENT = " required features present"
CHECK_UNUSABLE = " contain no usable numbers"
CHECK_INVALID_CONTEXT = "Invalid or blank context values: "

# Training feature -> column name written by the live flow extractor, in training order.
EXTRACTOR_COLUMNS = {
    "Destination Port": "dst_port",
    "Flow Duration": "flow_duration",
    "Total Fwd Packets": "tot_fwd_pkts",
    "Total Backward Packets": "tot_bwd_pkts",
    "Total Length of Fwd Packets": "totlen_fwd_pkts",
    "Total Length of Bwd Packets": "totlen_bwd_pkts",
    "Fwd Packet Length Max": "fwd_pkt_len_max",
    "Fwd Packet Length Min": "fwd_pkt_len_min",
    "Fwd Packet Length Mean": "fwd_pkt_len_mean",
    "Fwd Packet Length Std": "fwd_pkt_len_std",
    "Bwd Packet Length Max": "bwd_pkt_len_max",
    "Bwd Packet Length Min": "bwd_pkt_len_min",
    "Bwd Packet Length Mean": "bwd_pkt_len_mean",
    "Bwd Packet Length Std": "bwd_pkt_len_std",
    "Flow Bytes/s": "flow_byts_s",
    "Flow Packets/s": "flow_pkts_s",
    "Flow IAT Mean": "flow_iat_mean",
    "Flow IAT Std": "flow_iat_std",
    "Flow IAT Max": "flow_iat_max",
    "Flow IAT Min": "flow_iat_min",
    "Fwd IAT Total": "fwd_iat_tot",
    "Fwd IAT Mean": "fwd_iat_mean",
    "Fwd IAT Std": "fwd_iat_std",
    "Fwd IAT Max": "fwd_iat_max",
    "Fwd IAT Min": "fwd_iat_min",
    "Bwd IAT Total": "bwd_iat_tot",
    "Bwd IAT Mean": "bwd_iat_mean",
    "Bwd IAT Std": "bwd_iat_std",
    "Bwd IAT Max": "bwd_iat_max",
    "Bwd IAT Min": "bwd_iat_min",
    "Fwd PSH Flags": "fwd_psh_flags",
    "Bwd PSH Flags": "bwd_psh_flags",
    "Fwd URG Flags": "fwd_urg_flags",
    "Bwd URG Flags": "bwd_urg_flags",
    "Fwd Header Length": "fwd_header_len",
    "Bwd Header Length": "bwd_header_len",
    "Fwd Packets/s": "fwd_pkts_s",
    "Bwd Packets/s": "bwd_pkts_s",
    "Min Packet Length": "pkt_len_min",
    "Max Packet Length": "pkt_len_max",
    "Packet Length Mean": "pkt_len_mean",
    "Packet Length Std": "pkt_len_std",
    "Packet Length Variance": "pkt_len_var",
    "FIN Flag Count": "fin_flag_cnt",
    "SYN Flag Count": "syn_flag_cnt",
    "RST Flag Count": "rst_flag_cnt",
    "PSH Flag Count": "psh_flag_cnt",
    "ACK Flag Count": "ack_flag_cnt",
    "URG Flag Count": "urg_flag_cnt",
    "CWE Flag Count": "cwr_flag_count",
    "ECE Flag Count": "ece_flag_cnt",
    "Down/Up Ratio": "down_up_ratio",
    "Average Packet Size": "pkt_size_avg",
    "Avg Fwd Segment Size": "fwd_seg_size_avg",
    "Avg Bwd Segment Size": "bwd_seg_size_avg",
    "Fwd Avg Bytes/Bulk": "fwd_byts_b_avg",
    "Fwd Avg Packets/Bulk": "fwd_pkts_b_avg",
    "Fwd Avg Bulk Rate": "fwd_blk_rate_avg",
    "Bwd Avg Bytes/Bulk": "bwd_byts_b_avg",
    "Bwd Avg Packets/Bulk": "bwd_pkts_b_avg",
    "Bwd Avg Bulk Rate": "bwd_blk_rate_avg",
    "Subflow Fwd Packets": "subflow_fwd_pkts",
    "Subflow Fwd Bytes": "subflow_fwd_byts",
    "Subflow Bwd Packets": "subflow_bwd_pkts",
    "Subflow Bwd Bytes": "subflow_bwd_byts",
    "Init_Win_bytes_forward": "init_fwd_win_byts",
    "Init_Win_bytes_backward": "init_bwd_win_byts",
    "act_data_pkt_fwd": "fwd_act_data_pkts",
    "min_seg_size_forward": "fwd_seg_size_min",
    "Active Mean": "active_mean",
    "Active Std": "active_std",
    "Active Max": "active_max",
    "Active Min": "active_min",
    "Idle Mean": "idle_mean",
    "Idle Std": "idle_std",
    "Idle Max": "idle_max",
    "Idle Min": "idle_min",
}

# Live extractor context column -> flow-table column.
EXTRACTOR_CONTEXT = {
    "src_ip": "SourceIP",
    "dst_ip": "DestinationIP",
    "src_port": "SourcePort",
    "protocol": "ProtocolNumber",
    "timestamp": "Timestamp",
}

# Features that the extractor reports in seconds and the training schema holds in microseconds.
TIME_FEATURES = [
    "Flow Duration", "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min", "Fwd IAT Total", "Fwd IAT Mean",
    "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min", "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max",
    "Bwd IAT Min", "Active Mean", "Active Std", "Active Max", "Active Min", "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
]
SECONDS_TO_MICROSECONDS = 1_000_000.0

# Logical column -> accepted physical names, in order of preference.
COLUMN_ALIASES = {
    "source_ip": ["SourceIP", "Source IP", "src_ip"],
    "destination_ip": ["DestinationIP", "Destination IP", "dst_ip"],
    "timestamp": ["Timestamp", "timestamp"],
    "destination_port": ["Destination Port", "DestinationPort", "dst_port"],
    "syn_count": ["SYN Flag Count", "syn_flag_cnt"],
    "rst_count": ["RST Flag Count", "rst_flag_cnt"],
    "ack_count": ["ACK Flag Count", "ack_flag_cnt"],
    "backward_packets": ["Total Backward Packets", "Total Bwd Packets", "tot_bwd_pkts"],
    "scenario": ["Scenario", "scenario"],
    "ground_truth": ["GroundTruth", "Ground Truth", "ground_truth"],
    "row_id": ["RowID", "Row ID", "row_id"],
}

# Columns of the ledger that describe the flow rather than the prediction.
LEDGER_CONTEXT = [
    "Flow ID", "RowID", "SourceFile", "Scenario", "Source IP", "Source Port",
    "Destination IP", "Context Destination Port", "Protocol", "Timestamp", "Label",
    "AttackFamily", "BinaryLabel",
]

# Columns the scoring job appends, in ledger order.
LEDGER_PREDICTIONS = [
    "KnownAttackProbability", "BinaryDecisionThreshold", "BinaryPrediction",
    "PredictedAttackFamily", "FamilyConfidence", "AnomalyScore", "AnomalyThreshold",
    "AnomalyMargin", "AnomalyFlag", "AlertSeverity", "AlertReason", "MITRETactic",
    "MITRETechniqueID", "MITRETechniqueName", "MITREReference", "MITREMappingNote",
]

# Columns of the analyst's alert table, in display order.
ALERT_VIEW = [
    "AlertSeverity", "AlertReason", "KnownAttackProbability", "BinaryPrediction",
    "PredictedAttackFamily", "FamilyConfidence", "AnomalyScore", "AnomalyMargin",
    "AnomalyFlag", "MITRETactic", "MITRETechniqueID", "MITRETechniqueName", "Flow ID",
    "Source IP", "Source Port", "Destination IP", "Context Destination Port",
    "Destination Port", "Protocol", "Timestamp", "Scenario", "Label", "BinaryLabel",
    "BinaryCorrect",
]

# --------------------------------------------------------------------------------------
# Derived names and driver-side header logic.
# --------------------------------------------------------------------------------------

FEATURES = list(EXTRACTOR_COLUMNS)


def q(name: str) -> str:
    """Back-quote a column name so that dots and spaces resolve literally."""
    return "`" + name.replace("`", "``") + "`"


def clean_header(names: Iterable[str]) -> list[str]:
    """Strip byte-order marks and surrounding space."""
    return [str(name).replace("\ufeff", "").strip() for name in names]


def unique_names(names: Iterable[str]) -> list[str]:
    """Number repeats: X, X.1, X.2 in order of appearance."""
    repeats: dict[str, int] = {}
    result = []
    for name in names:
        n = repeats.setdefault(name, 0)
        repeats[name] += 1
        result.append(f"{name}.{n}" if n else name)
    return result


def parse_header(line: str) -> list[str]:
    """Column names of one raw CSV header line, cleaned but with repeats kept."""
    return clean_header(next(csv.reader([line])))


def find_label_column(names: Sequence[str]) -> str | None:
    """Locate the class column by well-known name, else by suffix."""
    by_lower = {name.lower(): name for name in names}
    known = [by_lower[c] for c in LABEL_COLUMN_NAMES if c in by_lower]
    suffixed = [n for n in names if n.lower().endswith("label") or "attack label" in n.lower()]
    return next(iter(known + suffixed), None)


def resolve_alias(names: Sequence[str], logical: str, required: bool = False) -> str | None:
    """First physical column standing for a logical one."""
    found = next((alias for alias in COLUMN_ALIASES[logical] if alias in names), None)
    if found is None and required:
        raise ValueError(
            f"no column for {logical}; accepted names are {', '.join(COLUMN_ALIASES[logical])}"
        )
    return found


def repeated_names(names: Iterable[str]) -> list[str]:
    """Names that occur more than once."""
    seen, twice = set(), []
    for name in names:
        if name in seen and name not in twice:
            twice.append(name)
        seen.add(name)
    return twice


def duplicate_pairs(names: Sequence[str]) -> list[tuple[str, str]]:
    """(base, copy) pairs for columns named X and X.n."""
    pairs = []
    for name in names:
        base, dot, suffix = name.rpartition(".")
        if dot and suffix.isdigit() and base in names:
            pairs.append((base, name))
    return pairs
