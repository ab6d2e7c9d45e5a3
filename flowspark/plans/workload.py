"""Views that present the star-schema tables as flow tables, in Spark and in SQL.

``events`` stands for the flows: one event is one flow, its user the source, its type the
destination and its ``k`` property the port. Labels and feature cells are made dirty by rule so
that every cleaning step has work to do; both languages apply the same rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.labels import attack_family, binary_label, normalize_label, operational_family
from flowspark.functions.times import session_group_id, strata_key
from flowspark.schema import OPERATIONAL_FAMILIES

RAW_LABELS = [
    "BENIGN", "benign", " BENIGN ", "Benign", "BENIGN", "BENIGN", "BENIGN", "BENIGN", "BENIGN", "BENIGN",
    "DDoS", "DoS Hulk", "dos  goldeneye", "DoS slowloris", "PortScan", "portscan", "FTP-Patator",
    "SSH - Patator", "Web Attack � Brute Force", "Web Attack – XSS", "web attack Sql Injection",
    "Bot", None, "Unknown Thing", "Heartbleed", "Infiltration",
]
BENIGN_LABELS = 10
RAW_COLUMNS = [
    "Destination Port", "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Fwd Header Length", "Fwd Header Length.1", "Label",
]
RAW_FEATURES = RAW_COLUMNS[:5]
PREDICTED_FAMILIES = [*OPERATIONAL_FAMILIES, "Mystery Family"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(values: list[str | None], index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _raw_label():
    """Dirty label by rule: the first scenario is all benign, the last all attack."""
    mixed, n = F.col("event_id") * 7 + F.col("user_id"), len(RAW_LABELS)
    return _pick(RAW_LABELS, (
        F.when(F.col("event_id") % 8 == 0, F.lit(0))
        .when(F.col("event_id") % 8 == 7, BENIGN_LABELS + mixed % (n - BENIGN_LABELS)).otherwise(mixed % n)
    ))


def raw_flows(spark: SparkSession, sf: str) -> DataFrame:
    """Text cells as they stand in a capture CSV, plus the row key."""
    e = table(spark, sf, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    e11, e13 = F.col("event_id") % 11, F.col("event_id") % 13
    cells = {
        "Destination Port": k.cast("string"),
        "Flow Duration": F.when(e11 == 0, "Infinity").when(e11 == 1, F.lit(None)).when(e11 == 2, "abc")
        .when(e11 == 3, " 12.5 ").when(e11 == 4, "-inf").otherwise(F.floor(F.col("value") * 100).cast("string")),
        "Total Fwd Packets": F.when(e13 == 0, "1e3").when(e13 == 1, "5d").otherwise((k % 7).cast("string")),
        "Total Backward Packets": (k % 5).cast("string"),
        "Fwd Header Length": (k * 20).cast("string"),
        "Fwd Header Length.1": (k * 20).cast("string"),
        "Label": _raw_label(),
    }
    kept = F.col("event_id") % 97 != 0
    return e.select(
        F.col("event_id").alias("RowID"),
        F.concat(F.lit("s"), (F.col("event_id") % 8).cast("string")).alias("Scenario"),
        *[F.when(kept, v).alias(name) for name, v in cells.items()],
    )


RAW_SQL = f"""
raw AS (
  SELECT "RowID", "Scenario",
    CASE WHEN keep THEN CAST(k AS VARCHAR) END AS "Destination Port",
    CASE WHEN keep THEN CASE "RowID" % 11 WHEN 0 THEN 'Infinity' WHEN 1 THEN NULL WHEN 2 THEN 'abc'
      WHEN 3 THEN ' 12.5 ' WHEN 4 THEN '-inf' ELSE CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) END END AS "Flow Duration",
    CASE WHEN keep THEN CASE "RowID" % 13 WHEN 0 THEN '1e3' WHEN 1 THEN '5d' ELSE CAST(k % 7 AS VARCHAR) END END AS "Total Fwd Packets",
    CASE WHEN keep THEN CAST(k % 5 AS VARCHAR) END AS "Total Backward Packets",
    CASE WHEN keep THEN CAST(k * 20 AS VARCHAR) END AS "Fwd Header Length",
    CASE WHEN keep THEN CAST(k * 20 AS VARCHAR) END AS "Fwd Header Length.1",
    CASE WHEN keep THEN raw_label END AS "Label"
  FROM (
    SELECT *, [{", ".join("NULL" if v is None else f"'{v}'" for v in RAW_LABELS)}][
      CASE WHEN "RowID" % 8 = 0 THEN 0
           WHEN "RowID" % 8 = 7 THEN {BENIGN_LABELS} + ("RowID" * 7 + user_id) % {len(RAW_LABELS) - BENIGN_LABELS}
           ELSE ("RowID" * 7 + user_id) % {len(RAW_LABELS)} END + 1] AS raw_label,
      "RowID" % 97 <> 0 AS keep
    FROM (
      SELECT event_id AS "RowID", 's' || CAST(event_id % 8 AS VARCHAR) AS "Scenario", ts, user_id, event_type, value,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
      FROM events)))
"""


def flows(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned flows with labels, context, detector scores and session groups."""
    e = table(spark, sf, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    base = e.select(
        F.col("event_id").alias("RowID"),
        F.concat(F.lit("s"), (F.col("event_id") % 8).cast("string")).alias("Scenario"),
        F.col("ts").cast("timestamp").alias("Timestamp"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("SourceIP"),
        F.col("event_type").alias("DestinationIP"),
        k.alias("DestinationPort"),
        F.col("event_type").isin("click", "error", "view").cast("int").alias("SYNCount"),
        (F.col("event_type") == "error").cast("int").alias("RSTCount"),
        F.when(F.col("value") < 10, 0.0).otherwise(F.col("value")).alias("BackwardPackets"),
        F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(6.0 + F.col("event_id") % 2 * 11).alias("Protocol"),
        _raw_label().alias("LabelRaw"),
        F.col("value").alias("_value"), F.col("user_id").alias("_user"),
    ).withColumn("Label", normalize_label(F.col("LabelRaw")))
    share = F.col("_value") / (F.col("_value") + 50)
    labelled = base.withColumns({
        "BinaryLabel": binary_label(F.col("Label")),
        "AttackFamily": attack_family(F.col("Label")),
        "OperationalFamily": operational_family(F.col("Label")),
    })
    lifted = F.when(F.col("BinaryLabel") == 1, share * 0.6 + 0.35).otherwise(share * 0.7)
    return labelled.select(
        *[c for c in labelled.columns if not c.startswith("_")],
        (F.floor(lifted * 1000) / F.lit(1000.0)).alias("Score"),
        (((F.col("RowID") * 37 + F.col("_user") * 11) % 1000) / F.lit(1000.0)).alias("AnomalyScore"),
        _pick(PREDICTED_FAMILIES, (F.col("RowID") * 3 + F.col("_user")) % len(PREDICTED_FAMILIES)).alias("FamilyGuess"),
        session_group_id(F.col("Scenario"), F.col("SourceIP"), F.col("DestinationIP"),
                         F.col("BinaryLabel").cast("double"), F.col("Protocol"), F.col("Timestamp"), 7 * 24 * 60).alias("GroupID"),
        strata_key(F.col("Scenario"), F.col("BinaryLabel")).alias("Stratum"),
    )


def label_sql(column: str) -> str:
    """Canonical label of a raw label column, as SQL."""
    text = (
        f"trim(regexp_replace(regexp_replace(translate({column}, '�–—−', '----'), '\\s*-\\s*', ' - ', 'g'), "
        f"'\\s+', ' ', 'g'))"
    )
    fixed = f"regexp_replace({text}, '^web attack (brute force|xss|sql injection)$', 'Web Attack - \\1', 'i')"
    return f"""CASE WHEN {column} IS NULL THEN '<MISSING>' ELSE
      CASE lower({fixed})
        WHEN 'benign' THEN 'BENIGN' WHEN 'bot' THEN 'Bot' WHEN 'ddos' THEN 'DDoS'
        WHEN 'dos goldeneye' THEN 'DoS GoldenEye' WHEN 'dos hulk' THEN 'DoS Hulk'
        WHEN 'dos slowhttptest' THEN 'DoS Slowhttptest' WHEN 'dos slowloris' THEN 'DoS slowloris'
        WHEN 'ftp - patator' THEN 'FTP-Patator' WHEN 'ssh - patator' THEN 'SSH-Patator'
        WHEN 'heartbleed' THEN 'Heartbleed' WHEN 'infiltration' THEN 'Infiltration'
        WHEN 'portscan' THEN 'PortScan' WHEN 'web attack - brute force' THEN 'Web Attack - Brute Force'
        WHEN 'web attack - sql injection' THEN 'Web Attack - SQL Injection'
        WHEN 'web attack - xss' THEN 'Web Attack - XSS' ELSE {fixed} END END"""


FLOWS_SQL = f"""
flow_base AS (
  SELECT event_id AS "RowID", 's' || CAST(event_id % 8 AS VARCHAR) AS "Scenario", ts AS "Timestamp",
    'u' || CAST(user_id AS VARCHAR) AS "SourceIP", event_type AS "DestinationIP",
    CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS "DestinationPort",
    CASE WHEN event_type IN ('click', 'error', 'view') THEN 1 ELSE 0 END AS "SYNCount",
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS "RSTCount",
    CASE WHEN value < 10 THEN 0 ELSE value END AS "BackwardPackets",
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(6 + event_id % 2 * 11 AS DOUBLE) END AS "Protocol",
    [{", ".join("NULL" if v is None else f"'{v}'" for v in RAW_LABELS)}][
      CASE WHEN event_id % 8 = 0 THEN 0
           WHEN event_id % 8 = 7 THEN {BENIGN_LABELS} + (event_id * 7 + user_id) % {len(RAW_LABELS) - BENIGN_LABELS}
           ELSE (event_id * 7 + user_id) % {len(RAW_LABELS)} END + 1] AS "LabelRaw",
    value, user_id
  FROM events),
flow_label AS (SELECT *, {label_sql('"LabelRaw"')} AS "Label" FROM flow_base),
flow_class AS (
  SELECT *, CASE WHEN "Label" <> 'BENIGN' THEN 1 ELSE 0 END AS "BinaryLabel",
    CASE WHEN "Label" IN ('BENIGN', 'DDoS', 'Bot', 'Infiltration') THEN "Label"
      WHEN "Label" IN ('DoS GoldenEye', 'DoS Hulk', 'DoS Slowhttptest', 'DoS slowloris') THEN 'DoS'
      WHEN "Label" = 'Heartbleed' THEN 'Exploit' WHEN "Label" = 'PortScan' THEN 'Port Scan'
      WHEN "Label" IN ('FTP-Patator', 'SSH-Patator') THEN 'Brute Force'
      WHEN "Label" IN ('Web Attack - Brute Force', 'Web Attack - SQL Injection', 'Web Attack - XSS') THEN 'Web Attack'
      ELSE 'Other Attack' END AS "AttackFamily",
    CASE WHEN "Label" = 'DDoS' OR "Label" LIKE 'DoS %' THEN 'Denial of Service'
      WHEN "Label" = 'PortScan' THEN 'Port Scan'
      WHEN "Label" IN ('FTP-Patator', 'SSH-Patator') THEN 'Brute Force'
      WHEN "Label" LIKE 'Web Attack - %' THEN 'Web Attack' ELSE 'Other Malicious' END AS "OperationalFamily"
  FROM flow_label),
flows AS (
  SELECT * EXCLUDE (value, user_id),
    floor(CASE WHEN "BinaryLabel" = 1 THEN value / (value + 50) * CAST(0.6 AS DOUBLE) + CAST(0.35 AS DOUBLE)
               ELSE value / (value + 50) * CAST(0.7 AS DOUBLE) END * 1000) / CAST(1000 AS DOUBLE) AS "Score",
    CAST(("RowID" * 37 + user_id * 11) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS "AnomalyScore",
    [{", ".join(f"'{v}'" for v in PREDICTED_FAMILIES)}][("RowID" * 3 + user_id) % {len(PREDICTED_FAMILIES)} + 1] AS "FamilyGuess",
    "Scenario" || '|' || "SourceIP" || '|' || "DestinationIP" || '|' || CAST(CAST("BinaryLabel" AS DOUBLE) AS VARCHAR) || '|'
      || coalesce(CAST("Protocol" AS VARCHAR), 'MISSING') || '|'
      || strftime(make_timestamp((epoch_us("Timestamp") // 604800000000) * 604800000000), '%Y-%m-%d %H:%M:%S') AS "GroupID",
    "Scenario" || '::' || CAST("BinaryLabel" AS VARCHAR) AS "Stratum"
  FROM flow_class)
"""


def with_flows(body: str) -> str:
    return f"WITH {FLOWS_SQL}{body}"


def with_raw(body: str) -> str:
    return f"WITH {RAW_SQL}{body}"
