"""Technique map and sensor alert logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TECHNIQUE_RECORD = "struct<tactic: string, techniques: array<struct<id: string, name: string, url: string>>, note: string>"

SENSOR_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("flow_id", T.LongType()),
    T.StructField("interface", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dest_ip", T.StringType()),
    T.StructField("dest_port", T.IntegerType()),
    T.StructField("proto", T.StringType()),
    T.StructField("signature_id", T.LongType()),
    T.StructField("signature", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("severity", T.IntegerType()),
    T.StructField("action", T.StringType()),
])


def read_technique_map(spark: SparkSession, path: str) -> DataFrame:
    """Family, tactic, techniques and note of every entry of the JSON map."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", f"map<string, {TECHNIQUE_RECORD}>")
    return text.select(F.explode(entries).alias("family", "_r")).select("family", "_r.*")


def technique_rows(table: DataFrame) -> DataFrame:
    """One row per technique; a family without techniques keeps one row of empty text."""
    flat = table.select("family", "tactic", F.explode_outer("techniques").alias("_t"), "note")

    def text(name: str):
        return F.coalesce(F.col(name), F.lit(""))

    return flat.select(
        F.col("family").alias("Category"), text("tactic").alias("Tactic"), text("_t.id").alias("TechniqueID"),
        text("_t.name").alias("Technique"), text("_t.url").alias("Reference"), text("note").alias("MappingNote"),
    )


def read_sensor_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alert records of a sensor log; fields a file lacks are null."""
    return spark.read.schema(SENSOR_SCHEMA).json(path)


def count_records(spark: SparkSession, path: str) -> int | None:
    """Non-empty lines of a log, or None if there is no such file."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path):
        return None
    return spark.read.text(path).where(F.trim("value") != "").count()


def signature_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("signature").agg(F.count("*").alias("alerts")).orderBy(F.desc("alerts"), "signature")
