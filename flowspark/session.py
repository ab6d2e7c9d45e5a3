"""Session helpers: settings, shared scratch space, size-checked small tables and null-safe joins."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a lookup table that may be broadcast; a larger one is joined by a shuffle, with the same result.
BROADCAST_ROWS = 50_000

# Keys of a skewed join that get their values by broadcast, at most.
HOT_KEYS = 10_000


def build_session(app: str = "flowspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.serializer", "org.apache.spark.serializer.KryoSerializer")
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach. Only a local session may do without a configured one."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-flow-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write once and read back: cuts lineage and survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal a bounded table, such as a training sample, to all cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def beside(*tables: DataFrame) -> DataFrame:
    """Put one-row tables with different columns side by side, without a join."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return rows.agg(*[F.max(f"`{c}`").alias(c) for c in rows.columns])


def local_table(df: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Pull an aggregated table through the driver only if it has at most `limit` rows.

    Returns ``(table, is_local)``. A local table has an exact known size, so the caller may
    broadcast it; otherwise the table comes back untouched for an ordinary shuffle join.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df, False
    return df.sparkSession.createDataFrame(rows, df.schema), True


def null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of both sides where null equals null; the columns of `left` come first."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    match: Column = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"_right_{c}"]) for c in on])
    return left.join(renamed, match, how).drop(*[f"_right_{c}" for c in on])


def lookup_join(df: DataFrame, table: DataFrame, on: list[str], how: str = "inner",
                limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join to an aggregated table, nulls matching: by broadcast if its counted rows allow it, else by a shuffle."""
    small, is_local = local_table(table, limit)
    return null_safe(df, F.broadcast(small) if is_local else small, on, how)


def skew_safe_lookup(df: DataFrame, table: DataFrame, key: str, weight: str,
                     hot_rows: int = 1_000_000) -> DataFrame:
    """Left join `df` to `table` (unique on `key`, nulls matching) when a few keys may own most rows of `df`.

    `weight` counts the rows of `df` behind a key. Keys above `hot_rows` and above 1 / HOT_KEYS of all rows are at
    most HOT_KEYS many, so they are broadcast; their rows then travel under hashes of their columns, unmatched, through the join
    that serves all other keys.
    """
    values = [c for c in table.columns if c not in (key, weight)]
    total = table.agg(F.sum(weight)).first()[0] or 0
    bound = max(hot_rows, total // HOT_KEYS)
    hot = df.sparkSession.createDataFrame(table.where(F.col(weight) > bound).collect(), table.schema)
    renamed = hot.select(F.col(key), *[F.col(c).alias(f"_hot_{c}") for c in values], F.lit(True).alias("_hot"))
    marked = null_safe(df, F.broadcast(renamed), [key], "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind])))
    cold = table.where(F.col(weight) <= bound).drop(weight).withColumn("_salt", F.lit(None).cast("long"))
    joined = null_safe(marked, cold, [key, "_salt"], "left")
    kept = [F.col(f"`{c}`") for c in df.columns]
    return joined.select(*kept, *[F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in values])
