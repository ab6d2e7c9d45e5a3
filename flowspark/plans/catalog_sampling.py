"""Queries over quotas, samples, splits and their checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowspark.functions.numeric import ratio
from flowspark.operators import sampling
from flowspark.plans import demo
from flowspark.plans.registry import query, r, rounded
from flowspark.plans.workload import flows, table, with_flows

SAMPLE = 3000
HASH = """md5('42|' || "Scenario" || '|' || CAST("RowID" AS VARCHAR))"""


def rank_sql(part: str, hashed: str = HASH) -> str:
    return f'row_number() OVER (PARTITION BY {part} ORDER BY {hashed}, "Scenario", "RowID")'


def quota_sql(total: int, where: str = "") -> str:
    """quotas(scenario, n, quota) by largest remainder."""
    return f"""
counts AS (SELECT "Scenario" AS scenario, count(*) AS n FROM flows {where} GROUP BY 1),
shares AS (SELECT *, CAST(least({total}, sum(n) OVER ()) AS DOUBLE) * n / sum(n) OVER () AS share, least({total}, sum(n) OVER ()) AS goal FROM counts),
quotas AS (SELECT scenario, n, CAST(floor(share) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, scenario)
  <= goal - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS quota FROM shares)"""


@query("quota_allocation", with_flows(f""", {quota_sql(SAMPLE)} SELECT scenario, n AS row_count, quota FROM quotas"""))
def quota_allocation(spark, sf):
    counts = flows(spark, sf).groupBy("Scenario").agg(F.count("*").alias("rows"))
    return sampling.allocate_quotas(counts, "Scenario", "rows", SAMPLE).withColumnsRenamed({"Scenario": "scenario", "rows": "row_count"})


@query("proportional_sample", with_flows(f""", {quota_sql(SAMPLE)}
SELECT f."Scenario" AS scenario, f."RowID" AS row_id, f."Label" AS label FROM (SELECT *, {rank_sql('"Scenario"')} AS n FROM flows) f
JOIN quotas ON quotas.scenario = f."Scenario" WHERE f.n <= quota"""))
def proportional_sample(spark, sf):
    picked = sampling.proportional_sample(flows(spark, sf).select("Scenario", "RowID", "Label"), SAMPLE)
    return picked.select(F.col("Scenario").alias("scenario"), F.col("RowID").alias("row_id"), F.col("Label").alias("label"))


@query("benign_pool", with_flows(f""", {quota_sql(1000, 'WHERE "BinaryLabel" = 0')}
SELECT f."Scenario" AS scenario, f."RowID" AS row_id FROM (SELECT *, {rank_sql('"Scenario"')} AS n FROM flows WHERE "BinaryLabel" = 0) f
JOIN quotas ON quotas.scenario = f."Scenario" WHERE f.n <= quota"""))
def benign_pool(spark, sf):
    pool = sampling.benign_pool(flows(spark, sf).select("Scenario", "RowID", "BinaryLabel"), 1000)
    return pool.select(F.col("Scenario").alias("scenario"), F.col("RowID").alias("row_id"))


@query("stratified_split", with_flows(f"""
SELECT scenario, row_id, binary_label, CASE WHEN k <= t THEN 'test' WHEN k <= t + ((n - t) * 20 + 50) // 100 THEN 'validation' ELSE 'train' END AS split
FROM (SELECT *, (n * 20 + 50) // 100 AS t FROM (
  SELECT "Scenario" AS scenario, "RowID" AS row_id, "BinaryLabel" AS binary_label, {rank_sql('"BinaryLabel"')} AS k,
    count(*) OVER (PARTITION BY "BinaryLabel") AS n FROM flows))"""))
def stratified_split(spark, sf):
    rows = flows(spark, sf).select("Scenario", "RowID", "BinaryLabel")
    found = sampling.stratified_split(rows, ["BinaryLabel"], ["Scenario", "RowID"])
    return found.withColumnsRenamed({"Scenario": "scenario", "RowID": "row_id", "BinaryLabel": "binary_label"})


@query("calibration_split", with_flows(f"""
SELECT scenario, row_id, CASE WHEN n >= 2 AND k <= ceil(n * CAST(0.2 AS DOUBLE)) THEN 'calibration' ELSE 'train' END AS split FROM (
  SELECT "Scenario" AS scenario, "RowID" AS row_id, {rank_sql('"Scenario"')} AS k, count(*) OVER (PARTITION BY "Scenario") AS n
  FROM flows WHERE "BinaryLabel" = 0 AND "Scenario" <> 's3')"""))
def calibration_split(spark, sf):
    rows = flows(spark, sf).where(F.col("BinaryLabel") == 0).select("Scenario", "RowID")
    return sampling.calibration_split(rows, 0.2, exclude="s3").withColumnsRenamed({"Scenario": "scenario", "RowID": "row_id"})


@query("capped_families", with_flows(f"""
SELECT scenario, row_id, family FROM (SELECT "Scenario" AS scenario, "RowID" AS row_id, "OperationalFamily" AS family,
  {rank_sql('"OperationalFamily"')} AS k FROM flows WHERE "BinaryLabel" = 1) WHERE k <= 700"""))
def capped_families(spark, sf):
    attacks = flows(spark, sf).where(F.col("BinaryLabel") == 1).select("Scenario", "RowID", "OperationalFamily")
    return sampling.cap_per_class(attacks, 700).withColumnsRenamed(
        {"Scenario": "scenario", "RowID": "row_id", "OperationalFamily": "family"})


@query("demo_mix", with_flows(f""",
mix AS (SELECT scenario, a, b, least(a, greatest(100, 201 - b)) AS want_a FROM (
  SELECT "Scenario" AS scenario, count(*) FILTER ("BinaryLabel" = 1) AS a, count(*) FILTER ("BinaryLabel" = 0) AS b FROM flows GROUP BY 1))
SELECT f."Scenario" AS scenario, f."RowID" AS row_id, f."BinaryLabel" AS binary_label FROM (
  SELECT *, {rank_sql('"Scenario", "BinaryLabel"')} AS k FROM flows) f JOIN mix ON mix.scenario = f."Scenario"
WHERE k <= CASE WHEN f."BinaryLabel" = 1 THEN want_a ELSE least(b, 201 - want_a) END"""))
def demo_mix(spark, sf):
    rows = flows(spark, sf).select("Scenario", "RowID", "BinaryLabel")
    return sampling.demo_mix(rows, 201).withColumnsRenamed({"Scenario": "scenario", "RowID": "row_id", "BinaryLabel": "binary_label"})


@query("demo_set", with_flows(f""",
mix AS (SELECT scenario, a, b, least(a, greatest(30, 61 - b)) AS want_a FROM (
  SELECT "Scenario" AS scenario, count(*) FILTER ("BinaryLabel" = 1) AS a, count(*) FILTER ("BinaryLabel" = 0) AS b FROM flows GROUP BY 1))
SELECT row_number() OVER (ORDER BY md5('{sampling.SEED + 1}|' || f."Scenario" || '|' || CAST(f."RowID" AS VARCHAR)), f."Scenario", f."RowID") AS position,
  f."Scenario" AS scenario, f."RowID" AS row_id, f."BinaryLabel" AS binary_label, f."DestinationPort" AS port, f."DestinationPort" + 1 AS context_port,
  f."SourceIP" AS source_ip FROM (
  SELECT *, {rank_sql('"Scenario", "BinaryLabel"')} AS k FROM flows) f JOIN mix ON mix.scenario = f."Scenario"
WHERE k <= CASE WHEN f."BinaryLabel" = 1 THEN want_a ELSE least(b, 61 - want_a) END"""))
def demo_set(spark, sf):
    f = flows(spark, sf)
    context = f.select("Scenario", "RowID", "SourceIP", (F.col("DestinationPort") + 1).alias("DestinationPort"))
    found = demo.demo_set(f.select("Scenario", "RowID", "BinaryLabel", "DestinationPort"), context, 61)
    return found.select(
        F.col("DemoPosition").alias("position"), F.col("Scenario").alias("scenario"), F.col("RowID").alias("row_id"),
        F.col("BinaryLabel").alias("binary_label"), F.col("DestinationPort").alias("port"),
        F.col("Context DestinationPort").alias("context_port"), F.col("SourceIP").alias("source_ip"))


GROUPED_SQL = """,
per_stratum AS (SELECT "GroupID" AS g, "Stratum" AS s, count(*) AS n FROM flows GROUP BY 1, 2),
groups AS (SELECT g, CAST(sum(n) AS BIGINT) AS n, max_by(s, lpad(CAST(n AS VARCHAR), 12, '0') || s) AS s FROM per_stratum GROUP BY 1),
sized AS (SELECT *, sum(n) OVER (PARTITION BY s) AS total, md5('42|' || g) AS h FROM groups),
laid AS (SELECT *, CASE WHEN n * 2 > total THEN 0 ELSE n END AS w FROM sized),
placed AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY s ORDER BY h, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM laid),
assigned AS (SELECT g, s, n, CASE WHEN n * 2 > total THEN 'train' WHEN b * 100 < total * 20 THEN 'test'
  WHEN b * 100 < total * 36 THEN 'validation' ELSE 'train' END AS split FROM placed)"""


@query("grouped_split", with_flows(GROUPED_SQL + """
SELECT f."RowID" AS row_id, f."GroupID" AS group_id, a.split FROM flows f JOIN assigned a ON a.g = f."GroupID" """))
def grouped_split(spark, sf):
    rows = flows(spark, sf).select("RowID", "GroupID", "Stratum")
    return sampling.grouped_stratified_split(rows).select(
        F.col("RowID").alias("row_id"), F.col("GroupID").alias("group_id"), "split")


@query("split_balance", with_flows(GROUPED_SQL + f"""
SELECT s AS stratum, split, CAST(sum(n) AS BIGINT) AS row_count, {r('sum(n) / sum(sum(n)) OVER (PARTITION BY s)', 'share')}
FROM assigned GROUP BY 1, 2"""))
def split_balance(spark, sf):
    rows = flows(spark, sf).select("GroupID", "Stratum")
    assigned = sampling.assign_groups(sampling.group_table(rows, "GroupID", "Stratum"), "GroupID", "Stratum")
    counts = assigned.groupBy("Stratum", "split").agg(F.sum("rows").alias("row_count"))
    total = F.sum("row_count").over(Window.partitionBy("Stratum"))
    return rounded(counts.select(F.col("Stratum").alias("stratum"), "split", "row_count", ratio(F.col("row_count"), total, 0.0).alias("share")),
                   "share")


@query("split_distribution", with_flows(GROUPED_SQL + """
SELECT split, "Scenario" AS scenario, "Label" AS label, "AttackFamily" AS family, "BinaryLabel" AS binary_label, count(*) AS row_count
FROM flows JOIN assigned ON g = "GroupID" GROUP BY ALL"""))
def split_distribution(spark, sf):
    found = sampling.split_distribution(sampling.grouped_stratified_split(flows(spark, sf)))
    return found.withColumnsRenamed({"Scenario": "scenario", "Label": "label", "AttackFamily": "family",
                                     "BinaryLabel": "binary_label", "rows": "row_count"})


@query("label_coverage", with_flows(GROUPED_SQL + """
SELECT "Label" AS label, "AttackFamily" AS family, "BinaryLabel" AS binary_label, count(*) FILTER (split = 'train') AS train,
  count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test,
  count(*) FILTER (split = 'train') > 0 AS seen_in_training,
  count(DISTINCT split) = 3 AS represented_in_all_splits FROM flows JOIN assigned ON g = "GroupID" GROUP BY 1, 2, 3"""))
def label_coverage(spark, sf):
    found = sampling.label_coverage(sampling.split_distribution(sampling.grouped_stratified_split(flows(spark, sf))))
    return found.withColumnsRenamed({"Label": "label", "AttackFamily": "family", "BinaryLabel": "binary_label"})


@query("group_overlap", with_flows(""",
placed AS (SELECT "SourceIP" AS g, CASE WHEN "RowID" % 50 = 0 THEN 'test' WHEN "RowID" % 50 = 1 THEN 'validation' ELSE 'train' END AS split FROM flows),
seen AS (SELECT g, bool_or(split = 'train') AS a, bool_or(split = 'validation') AS b, bool_or(split = 'test') AS c FROM placed GROUP BY 1)
SELECT count(*) FILTER (a AND b) AS train_validation_overlap, count(*) FILTER (a AND c) AS train_test_overlap,
  count(*) FILTER (b AND c) AS validation_test_overlap, count(*) AS unique_groups FROM seen"""))
def group_overlap(spark, sf):
    split = F.when(F.col("RowID") % 50 == 0, "test").when(F.col("RowID") % 50 == 1, "validation").otherwise("train")
    return sampling.group_overlap(flows(spark, sf).select(F.col("SourceIP").alias("GroupID"), split.alias("split")))


@query("group_isolation", with_flows("""
SELECT 0 AS train_validation_overlap, 0 AS train_test_overlap, 0 AS validation_test_overlap,
  count(DISTINCT "GroupID") AS unique_groups FROM flows"""))
def group_isolation(spark, sf):
    return sampling.group_overlap(sampling.grouped_stratified_split(flows(spark, sf).select("RowID", "GroupID", "Stratum")))


@query("family_split", with_flows(f""",
members AS (SELECT "GroupID" AS g, "OperationalFamily" AS f, count(*) AS n FROM flows WHERE "BinaryLabel" = 1 GROUP BY 1, 2),
groups AS (SELECT g, CAST(sum(n) AS BIGINT) AS n, max_by(f, lpad(CAST(n AS VARCHAR), 12, '0') || f) AS s FROM members GROUP BY 1),
seeds AS (SELECT unnest(range({sampling.SEED}, {sampling.SEED + 100})) AS seed),
sized AS (SELECT *, sum(n) OVER (PARTITION BY seed, s) AS total, md5(CAST(seed AS VARCHAR) || '|' || g) AS h FROM groups, seeds),
laid AS (SELECT *, CASE WHEN n * 2 > total THEN 0 ELSE n END AS w FROM sized),
placed AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY seed, s ORDER BY h, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM laid),
assigned AS (SELECT seed, g, CASE WHEN n * 2 > total THEN 'train' WHEN b * 100 < total * 20 THEN 'test'
  WHEN b * 100 < total * 36 THEN 'validation' ELSE 'train' END AS split FROM placed),
seen AS (SELECT DISTINCT seed, f, split FROM assigned JOIN members ON assigned.g = members.g),
covering AS (SELECT seed FROM seen GROUP BY 1 HAVING count(*) = 3 * (SELECT count(DISTINCT f) FROM members))
SELECT f AS "OperationalFamily", split, CAST(sum(n) AS BIGINT) AS row_count FROM assigned JOIN members ON assigned.g = members.g
WHERE seed = (SELECT min(seed) FROM covering) GROUP BY 1, 2"""))
def family_split(spark, sf):
    attacks = flows(spark, sf).where(F.col("BinaryLabel") == 1)
    split, _ = sampling.grouped_split_all_classes(attacks.select("Scenario", "RowID", "GroupID", "OperationalFamily"))
    return split.groupBy("OperationalFamily", "split").agg(F.count("*").alias("row_count"))


@query("holdout_training_sets", with_flows("""
SELECT b.holdout, count(*) AS row_count, count(DISTINCT "Scenario") AS scenarios FROM flows,
  (SELECT DISTINCT "Scenario" AS holdout FROM flows) b WHERE "Scenario" <> b.holdout GROUP BY 1"""))
def holdout_training_sets(spark, sf):
    f = flows(spark, sf).select("Scenario", "RowID")
    folds = [row[0] for row in f.select("Scenario").distinct().orderBy("Scenario").collect()]
    return sampling.holdout_folds(f, folds).groupBy(F.col("Holdout").alias("holdout")).agg(
        F.count("*").alias("row_count"), F.count_distinct("Scenario").alias("scenarios"))


@query("class_weights", f"""
SELECT label, count(*) AS row_count, {r('sum(count(*)) OVER () / (count(*) OVER () * count(*))', 'weight')} FROM embeddings GROUP BY 1""")
def class_weights(spark, sf):
    found = sampling.class_weights(table(spark, sf, "embeddings"), "label")
    return rounded(found.withColumnRenamed("rows", "row_count"), "weight")
