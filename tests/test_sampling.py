import hashlib

import pytest
from pyspark.sql import functions as F

from flowspark.operators import sampling
from flowspark.plans import catalog_sampling, demo


def flows(spark, n=3000):
    sc = F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 3 == 1, "big").when(F.col("id") % 50 == 2, "tiny").otherwise("mid")
    return spark.range(n).select(F.col("id").alias("RowID"), sc.alias("Scenario"), (F.col("id") % 7 < 2).cast("int").alias("BinaryLabel"))


def key(scenario, row):
    return hashlib.md5(f"42|{scenario}|{row}".encode()).hexdigest()


def test_quotas(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "k string, n long")
    got = {r["k"]: r["quota"] for r in sampling.allocate_quotas(df, "k", "n", 4).collect()}
    assert got == {"a": 2, "b": 1, "c": 1} and sum(got.values()) == 4
    capped = sampling.allocate_quotas(df, "k", "n", 100).collect()
    assert {r["k"]: r["quota"] for r in capped} == {"a": 5, "b": 3, "c": 2}
    ties = spark.createDataFrame([("b", 1), ("a", 1), ("c", 1)], "k string, n long")
    assert {r["k"]: r["quota"] for r in sampling.allocate_quotas(ties, "k", "n", 2).collect()} == {"a": 1, "b": 1, "c": 0}


def test_sample_is_first_by_hash(spark):
    rows = flows(spark)
    picked = sampling.proportional_sample(rows, 500).collect()
    assert len(picked) == 500 and len({(r["Scenario"], r["RowID"]) for r in picked}) == 500
    everything = rows.collect()
    for scenario in ("big", "mid", "tiny"):
        mine = {r["RowID"] for r in picked if r["Scenario"] == scenario}
        order = sorted((r["RowID"] for r in everything if r["Scenario"] == scenario), key=lambda i: key(scenario, i))
        assert mine == set(order[:len(mine)])


def test_short_prefixes_share_buckets(spark, monkeypatch):
    monkeypatch.setattr(sampling, "PREFIX_DIGITS", 1)
    rows = flows(spark)
    picked = {(r["Scenario"], r["RowID"]) for r in sampling.proportional_sample(rows, 777).collect()}
    assert len(picked) == 777
    monkeypatch.undo()
    assert picked == {(r["Scenario"], r["RowID"]) for r in sampling.proportional_sample(rows, 777).collect()}


def test_stratified_split(spark):
    split = sampling.stratified_split(flows(spark), ["BinaryLabel"], ["Scenario", "RowID"])
    for label in (0, 1):
        n = {r["split"]: r["count"] for r in split.where(F.col("BinaryLabel") == label).groupBy("split").count().collect()}
        total = sum(n.values())
        assert n["test"] == round(total * 0.2) and n["validation"] == round((total - n["test"]) * 0.2)
    assert split.count() == 3000 and split.select("RowID").distinct().count() == 3000


def test_calibration_split(spark):
    rows = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 0), ("c", 0), ("c", 1)], "Scenario string, RowID long")
    got = {(r["Scenario"], r["split"]): r["count"] for r in
           sampling.calibration_split(rows, 0.2, exclude="x").groupBy("Scenario", "split").count().collect()}
    assert got == {("a", "calibration"): 2, ("a", "train"): 8, ("b", "train"): 1, ("c", "calibration"): 1, ("c", "train"): 1}
    assert sampling.calibration_split(rows, 0.2, exclude="a").count() == 3


def test_cap_and_missing_family(spark):
    rows = flows(spark).withColumn("OperationalFamily", F.col("Scenario"))
    capped = sampling.cap_per_class(rows, 100, expected=["big", "tiny"])
    assert {r["OperationalFamily"]: r["count"] for r in capped.groupBy("OperationalFamily").count().collect()} == {
        "big": 100, "mid": 100, "tiny": rows.where("Scenario = 'tiny'").count()}
    with pytest.raises(ValueError, match="gone"):
        sampling.cap_per_class(rows, 100, expected=["big", "gone"])


def test_demo_mix_spills_over(spark):
    rows = spark.createDataFrame([("a", i, int(i < 3)) for i in range(50)] + [("b", i, int(i >= 2)) for i in range(50)] + [("c", i, 0) for i in range(4)],
                                 "Scenario string, RowID long, BinaryLabel int")
    got = {(r["Scenario"], r["BinaryLabel"]): r["count"] for r in
           sampling.demo_mix(rows, 10).groupBy("Scenario", "BinaryLabel").count().collect()}
    assert got == {("a", 1): 3, ("a", 0): 7, ("b", 1): 8, ("b", 0): 2, ("c", 0): 4}


def grouped(spark):
    # One group holds a third of all rows; the others are small.
    group = F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 300).cast("string")))
    return spark.range(6000).select(F.col("id").alias("RowID"), group.alias("GroupID"), F.lit("s").alias("Scenario"),
                                    F.when(F.col("id") < 2000, "x").otherwise(F.concat(F.lit("s"), (F.col("id") % 2).cast("string"))).alias("Stratum"))


@pytest.mark.parametrize("hot_rows", [1_000_000, 100])
def test_grouped_split(spark, hot_rows):
    rows = grouped(spark)
    split = sampling.grouped_stratified_split(rows, hot_rows=hot_rows)
    assert split.count() == 6000 and split.where("split IS NULL").count() == 0
    found = sampling.require_isolation(split)
    assert found["unique_groups"] == 301
    assert [r["split"] for r in split.where("GroupID = 'hot'").select("split").distinct().collect()] == ["train"]
    for stratum in ("s0", "s1"):
        n = {r["split"]: r["count"] / 2000 for r in split.where(F.col("Stratum") == stratum).groupBy("split").count().collect()}
        assert n["test"] == pytest.approx(0.2, abs=0.01) and n["validation"] == pytest.approx(0.16, abs=0.01)
    plain = {r["RowID"]: r["split"] for r in sampling.grouped_stratified_split(rows).collect()}
    assert {r["RowID"]: r["split"] for r in split.collect()} == plain


def test_overlap_raises(spark):
    rows = spark.createDataFrame([("g", "train"), ("g", "test"), ("h", "test")], "GroupID string, split string")
    assert sampling.group_overlap(rows).first()["train_test_overlap"] == 1
    with pytest.raises(RuntimeError):
        sampling.require_isolation(rows)


def test_demo_set_has_context_and_one_order(spark, tmp_path):
    rows = spark.range(900).select((F.col("id") % 3).cast("string").alias("Scenario"), F.col("id").alias("RowID"),
                                   (F.col("id") % 4 == 0).cast("int").alias("BinaryLabel"), F.lit(80).alias("Port"))
    context = rows.select("Scenario", "RowID", F.lit(443).alias("Port"), F.concat(F.lit("h"), F.col("RowID").cast("string")).alias("Host"))
    got = demo.demo_set(rows, context, 40).collect()
    assert len(got) == 120 and sorted(r["DemoPosition"] for r in got) == list(range(1, 121))
    assert all(r["Context Port"] == 443 and r["Port"] == 80 and r["Host"] == f"h{r['RowID']}" for r in got)
    again = {r["RowID"]: r["DemoPosition"] for r in demo.demo_set(rows.repartition(5), context, 40).collect()}
    assert again == {r["RowID"]: r["DemoPosition"] for r in got}
    by_place = [r["Scenario"] for r in sorted(got, key=lambda r: r["DemoPosition"])]
    assert len({tuple(by_place[k: k + 3]) for k in range(0, 120, 3)}) > 5
    with pytest.raises(ValueError, match="align"):
        demo.demo_set(rows, context.where("RowID % 2 = 0"), 40)
    with pytest.raises(ValueError, match="at least"):
        demo.demo_set(rows, context, 10)
    demo.write_demo(rows, context, str(tmp_path / "demo"), 40)
    assert spark.read.option("header", True).csv(str(tmp_path / "demo")).count() == 120


def test_split_with_all_classes(spark, monkeypatch):
    rows = grouped(spark).withColumn("OperationalFamily", F.when(F.col("RowID") % 300 < 12, "rare").otherwise("common"))
    rows = rows.where("GroupID <> 'hot'")
    split, seed = sampling.grouped_split_all_classes(rows)
    assert split.select("split", "OperationalFamily").distinct().count() == 6 and seed >= 42
    sampling.require_isolation(split)
    single = rows.withColumn("OperationalFamily", F.when(F.col("GroupID") == "g5", "single").otherwise("common"))
    with pytest.raises(RuntimeError):
        sampling.grouped_split_all_classes(single, max_attempts=2)
    # the batch of seeds finds what trying them one by one finds, in the first job or in the second
    groups = rows.groupBy("GroupID", "OperationalFamily").count()

    def covers(one):
        table = sampling.group_table(rows, "GroupID", "OperationalFamily")
        laid = sampling.assign_groups(table, "GroupID", "OperationalFamily", one).select("GroupID", "split")
        return laid.join(groups, "GroupID").select("split", "OperationalFamily").distinct().count() == 6

    assert covers(seed) and not any(covers(s) for s in range(42, seed))
    monkeypatch.setattr(sampling, "FIRST_ATTEMPTS", 0)
    again, other = sampling.grouped_split_all_classes(rows)
    assert other == seed and again.exceptAll(split.select(*again.columns)).isEmpty()


def test_split_lays_out_one_seed_if_the_first_covers(spark, monkeypatch):
    rows = spark.range(2000).select((F.col("id") % 500).alias("GroupID"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("OperationalFamily"))
    monkeypatch.setattr(sampling, "covering_seed", lambda *others: pytest.fail("several seeds laid out"))
    split, seed = sampling.grouped_split_all_classes(rows)
    assert seed == 42 and split.count() == rows.count()
    assert split.select("split", "OperationalFamily").distinct().count() == 6
    with pytest.raises(RuntimeError):
        sampling.grouped_split_all_classes(rows, max_attempts=0)


def test_coverage(spark):
    rows = spark.createDataFrame([("train", "a", "f", 0, 3), ("test", "a", "f", 0, 1), ("test", "b", "f", 1, 2)],
                                 "split string, Label string, AttackFamily string, BinaryLabel int, rows long")
    table = {r["Label"]: r for r in sampling.label_coverage(rows).collect()}
    assert table["a"]["train"] == 3 and table["a"]["validation"] == 0 and table["a"]["seen_in_training"]
    assert [r["Label"] for r in sampling.unseen_labels(sampling.label_coverage(rows)).collect()] == ["b"]


def test_class_weights(spark):
    rows = spark.createDataFrame([(0,)] * 3 + [(1,)], "y int")
    assert {r["y"]: r["weight"] for r in sampling.class_weights(rows, "y").collect()} == {0: pytest.approx(4 / 6), 1: 2.0}


def test_null_strata_keep_their_rows(spark):
    df = spark.range(1000).select(F.col("id").alias("RowID"), F.when(F.col("id") % 10 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("Scenario"))
    assert sampling.stratified_split(df, ["Scenario"], ["RowID"]).count() == 1000
    for size in (1000, 137):
        assert sampling.proportional_sample(df, size, ids=["RowID"]).count() == size


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_null_groups_get_a_split(spark, hot_rows):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 97).alias("GroupID"), (F.col("id") % 2).alias("Stratum"))
    split = sampling.grouped_stratified_split(df, hot_rows=hot_rows)
    assert split.count() == 1000 and split.where("split IS NULL").isEmpty()
    assert split.groupBy("GroupID").agg(F.count_distinct("split").alias("n")).where("n <> 1").isEmpty()


def test_split_balance_sums_the_sizes_of_huge_groups(spark, monkeypatch):
    sizes = [("hot", "x", 5_000_000_000), *[(f"g{i}", "y", 3_000_000_000 + i) for i in range(50)]]
    groups = spark.createDataFrame(sizes, "GroupID string, Stratum string, rows long")
    monkeypatch.setattr(catalog_sampling, "flows", lambda spark, sf: groups)
    monkeypatch.setattr(sampling, "group_table", lambda rows, group, stratum: groups)
    got = catalog_sampling.split_balance(spark, "").collect()
    assert {r["split"]: (r["row_count"], r["share"]) for r in got if r["stratum"] == "x"} == {"train": (5_000_000_000, 1.0)}
    others = [r for r in got if r["stratum"] == "y"]
    assert sum(r["row_count"] for r in others) == sum(n for _, s, n in sizes if s == "y")
    assert all(r["share"] == pytest.approx(r["row_count"] / 150_000_001_225, abs=1e-6) for r in others)
