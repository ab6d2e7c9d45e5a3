"""Deterministic sampling and splitting by hash rank.

A row's rank is the position of its md5 key inside its stratum, so every run and every engine
draws the same rows. Counts of md5 prefixes decide all rows but those that share a prefix with a
cut, in a plain pass; only these few are shuffled and ranked. A null stratum is one like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.numeric import ratio
from flowspark.schema import OPERATIONAL_FAMILIES
from flowspark.session import lookup_join, materialize, null_safe, skew_safe_lookup

SEED = 42
SPLITS = ["train", "validation", "test"]
PREFIX_DIGITS = 4
#: Seeds that a grouped split tries before it lays out all others at once; the first of them is tried alone.
FIRST_ATTEMPTS = 8


def hash_key(seed: int | Column, ids: Sequence[str]) -> Column:
    salt = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", salt, *[F.col(c).cast("string") for c in ids]))


def _hashed(df: DataFrame, ids: Sequence[str], seed: int | Column) -> DataFrame:
    return df.withColumn("_h", hash_key(seed, ids)).withColumn("_b", F.substring("_h", 1, PREFIX_DIGITS))


def hash_segments(df: DataFrame, strata: Sequence[str], ids: Sequence[str], cuts: DataFrame,
                  names: Sequence[str], seed: int = SEED, rest: str | None = None) -> DataFrame:
    """Label rows by hash rank: ranks up to the first cut get the first name, and so on.

    `cuts` holds one row per stratum and, for each name, a column of that name with the
    cumulative rank where its segment ends. Rows beyond the last cut are labelled `rest`, or
    dropped when `rest` is None.
    """
    strata = list(strata)
    keyed = _hashed(df, ids, seed)
    before = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    prefixes = null_safe(
        keyed.groupBy(*strata, "_b").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))),
        cuts, strata,
    )
    edges = materialize(prefixes.groupBy(*strata).agg(*[
        agg for name in names for agg in (
            F.max(F.when(F.col("_before") < F.col(name), F.col("_b"))).alias(f"_edge_{name}"),
            F.max_by(
                F.when(F.col("_before") < F.col(name), F.col(name) - F.col("_before")),
                F.when(F.col("_before") < F.col(name), F.col("_b")),
            ).alias(f"_left_{name}"),
        )
    ]), "edges")
    placed = lookup_join(keyed, edges, strata)
    on_edge = F.coalesce(reduce(lambda a, b: a | b, [F.col("_b").eqNullSafe(F.col(f"_edge_{name}")) for name in names]), F.lit(False))

    def segment(rank: Column) -> Column:
        found = F.lit(rest)
        for name in reversed(names):
            edge, left = F.col(f"_edge_{name}"), F.col(f"_left_{name}")
            found = F.when((F.col("_b") < edge) | ((F.col("_b") == edge) & (rank <= left)), name).otherwise(found)
        return found

    rank = F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_h", *ids))
    decided = placed.where(~on_edge).withColumn("segment", segment(F.lit(0)))
    ranked = placed.where(on_edge).withColumn("_rank", rank).withColumn("segment", segment(F.col("_rank"))).drop("_rank")
    labelled = decided.unionByName(ranked)
    if rest is None:
        labelled = labelled.where(F.col("segment").isNotNull())
    return labelled.select(*[F.col(f"`{c}`") for c in df.columns], "segment")


def allocate_quotas(counts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Share `total` over the keys in proportion to `count` by largest remainder.

    Takes one row per key; equal remainders go to the smaller key first.
    """
    everything = Window.partitionBy(F.lit(0))
    share = F.col("_goal") * F.col(count) / F.col("_available")
    ranked = (
        counts.withColumn("_available", F.sum(count).over(everything))
        .withColumn("_goal", F.least(F.lit(int(total)), F.col("_available")))
        .withColumn("_share", share)
        .withColumn("_floor", F.floor("_share"))
        .withColumn("_missing", F.col("_goal") - F.sum("_floor").over(everything))
    )
    turn = F.row_number().over(everything.orderBy((F.col("_share") - F.col("_floor")).desc(), key))
    extra = (turn <= F.col("_missing")).cast("long")
    return ranked.select(*counts.columns, (F.col("_floor") + extra).alias("quota"))


def take_quota(df: DataFrame, quotas: DataFrame, strata: Sequence[str], ids: Sequence[str],
               seed: int = SEED) -> DataFrame:
    """The first `quota` rows of each stratum in hash order."""
    cuts = quotas.select(*strata, F.col("quota").alias("picked"))
    return hash_segments(df, strata, ids, cuts, ["picked"], seed).drop("segment")


def proportional_sample(df: DataFrame, size: int, by: str = "Scenario",
                        ids: Sequence[str] = ("Scenario", "RowID"), seed: int = SEED) -> DataFrame:
    """Exactly `size` rows (or all, without ranking them), shared over the scenarios in proportion to their rows."""
    counts = materialize(df.groupBy(by).agg(F.count("*").alias("rows")), "sample-counts")
    if (counts.agg(F.sum("rows")).first()[0] or 0) <= size:
        return df
    return take_quota(df, allocate_quotas(counts, by, "rows", size), [by], ids, seed)


def benign_pool(df: DataFrame, size: int, seed: int = SEED) -> DataFrame:
    """A proportional sample of benign rows only."""
    return proportional_sample(df.where(F.col("BinaryLabel") == 0), size, seed=seed)


def stratified_split(df: DataFrame, strata: Sequence[str], ids: Sequence[str],
                     seed: int = SEED) -> DataFrame:
    """Add ``split``: 20 % test, then 20 % of the rest validation, within every stratum."""
    counts = df.groupBy(*strata).agg(F.count("*").alias("_rows"))
    test = F.floor((F.col("_rows") * 20 + 50) / 100)
    held = test + F.floor(((F.col("_rows") - test) * 20 + 50) / 100)
    cuts = counts.select(*strata, test.alias("test"), held.alias("validation"))
    labelled = hash_segments(df, strata, ids, cuts, ["test", "validation"], seed, rest="train")
    return labelled.withColumnRenamed("segment", "split")


def calibration_split(df: DataFrame, fraction: float, by: str = "Scenario",
                      ids: Sequence[str] = ("Scenario", "RowID"), exclude: str | None = None,
                      seed: int = SEED) -> DataFrame:
    """Add ``split`` (train or calibration) per scenario; a scenario of one row only trains."""
    pool = df if exclude is None else df.where(F.col(by) != exclude)
    counts = pool.groupBy(by).agg(F.count("*").alias("_rows"))
    held = F.when(F.col("_rows") < 2, 0).otherwise(F.ceil(F.col("_rows") * F.lit(fraction)))
    cuts = counts.select(by, held.alias("calibration"))
    labelled = hash_segments(pool, [by], ids, cuts, ["calibration"], seed, rest="train")
    return labelled.withColumnRenamed("segment", "split")


def cap_per_class(df: DataFrame, limit: int, family: str = "OperationalFamily",
                  ids: Sequence[str] = ("Scenario", "RowID"), seed: int = SEED,
                  expected: Sequence[str] = tuple(OPERATIONAL_FAMILIES)) -> DataFrame:
    """Undersample families above `limit`; every expected family must have rows."""
    counts = df.groupBy(family).agg(F.count("*").alias("rows"))
    present = {row[0] for row in counts.select(family).where(F.col(family).isin(list(expected))).collect()}
    absent = [name for name in expected if name not in present]
    if absent:
        raise ValueError(f"no rows for {', '.join(absent)}")
    quotas = counts.withColumn("quota", F.least(F.col("rows"), F.lit(int(limit))))
    return take_quota(df, quotas, [family], ids, seed)


def demo_mix(df: DataFrame, per_scenario: int, ids: Sequence[str] = ("Scenario", "RowID"),
             seed: int = SEED) -> DataFrame:
    """Half attack, half benign rows per scenario; a short class is filled from the other."""
    half, size = per_scenario // 2, F.lit(int(per_scenario))
    counts = df.groupBy("Scenario").agg(
        F.count_if(F.col("BinaryLabel") == 1).alias("_attack"),
        F.count_if(F.col("BinaryLabel") == 0).alias("_benign"),
    )
    attack = F.least("_attack", F.greatest(F.lit(half), size - F.col("_benign")))
    benign = F.least(F.col("_benign"), size - attack)
    quotas = counts.select(
        "Scenario",
        F.explode(F.array(
            F.struct(F.lit(1).alias("BinaryLabel"), attack.alias("quota")),
            F.struct(F.lit(0).alias("BinaryLabel"), benign.alias("quota")),
        )).alias("_q"),
    ).select("Scenario", "_q.BinaryLabel", "_q.quota")
    return take_quota(df, quotas, ["Scenario", "BinaryLabel"], ids, seed)


def group_table(df: DataFrame, group: str, stratum: str) -> DataFrame:
    """One row per group: its size and the stratum most of its rows fall in."""
    per_stratum = df.groupBy(group, stratum).agg(F.count("*").alias("_n"))
    return per_stratum.groupBy(group).agg(
        F.sum("_n").alias("rows"), F.max_by(stratum, F.struct("_n", stratum)).alias(stratum)
    )


def assign_groups(groups: DataFrame, group: str, stratum: str, seed: int | Column = SEED, by: Sequence[str] = ()) -> DataFrame:
    """Give every group one split, about 20 % test, 16 % validation, 64 % train per stratum.

    A group holding over half of its stratum trains. The others are laid end to end in hash
    order; where a group starts decides its split, so groups never cross a boundary. `by` names
    columns whose values each have a layout of their own, such as the seeds of several attempts.
    """
    keys = [*by, stratum]
    totals = groups.groupBy(*keys).agg(F.sum("rows").alias("_total"))
    sized = _hashed(lookup_join(groups, totals, keys), [group], seed)
    big = F.col("rows") * 2 > F.col("_total")
    laid = sized.withColumn("_weight", F.when(big, F.lit(0)).otherwise(F.col("rows")))
    prior = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = laid.groupBy(*keys, "_b").agg(F.sum("_weight").alias("_w")).select(
        *keys, "_b", F.coalesce(F.sum("_w").over(prior), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("_h", group).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("_start") + F.coalesce(F.sum("_weight").over(inside), F.lit(0))
    placed = null_safe(laid, starts, [*keys, "_b"]).withColumn("_begin", begin)
    split = (
        F.when(F.col("rows") * 2 > F.col("_total"), "train")
        .when(F.col("_begin") * 100 < F.col("_total") * 20, "test")
        .when(F.col("_begin") * 100 < F.col("_total") * 36, "validation")
        .otherwise("train")
    )
    return placed.select(*by, *[c for c in groups.columns if c not in by], split.alias("split"))


def grouped_stratified_split(df: DataFrame, group: str = "GroupID", stratum: str = "Stratum",
                             seed: int = SEED, hot_rows: int = 1_000_000) -> DataFrame:
    """Add ``split`` so that no group is divided and every stratum is balanced."""
    groups = materialize(group_table(df, group, stratum), "groups")
    assigned = materialize(assign_groups(groups, group, stratum, seed), "assigned")
    return skew_safe_lookup(df, assigned.select(group, "rows", "split"), group, "rows", hot_rows)


def grouped_split_all_classes(df: DataFrame, family: str = "OperationalFamily", group: str = "GroupID",
                              max_attempts: int = 100, seed: int = SEED) -> tuple[DataFrame, int]:
    """First seed whose grouped split shows every family in every part; error if none does.

    The first seed, which nearly always covers, is laid out and stored alone. Only if it does not, all seeds of a batch are
    laid out over the stored group table in one job, and the first that covers is picked by aggregation: one job for the rest
    of the first FIRST_ATTEMPTS seeds, one more for all others. The chosen layout is stored.
    """
    members = df.groupBy(group, family).agg(F.count("*").alias("_n"))
    # families are few, so a group's list of them is short
    groups = materialize(members.groupBy(group).agg(
        F.sum("_n").alias("rows"), F.max_by(family, F.struct("_n", family)).alias("_stratum"),
        F.collect_set(F.struct(F.col(family).alias("f"))).alias("_families")), "groups")
    def laid_out(one: int) -> DataFrame:
        return materialize(assign_groups(groups, group, "_stratum", one), "assigned")

    last, found = seed + max_attempts, None
    if seed < last:
        layout = laid_out(seed)
        found = seed if covers_families(layout) else None
    batch = max(seed + 1, min(seed + FIRST_ATTEMPTS, last))
    for low, high in ((seed + 1, batch), (batch, last)):
        if found is None and low < high:
            found = covering_seed(groups, group, low, high)
    if found is None:
        raise RuntimeError(f"no grouped split covers every family within {max_attempts} attempts")
    chosen = layout if found == seed else laid_out(found)
    return skew_safe_lookup(df, chosen.select(group, "rows", "split"), group, "rows"), found


def covers_families(layout: DataFrame) -> bool:
    """Whether a layout of the group table has every family in every split."""
    seen = layout.select("split", F.explode("_families").alias("_f")).distinct()
    row = seen.agg(F.count("*").alias("n"), F.count_distinct("_f").alias("families")).first()
    return row["n"] > 0 and row["n"] == row["families"] * len(SPLITS)


def covering_seed(groups: DataFrame, group: str, low: int, high: int) -> int | None:
    """The first seed of [low, high) whose layout of the group table has every family in every split."""
    tried = groups.withColumn("_seed", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
    laid = assign_groups(tried, group, "_stratum", F.col("_seed"), ["_seed"])
    seen = laid.select("_seed", "split", F.explode("_families").alias("_f")).distinct()
    everything = Window.partitionBy(F.lit(0))  # a row a seed, family and split
    covered = seen.withColumn("_families", F.size(F.collect_set("_f").over(everything))).groupBy("_seed").agg(
        F.count("*").alias("n"), F.max("_families").alias("families"))
    row = covered.where(F.col("n") == F.col("families") * len(SPLITS)).agg(F.min("_seed").alias("first")).first()
    return row["first"]


def group_overlap(df: DataFrame, group: str = "GroupID") -> DataFrame:
    """Groups shared by each pair of splits, and the number of groups: one row."""
    per_group = df.groupBy(group).agg(*[F.max((F.col("split") == s).cast("int")).alias(s) for s in SPLITS])
    return per_group.agg(
        F.sum(F.col("train") * F.col("validation")).alias("train_validation_overlap"),
        F.sum(F.col("train") * F.col("test")).alias("train_test_overlap"),
        F.sum(F.col("validation") * F.col("test")).alias("validation_test_overlap"),
        F.count("*").alias("unique_groups"),
    )


def require_isolation(df: DataFrame, group: str = "GroupID") -> dict[str, int]:
    """Overlap counts; raises if any group sits in two splits."""
    found = group_overlap(df, group).first().asDict()
    if any(v for k, v in found.items() if k.endswith("_overlap")):
        raise RuntimeError(f"groups cross splits: {found}")
    return found


def split_distribution(df: DataFrame, by: Sequence[str] = ("Scenario", "Label", "AttackFamily", "BinaryLabel")
                       ) -> DataFrame:
    return df.groupBy("split", *by).agg(F.count("*").alias("rows"))


def label_coverage(distribution: DataFrame, by: Sequence[str] = ("Label", "AttackFamily", "BinaryLabel")
                   ) -> DataFrame:
    """Rows of each label per split, and whether training and all splits have seen it."""
    wide = distribution.groupBy(*by).pivot("split", SPLITS).sum("rows").na.fill(0, SPLITS)
    everywhere = reduce(lambda a, b: a & b, [F.col(s) > 0 for s in SPLITS])
    return wide.select(
        *by, *SPLITS, (F.col("train") > 0).alias("seen_in_training"),
        everywhere.alias("represented_in_all_splits"),
    )


def unseen_labels(coverage: DataFrame) -> DataFrame:
    """Labels tested on but never trained on."""
    return coverage.where((F.col("test") > 0) & (F.col("train") == 0))


def holdout_folds(pool: DataFrame, folds: Sequence[str], by: str = "Scenario") -> DataFrame:
    """Training rows of every leave-one-out fold: each row once per fold that does not hold it out."""
    others = F.filter(F.array(*[F.lit(f) for f in folds]), lambda f: f != F.col(by))
    return pool.withColumn("Holdout", F.explode(others))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("rows"))
    everything = Window.partitionBy(F.lit(0))
    weight = ratio(F.sum("rows").over(everything), F.count("*").over(everything) * F.col("rows"))
    return counts.withColumn("weight", weight)
