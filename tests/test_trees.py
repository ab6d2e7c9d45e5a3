from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.operators import boosting, forest, trees


def points(seed, n=600, width=4):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, width)).astype(float)
    x[:, 0] = rng.normal(size=n)
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(0, 0.5, n) > 1.5).astype(int) + (x[:, 2] > 8)
    return x, y


def table(spark, x, y, held=10):
    rows = [(*map(float, r), int(t), 1.0 + (k % 3) / 2, k % held == 0) for k, (r, t) in enumerate(zip(x, y))]
    names = [f"x{i}" for i in range(x.shape[1])]
    schema = ", ".join(f"{n} double" for n in names) + ", target int, weight double, held boolean"
    return spark.createDataFrame(rows, schema).repartition(3), names


def test_bins_keep_order_and_separate_values(spark):
    x, y = points(1)
    df, names = table(spark, x, y)
    edges = trees.bin_edges(df, names)
    bins = trees.to_bins(x, edges)
    assert all(len(e) < trees.BINS for e in edges)
    assert len(np.unique(bins[:, 1])) == len(np.unique(x[:, 1])) == 12  # few values: a bin each
    for f in range(4):
        order = x[:, f].argsort()
        assert (np.diff(bins[order, f].astype(int)) >= 0).all()
    empty = trees.bin_edges(df.where("false"), names)
    assert [len(e) for e in empty] == [0] * 4 and trees.to_bins(x, empty).max() == 0


def brute_cut(bins, g, h, s):
    """Best (gain, feature, bin) over all cuts of the rows' bins."""
    best = (0.0, None, None)
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + s.l2)
    for f in range(bins.shape[1]):
        for b in range(int(bins[:, f].max())):
            left = bins[:, f] <= b
            if min(left.sum(), (~left).sum()) < s.min_rows or min(h[left].sum(), h[~left].sum()) < s.min_curvature:
                continue
            gain = score(left) + score(~left) - score(np.ones(len(g), bool))
            if gain > best[0] + 1e-9:
                best = (gain, f, b)
    return best


@pytest.mark.parametrize("seed", range(5))
def test_cut_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    bins = rng.integers(0, 9, (200, 3)).astype(np.uint8)
    g, h = rng.normal(size=200), rng.random(200)
    settings = boosting.Boosting(min_rows=7)
    columns = list(bins.T)
    cut = boosting.best_cut(boosting.histogram(columns, np.arange(200), g, h), settings)
    gain, f, b = brute_cut(bins, g, h, settings)
    assert (cut.feature, cut.bin) == (f, b) and cut.gain == pytest.approx(gain)
    left = bins[:, f] <= b
    assert cut.left == pytest.approx((g[left].sum(), h[left].sum(), left.sum()))
    assert boosting.best_cut(boosting.histogram(columns, np.arange(10), g, h), settings) is None
    parts = [boosting.best_cut(boosting.histogram(columns[k:k + 1], np.arange(200), g, h), settings, [k]) for k in range(3)]
    best = max(parts, key=lambda c: c.gain)
    assert (best.feature, best.bin) == (cut.feature, cut.bin) and best.gain == pytest.approx(cut.gain)


def brute_tree(bins, g, h, s):
    """Leaf of every row of a tree grown strictly best leaf first, one cut at a time."""
    leaf = np.zeros(len(bins), int)
    cuts = {0: brute_cut(bins, g, h, s)}
    while len(cuts) < s.leaves:
        node = max(cuts, key=lambda k: (cuts[k][0], -k))
        if cuts[node][0] <= 0:
            break
        rows, (_, f, b), new = np.flatnonzero(leaf == node), cuts[node], max(cuts) + 1
        leaf[rows[bins[rows, f] > b]] = new
        for k in (node, new):
            m = leaf == k
            cuts[k] = brute_cut(bins[m], g[m], h[m], s)
    return leaf


@pytest.mark.parametrize("leaves", [2, 5, 12])
def test_first_tree_is_grown_best_leaf_first(spark, leaves):
    x, y = points(leaves)
    y = np.minimum(y, 1)
    df, names = table(spark, x, y)
    s = boosting.Boosting(iterations=1, leaves=leaves)
    model = boosting.fit_boosting(df, names, "target", "weight", "held", 2, s)
    fit = np.arange(len(x)) % 10 != 0
    weight = 1.0 + (np.arange(len(x)) % 3) / 2
    assert model.start[0] == pytest.approx(np.log(weight[fit & (y == 1)].sum() / weight[fit & (y == 0)].sum()))
    bins = trees.to_bins(x, model.edges)
    g, h = boosting.gradients(np.full((len(x), 1), model.start[0]), y, weight)
    leaf = brute_tree(bins[fit], g[fit, 0], h[fit, 0], s)
    raw = np.log(model.probabilities(x)[:, 1] / model.probabilities(x)[:, 0]) - model.start[0]
    for k in np.unique(leaf):
        m = leaf == k
        assert raw[fit][m] == pytest.approx(-s.rate * g[fit, 0][m].sum() / (h[fit, 0][m].sum() + s.l2))


def test_all_classes_in_one_round_early_stop_and_shared_features(spark):
    x, y = points(3, 900)
    df, names = table(spark, x, y)
    s = boosting.Boosting(iterations=25)
    model = boosting.fit_boosting(df, names, "target", "weight", "held", 3, s)
    assert len(model.trees) == 75
    for tasks in (3,):  # the features divided over tasks that exchange cuts
        assert boosting.fit_boosting(df, names, "target", "weight", "held", 3, replace(s, iterations=1), tasks=tasks).probabilities(x) == pytest.approx(
            boosting.fit_boosting(df, names, "target", "weight", "held", 3, replace(s, iterations=1)).probabilities(x))
    p = model.probabilities(x)
    assert p.sum(axis=1) == pytest.approx(1) and (p.argmax(axis=1) == y).mean() > 0.85
    again = boosting.fit_boosting(df.repartition(5), names, "target", "weight", "held", 3, s)
    assert again.probabilities(x) == pytest.approx(p)
    noise = np.random.default_rng(0).integers(0, 2, len(x))
    stopped = boosting.fit_boosting(table(spark, x, noise)[0], names, "target", "weight", "held", 2, replace(s, iterations=100))
    assert len(stopped.trees) < 60
    one = boosting.fit_boosting(df.where("target = 1"), names, "target", "weight", "held", 3, s)
    assert one.probabilities(x[:3]).argmax(axis=1).tolist() == [1, 1, 1]


def test_forest_cut_equals_brute_force():
    rng = np.random.default_rng(2)
    slot, bins, y = rng.integers(0, 3, 300), rng.integers(0, 10, 300), rng.integers(0, 4, 300)
    cells = np.zeros((300, 4))
    cells[np.arange(300), y] = rng.random(300)
    score, cut = forest.best_cuts(slot, bins, cells, np.ones(300, int), 3, 2)
    for node in range(3):
        m = slot == node
        found = []
        for b in range(10):
            left, right = cells[m & (bins <= b)], cells[m & (bins > b)]
            if min(len(left), len(right)) >= 2:
                found.append((sum((s.sum(axis=0) ** 2).sum() / s.sum() for s in (left, right)), -b))
        assert score[node] == pytest.approx(max(found)[0]) and cut[node] == -max(found)[1]


def test_forest_fits_and_is_the_same_in_any_row_order(spark):
    x, y = points(5, 800)
    df, names = table(spark, x, y)
    model = forest.fit_forest(df, names, "target", 3, 25, 24)
    p = model.probabilities(x)
    assert len(model.trees) == 25 and p.sum(axis=1) == pytest.approx(1) and (p.argmax(axis=1) == y).mean() > 0.95
    assert forest.fit_forest(df.repartition(7), names, "target", 3, 25, 24).probabilities(x) == pytest.approx(p)
    assert model.importance().sum() == pytest.approx(1) and model.importance()[0] > model.importance()[3]
    small = forest.fit_forest(df, names, "target", 3, 5, 3, pool_rows=100)
    assert all(t.depth <= 3 for t in small.trees)
    flat = forest.fit_forest(df.where("target = 2"), names, "target", 3, 2, 5)
    assert flat.probabilities(x[:2]).tolist() == [[0, 0, 1], [0, 0, 1]]
    with pytest.raises(ValueError):
        forest.fit_forest(df.where("false"), names, "target", 3)


def test_scoring_a_column_skips_nulls_and_saves(spark, tmp_path):
    x, y = points(6, 200)
    df, names = table(spark, x, y)
    for model in (forest.fit_forest(df, names, "target", 3, 4, 6), boosting.fit_boosting(df, names, "target", "weight", "held", 3, boosting.Boosting(iterations=3))):
        model.save(spark, str(tmp_path / model.link))
        loaded = trees.Ensemble.load(spark, str(tmp_path / model.link))
        point = F.when(F.col("target") > 0, F.array(*names))
        rows = df.select(*names, "target", loaded.column(spark, point).alias("p")).collect()
        for r in rows:
            assert (r.p is None) == (r.target == 0)
            assert r.p is None or r.p == pytest.approx(model.probabilities(np.array([[r[n] for n in names]]))[0].tolist())


def test_boosting_fits_on_all_rows(spark):
    """Rows beyond any pool: equal ones count as often as they occur, in the start values, the histograms and the row bound."""
    n = 450_000
    df = spark.range(n).selectExpr("cast(id % 50 AS double) AS x0", "cast(id % 7 = 0 AS int) AS target", "1.0D AS weight", "id % 10 = 0 AS held")
    model = boosting.fit_boosting(df, ["x0"], "target", "weight", "held", 2, boosting.Boosting(iterations=2))
    ids = np.arange(n)
    ids = ids[ids % 10 != 0]
    assert model.start[0] == pytest.approx(np.log((ids % 7 == 0).sum() / (ids % 7 != 0).sum()), abs=1e-12)
    x, y = points(8, 300)
    few, names = table(spark, x, y)
    many = few.unionByName(few).unionByName(few)
    s = boosting.Boosting(iterations=3)
    wanted = boosting.fit_boosting(many, names, "target", "weight", "held", 3, s)
    thrice = few.withColumn("weight", F.col("weight") * 3)
    assert wanted.probabilities(x) == pytest.approx(boosting.fit_boosting(
        thrice, names, "target", "weight", "held", 3, replace(s, min_rows=7)).probabilities(x))  # 20 of three rows each need seven
    # two tasks may settle cuts of equal gain differently; with weights of their own for all rows such cuts part the same training rows
    many = many.withColumn("weight", 1 + F.pmod(F.hash("x0"), F.lit(9973)) / 9973)
    fitted, one = np.arange(300) % 10 != 0, replace(s, iterations=1)
    parts = [boosting.fit_boosting(many, names, "target", "weight", "held", 3, one, tasks=k).probabilities(x)[fitted] for k in (1, 2)]
    assert parts[0] == pytest.approx(parts[1])
