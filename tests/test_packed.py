import numpy as np
import pytest

from flowspark.operators import boosting, forest, iforest, trees


def grown(classes):
    rng = np.random.default_rng(classes)
    bins, y = rng.integers(0, 200, (4000, 5)).astype(np.uint8), rng.integers(0, classes, 4000)
    return bins, forest.grow_tree(bins, y, classes, 24, 3, rng)


@pytest.mark.parametrize("classes", [2, 5])
def test_packed_forest_tree_gives_the_same_values_in_few_bytes(classes):
    bins, tree = grown(classes)
    packed = trees.PackedTree.of(tree, bins.shape[1])
    flat, base = bins.ravel(), trees.row_starts(bins)
    assert (packed.values(flat, base) == tree.value[tree.leaves(flat, base)]).all()
    size = sum(x.nbytes for x in (packed.feature, packed.cut, packed.code, packed.value))
    assert size < 5 * len(tree.cut) + 40 * len(packed.value) and len(packed.value) < len(tree.cut) / 3
    assert packed.gain == pytest.approx(np.bincount(tree.feature, weights=tree.gain, minlength=5))


def test_packed_boosting_tree_gives_the_same_values():
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 50, (3000, 300)).astype(np.uint8)  # more features than a byte holds
    target = (bins[:, 299] + rng.integers(0, 40, 3000) > 45).astype(int)
    grown = boosting.train(bins, target, np.ones(3000), np.zeros(3000, bool), [0.0], boosting.Boosting(iterations=2), range(300))
    flat, base = bins.ravel(), trees.row_starts(bins)
    for tree in grown:
        packed = trees.PackedTree.of(tree, 300)
        assert packed.feature.max() > 255 and (packed.values(flat, base) == tree.value[tree.leaves(flat, base)]).all()


def test_fitted_trees_stay_in_the_shared_folder(spark):
    rows = [(k, float(k % 17), float(k * k % 101)) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    fitted = iforest.fit_isolation_forest(df, ["a", "b"], ["id"], trees=6, max_samples=128)
    assert fitted.stored.columns == ["tree", "rows", "feature", "value"] and fitted.stored.count() == 6
    nodes = fitted.nodes
    for tree, part in nodes.groupby("tree"):  # the children that a sample's rows went to
        left = part["left"].to_numpy()
        inner = part["feature"].to_numpy() >= 0
        assert sorted([0, *left[inner], *left[inner] + 1]) == list(range(len(part)))
    found = fitted.score(df).select("AnomalyScore").count()
    assert found == 400 and "trees" not in vars(fitted)


def test_forest_is_broadcast_once_for_calibration_and_scoring(spark):
    df = spark.createDataFrame([(k, float(k % 17)) for k in range(300)], "id long, a double")
    fitted = iforest.fit_isolation_forest(df, ["a"], ["id"], trees=4, max_samples=64)
    iforest.calibrate(fitted, df, 0.05)
    shared = fitted.shared
    fitted.score(df)
    assert shared is not None and fitted.shared is shared
