"""Trees grown whole in a task: cuts as by brute force, few jobs, and alike to forests that Spark grows."""

import numpy as np

from cadenza.operators import forest, models
from cadenza.plans import catalog


def _gini(y, w, c):
    counts = np.bincount(y, w, c)
    return (counts**2).sum() / counts.sum()


def test_cuts_are_those_of_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = int(rng.integers(2, 60))
        x, y, w = rng.integers(0, 12, (n, 1)) / 4.0, rng.integers(0, 3, n), rng.poisson(1.0, n)
        w[0] = 1
        tree = forest.grow(x, forest.ranks(x), y, w, 3, 30, rng)
        node = {0: w > 0}
        for k in range(len(tree.feature)):
            at, v = node[k], x[:, 0]
            values = np.unique(v[at])
            whole = _gini(y[at], w[at], 3)
            scores = [_gini(y[at & (v <= t)], w[at & (v <= t)], 3) + _gini(y[at & (v > t)], w[at & (v > t)], 3) for t in values[:-1]]
            assert np.allclose(tree.shares[k], np.bincount(y[at], w[at], 3) / w[at].sum())
            if tree.feature[k] < 0:
                assert not scores or max(scores) <= whole * (1 + 1e-9)
                continue
            best = int(np.argmax(np.round(scores, 9)))
            assert tree.most[k] == (values[best] + values[best + 1]) / 2
            node[int(tree.child[k])], node[int(tree.child[k]) + 1] = at & (v <= tree.most[k]), at & (v > tree.most[k])


def test_trees_without_noise_know_their_rows_and_stop_at_their_depth():
    rng = np.random.default_rng(6)
    x, y = rng.standard_normal((700, 30)), rng.integers(0, 4, 700)
    for side in (1, 1 << 16):
        forest.SIDE_ROWS = side
        tree = forest.grow(x, forest.ranks(x), y, np.ones(700, int), 4, 30, np.random.default_rng(1))
        assert (forest.shares(tree, x).argmax(axis=1) == y).all() and tree.shares.max(axis=1).min() < 1
    assert len(forest.grow(x, forest.ranks(x), y, np.ones(700, int), 4, 2, rng).feature) == 7
    odd = np.array([[-np.inf], [0.0], [np.inf], [np.nextafter(0, 1)]])
    assert (forest.shares(forest.grow(odd, forest.ranks(odd), np.arange(4), np.ones(4, int), 4, 30, rng), odd).argmax(axis=1) == range(4)).all()


def _table(spark, n):
    rng = np.random.default_rng(14)
    rows = [(k, "abc"[k % 3], *(rng.standard_normal(4) + (k % 3)).tolist()) for k in range(n)]
    return spark.createDataFrame(rows, "piece_id long, era string, w double, x double, y double, z double")


def test_a_forest_takes_few_jobs(spark):
    spark.sparkContext.setJobGroup("forest", "forest")
    try:
        got = models.classify(_table(spark, 400), ["w", "x", "y", "z"], "era", folds=5, trees=20, depth=30).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sum(r["n"] for r in got) == 400
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest")) < 25  # 118 where each level of the trees is a job


def test_larger_tables_are_judged_alike(spark, monkeypatch):
    df, right = _table(spark, 300), []
    for cells in (models.FOREST_CELLS, 0):
        monkeypatch.setattr(models, "FOREST_CELLS", cells)
        got = models.classify(df, ["w", "x", "y", "z"], "era", folds=3, trees=30, depth=30).collect()
        assert sum(r["n"] for r in got) == 300
        right.append(sum(r["n"] for r in got if r["label"] == r["predicted"]))
    assert abs(right[0] - right[1]) <= 15 and min(right) > 200


def test_a_row_without_others_to_learn_from_is_not_given_a_class(spark):
    df = spark.createDataFrame([(1, "a", float(k)) for k in range(9)], "piece_id long, era string, x double")
    assert [tuple(r) for r in models.classify(df, ["x"], "era", trees=3).collect()] == [("a", None, 9)]


def test_vectors_are_judged_whole_in_few_jobs(spark, sf_dir):
    spark.sparkContext.setJobGroup("vectors", "vectors")
    try:
        got = catalog.QUERIES["vector_classification"](spark, sf_dir).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sum(r["n"] for r in got) == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("vectors")) < 25
