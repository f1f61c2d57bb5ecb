"""The tree learner against a plain recursive one, hand-computed gains, and its own serial form."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from harvestry.operators import trees as T
from harvestry.session import shared_path


def table(spark, X, y, folds=5):
    schema = StructType([StructField("features", VectorUDT()), StructField("label", DoubleType()), StructField("f", IntegerType())])
    return spark.createDataFrame([(Vectors.dense(a.tolist()), float(b), i % folds) for i, (a, b) in enumerate(zip(X, y))], schema).repartition(3)


def data(n=300, d=4, levels=12, seed=1):
    rng = np.random.default_rng(seed)
    X = rng.integers(0, levels, (n, d)).astype(float)
    return X, X[:, 0] * 2 + (X[:, 1] > 5) * X[:, 2] + rng.normal(size=n)


def plain_tree(X, r, growth):
    """Best-first regression tree by trying every cut of every node; returns a predictor and the leaves' (depth, rows)."""
    def best(rows):
        found = (1e-9, None)
        own = r[rows].sum() ** 2 / (len(rows) + growth.l2)
        for f in range(X.shape[1]):
            for cut in np.unique(X[rows, f])[:-1]:
                a = rows[X[rows, f] <= cut]
                b = rows[X[rows, f] > cut]
                if min(len(a), len(b)) >= max(growth.min_rows, growth.min_weight):
                    gain = r[a].sum() ** 2 / (len(a) + growth.l2) + r[b].sum() ** 2 / (len(b) + growth.l2) - own
                    if gain > found[0] + 1e-9:
                        found = (gain, (f, cut, a, b))
        return found
    leaves = [(np.arange(len(r)), 0, best(np.arange(len(r))))]
    while growth.leaves is None or len(leaves) < growth.leaves:
        open_ = [i for i, (_, d, (gain, s)) in enumerate(leaves) if s is not None and d < growth.depth]
        if not open_:
            break
        i = max(open_, key=lambda i: leaves[i][2][0])
        _, d, (_, (f, cut, a, b)) = leaves.pop(i)
        leaves += [(a, d + 1, best(a)), (b, d + 1, best(b))]
    out = np.zeros(len(r))
    for rows, _, _ in leaves:
        out[rows] = r[rows].sum() / (len(rows) + growth.l2)
    return out, sorted((d, len(rows)) for rows, d, _ in leaves)


def plain_boost(X, y, growth):
    score = np.full(len(y), y.mean())
    for _ in range(growth.trees):
        score = score + growth.rate * plain_tree(X, y - score, growth)[0]
    return score


POLICIES = {
    "level": T.Growth(trees=3, depth=3, rate=0.3),
    "level_l2": T.Growth(trees=3, depth=3, rate=0.3, l2=5.0, min_weight=4.0),
    "leafwise": T.Growth(trees=3, depth=6, rate=0.3, leaves=7, min_rows=5),
}


@pytest.mark.parametrize("name", sorted(POLICIES))
@pytest.mark.parametrize("local_rows", [1 << 16, 40])
def test_boosters_equal_brute_force(spark, name, local_rows):
    """Both with all nodes finished by one task and with most of them grown by histogram passes."""
    X, y = data()
    edges = T.bin_edges(table(spark, X, y), 4)
    blocks = T.write_blocks(table(spark, X, y), edges, F.col("f"), block_rows=64)
    growth = POLICIES[name]
    ((base, trees),), _ = T.fit_boosters(blocks, [T.Learner(growth)], 4, T.fold_totals(blocks), local_rows)
    model = T.TreeModel.of(trees, base, growth, edges)
    assert np.abs(model.predict_array(X) - plain_boost(X, y, growth)).max() < 1e-8


def test_policies_differ_and_leafwise_is_uneven(spark):
    X, y = data(2000, 6, 200, 3)
    blocks = T.write_blocks(table(spark, X, y), T.bin_edges(table(spark, X, y), 6))
    totals = T.fold_totals(blocks)
    growths = [T.Growth(trees=1, depth=8, rate=0.1, leaves=63, min_rows=20), T.Growth(trees=1, depth=8, rate=0.1, leaves=31, min_rows=20),
               T.Growth(trees=1, depth=6, rate=0.1, l2=1.0, min_weight=1.0)]
    fits, _ = T.fit_boosters(blocks, [T.Learner(g) for g in growths], 6, totals)
    leaves = [int((t.left < 0).sum()) for _, (t,) in fits]
    assert leaves[:2] == [63, 31] and leaves[2] <= 64
    tree = fits[0][1][0]
    depth = np.zeros(len(tree.left), int)
    for i, left in enumerate(tree.left):
        if left >= 0:
            depth[[left, left + 1]] = depth[i] + 1
    ends = depth[tree.left < 0]
    assert ends.min() < ends.max() <= 8


def test_gain_and_leaf_values_by_hand(spark):
    """Two groups of 2 and 3 rows around the mean 5: residuals -3, -3, 2, 2, 2 and L2 of 1."""
    X, y = np.array([[0.0], [0], [1], [1], [1]]), np.array([2.0, 2, 7, 7, 7])
    edges = T.bin_edges(table(spark, X, y), 1)
    blocks = T.write_blocks(table(spark, X, y), edges)
    growth = T.Growth(trees=1, depth=6, rate=0.5, l2=1.0)
    ((base, (tree,)),), _ = T.fit_boosters(blocks, [T.Learner(growth)], 1, T.fold_totals(blocks))
    assert base == 5.0 and abs(tree.gain[0] - (36 / 3 + 36 / 4 - 0)) < 1e-9
    assert np.allclose(tree.value[1:], [0.5 * -6 / 3, 0.5 * 6 / 4])


def test_cross_validation_equals_separate_fits(spark):
    """Folds that advance together give what fits on the other folds alone give."""
    X, y = data(400)
    edges = T.bin_edges(table(spark, X, y), 4)
    blocks = T.write_blocks(table(spark, X, y), edges, F.col("f"))
    growth = POLICIES["leafwise"]
    learners = [T.Learner(growth, k) for k in range(5)]
    fits, scored = T.fit_boosters(blocks, learners, 4, T.fold_totals(blocks), local_rows=50)
    errors = T.held_out_errors(scored, learners, 4)
    for k in range(5):
        out = np.arange(len(y)) % 5 == k
        alone = T.write_blocks(table(spark, X, y).filter(F.col("f") != k), edges)
        ((base, trees),), _ = T.fit_boosters(alone, [T.Learner(growth)], 4, T.fold_totals(alone))
        e = y[out] - T.TreeModel.of(trees, base, growth, edges).predict_array(X[out])
        assert abs(np.sqrt(np.mean(e * e)) - errors[k]) < 1e-8
        assert abs(fits[k][0] - base) < 1e-9


def test_forest_is_the_same_in_any_split_of_the_work(spark):
    X, y = data(500, 5, 60, 7)
    edges = T.bin_edges(table(spark, X, y), 5)
    blocks = T.write_blocks(table(spark, X, y), edges)
    growth = T.Growth(trees=12, depth=20, min_rows=5)
    one, many = (T.fit_forests(blocks, [T.Learner(growth)], 5, T.fold_totals(blocks), n)[0] for n in (1 << 16, 60))
    a, b = (T.TreeModel.of(t, 0.0, growth, edges) for t in (one, many))
    assert np.abs(a.predict_array(X) - b.predict_array(X)).max() < 1e-8
    r2 = 1 - np.sum((a.predict_array(X) - y) ** 2) / np.sum((y - y.mean()) ** 2)
    assert r2 > 0.9 and abs(a.importances.sum() - 1) < 1e-9 and a.importances[0] == a.importances.max()
    assert len({t.left.size for t in one}) > 1  # the bootstrap makes trees differ


def test_sorted_cells_equal_histograms(monkeypatch):
    """The form for many small nodes finds the splits that histograms find."""
    X, y = data(800, 5, 90, 9)
    x, w = X.T.astype(np.uint8), np.ones(800)
    growth = T.Growth(trees=1, depth=9, min_rows=2)
    by_hist = T.grow_subtree(x, w, y - y.mean(), growth, np.arange(5), 9)
    monkeypatch.setattr(T, "DENSE_NODES", 1)
    by_sort = T.grow_subtree(x, w, y - y.mean(), growth, np.arange(5), 9)
    for c in ("feature", "bin", "left"):
        assert (by_hist[c] == by_sort[c]).all()


def test_model_round_trip_and_columns(spark):
    X, y = data()
    df = table(spark, X, y)
    edges = T.bin_edges(df, 4)
    blocks = T.write_blocks(df, edges)
    growth = POLICIES["leafwise"]
    ((base, trees),), _ = T.fit_boosters(blocks, [T.Learner(growth)], 4, T.fold_totals(blocks))
    model = T.TreeModel.of(trees, base, growth, edges)
    path = shared_path(spark, "tree-model")
    model.save(spark, path)
    loaded = T.TreeModel.load(spark, path)
    rows = loaded.transform(df).collect()
    x = np.array([r.features.toArray() for r in rows])
    assert np.array_equal(model.predict_array(x), np.array([r.prediction for r in rows]))
    assert loaded.settings["leaves"] == "7" and np.array_equal(loaded.importances, model.importances)


def test_constant_label_and_one_row(spark):
    for X, y in ((np.ones((5, 2)), np.full(5, 3.0)), (np.array([[1.0, 2.0]]), np.array([4.0]))):
        edges = T.bin_edges(table(spark, X, y), 2)
        blocks = T.write_blocks(table(spark, X, y), edges)
        ((base, trees),), _ = T.fit_boosters(blocks, [T.Learner(POLICIES["level"])], 2, T.fold_totals(blocks))
        assert np.allclose(T.TreeModel.of(trees, base, POLICIES["level"], edges).predict_array(X), y)


def test_forest_error_on_the_fold_left_out(spark):
    X, y = data(300)
    edges = T.bin_edges(table(spark, X, y), 4)
    blocks = T.write_blocks(table(spark, X, y), edges, F.col("f"))
    growth = T.Growth(trees=5, depth=6, min_rows=5)
    learners = [T.Learner(growth, k) for k in (0, 3)]
    for learner, trees in zip(learners, T.fit_forests(blocks, learners, 4, T.fold_totals(blocks))):
        out = np.arange(len(y)) % 5 == learner.without
        e = y[out] - T.TreeModel.of(trees, 0.0, growth, edges).predict_array(X[out])
        assert abs(T.forest_error(blocks, learner, trees, 4) - np.sqrt(np.mean(e * e))) < 1e-9


def test_small_learners_need_few_jobs_and_no_fold_forest_is_collected(spark, monkeypatch):
    """Boosters on few rows and their folds take a job for all trees, the same as by passes; errors of fold forests without their trees."""
    X, y = data(2000, 5, 40, 11)
    edges = T.bin_edges(table(spark, X, y), 5)
    blocks = T.write_blocks(table(spark, X, y), edges, F.col("f"), block_rows=250)
    totals, sc = T.fold_totals(blocks), spark.sparkContext
    growths = [T.Growth(trees=9, depth=5, rate=0.3, leaves=9, min_rows=40, features=0.8), T.Growth(trees=7, depth=4, rate=0.3, l2=1.0, min_weight=40.0, rows=0.8)]
    learners = [T.Learner(g, k) for g in growths for k in (None, 0, 3)]
    sc.setJobGroup("alone", "")
    try:
        fits, scored = T.fit_boosters(blocks, learners, 5, totals)
        errors = T.held_out_errors(scored, learners, 5)
    finally:
        sc._jsc.sc().clearJobGroup()
    assert len(sc.statusTracker().getJobIdsForGroup("alone")) <= 6
    passes, scored = T.fit_boosters(blocks, learners, 5, totals, local_rows=10)
    for learner, (base, a), (other, b) in zip(learners, fits, passes):  # the same trees; their nodes may be numbered otherwise
        one, two = (T.TreeModel.of(t, m, learner.growth, edges) for t, m in ((a, base), (b, other)))
        assert [len(t.left) for t in a] == [len(t.left) for t in b] and np.abs(one.predict_array(X) - two.predict_array(X)).max() < 1e-8
    by_passes = T.held_out_errors(scored, learners, 5)
    assert sorted(errors) == sorted(by_passes) == [1, 2, 4, 5] and all(abs(errors[i] - by_passes[i]) < 1e-8 for i in errors)
    forests = [T.Learner(T.Growth(trees=5, depth=5, min_rows=40), k) for k in (0, 3, 9)]
    want = [T.forest_error(blocks, x, trees, 5) for x, trees in zip(forests, T.fit_forests(blocks, forests, 5, totals, 400))]
    monkeypatch.setattr(T, "forest_error", lambda *_: pytest.fail("a fold's forest on the driver"))
    found = T.forest_errors(blocks, forests, 5, totals)
    assert want[2] is None and sorted(found) == [0, 1] and all(abs(found[i] - want[i]) < 1e-8 for i in found)


def test_a_level_is_one_job_and_blocks_are_full(spark):
    """A booster's pass is one job without planning; blocks hold ``block_rows`` rows however the rows arrive."""
    X, y = data(3000)
    df = table(spark, X, y).repartition(1)
    blocks = T.write_blocks(df, T.bin_edges(df, 4), block_rows=1000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 300)
    try:
        odd = T.write_blocks(df, T.bin_edges(df, 4), block_rows=1000)
        assert sorted(len(r.y) // 8 for r in odd.collect()) == [1000, 1000, 1000]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    totals, sc, growth = T.fold_totals(blocks), spark.sparkContext, T.Growth(trees=6, depth=4, rate=0.3)
    sc.setJobGroup("boost", "")
    try:
        ((_, trees),), _ = T.fit_boosters(blocks, [T.Learner(growth)], 4, totals, local_rows=40)
    finally:
        sc._jsc.sc().clearJobGroup()
    assert max((t.left < 0).sum() for t in trees) > 8
    assert len(sc.statusTracker().getJobIdsForGroup("boost")) <= growth.trees * growth.depth + 4


def test_histograms_added_by_the_driver_or_shuffled(spark, monkeypatch):
    X, y = data(600, 5, 40, 11)
    blocks = T.write_blocks(table(spark, X, y), T.bin_edges(table(spark, X, y), 5), block_rows=100)
    totals, fits = T.fold_totals(blocks), []
    growths = [T.Growth(trees=2, depth=5, rate=0.3, leaves=9, min_rows=3), T.Growth(trees=2, depth=4, rate=0.3)]
    for most, nodes in ((1 << 30, 2048), (0, 2048), (0, 2), (8000, 2048)):  # the last goes from one form to the other
        monkeypatch.setattr(T, "DRIVER_BYTES", most)
        monkeypatch.setattr(T._portions, "__defaults__", (nodes,))
        fits.append(T.fit_boosters(blocks, [T.Learner(g) for g in growths], 5, totals, local_rows=10)[0])
    for other in fits[1:]:
        for (_, a), (_, b) in zip(fits[0], other):
            assert all(np.array_equal(s.left, t.left) and np.allclose(s.value, t.value) for s, t in zip(a, b))


def test_reachable_splits_are_those_of_best_first_growth():
    """Children may gain more than their parents; what is left out is never made."""
    rng, kept = np.random.default_rng(5), 0
    for _ in range(50):
        gains = rng.random(31)
        least = [np.inf] * 31
        for i in range(15):
            least[2 * i + 1] = least[2 * i + 2] = min(least[i], gains[i])
        queue, made = [0], set()
        while len(made) < 7:
            i = max(queue, key=lambda i: gains[i])
            queue.remove(i)
            made.add(i)
            queue += [c for c in (2 * i + 1, 2 * i + 2) if c < 31]
        may = T._reachable(gains, np.array(least), 8)
        assert made <= set(np.flatnonzero(may).tolist())
        kept += may.sum()
    assert kept < 0.8 * 50 * 31


def test_masks_give_the_scores_of_steps():
    """Trees of 1 to 64 leaves, cuts that rows hit exactly, infinite and missing values: the same bits as walking down."""
    rng, trees = np.random.default_rng(2), []
    for leaves in (1, 2, 31, 63, 64):
        left, feature, cut, ends = [-1], [0], [np.inf], [0]
        while len(ends) < leaves:
            i = ends.pop(rng.integers(len(ends)))
            left[i], feature[i], cut[i] = len(left), int(rng.integers(5)), float(rng.integers(-3, 4))
            ends += [len(left), len(left) + 1]
            left, feature, cut = left + [-1, -1], feature + [0, 0], cut + [np.inf, np.inf]
        trees.append((np.array(feature, np.int32), np.array(cut), np.array(left, np.int32), rng.normal(size=len(left))))
    model = T.TreeModel(trees, 0.5, False, np.zeros(5), {})
    x = rng.integers(-4, 5, (5000, 5)).astype(float)
    x[rng.random(x.shape) < 0.02] = np.nan
    x[rng.random(x.shape) < 0.02] = np.inf
    assert np.array_equal(model._predict_by_masks(x), model._predict_by_steps(x))
    assert np.array_equal(model.predict_array(x), model._predict_by_steps(x)) and model._masks is not None
    assert len(model.predict_array(x[:0])) == 0


def test_a_sample_smaller_than_the_limit_is_grown_too(spark):
    """The rows are more than one task finishes, the bootstrap's distinct rows are fewer."""
    X, y = data(500, 5, 60, 7)
    blocks = T.write_blocks(table(spark, X, y), T.bin_edges(table(spark, X, y), 5))
    growth = T.Growth(trees=4, depth=20, min_rows=5)
    a, b = (T.fit_forests(blocks, [T.Learner(growth)], 5, T.fold_totals(blocks), n)[0] for n in (400, 1000))
    assert min(len(t.left) for t in a) > 50
    assert all(np.array_equal(s.left, t.left) and np.allclose(s.value, t.value) for s, t in zip(a, b))


def test_a_large_forest_stays_off_the_driver(spark, monkeypatch, tmp_path):
    """No tree is collected for a model above the limit nor for errors by fold; its scores, importances and saved form are those
    of the trees in memory."""
    X, y = data(700, 5, 60, 13)
    df = table(spark, X, y)
    edges = T.bin_edges(df, 5)
    blocks = T.write_blocks(df, edges, T.F.col("label").cast("int") % 3, block_rows=100)
    growth, totals = T.Growth(trees=7, depth=12, min_rows=3), T.fold_totals(blocks)
    folds = [T.Learner(growth, k) for k in (0, 1)]
    trees = T.fit_forests(blocks, [T.Learner(growth), *folds], 5, totals, 150)
    held = T.TreeModel.of(trees[0], 0.0, growth, edges)
    errors = [T.forest_error(blocks, x, more, 5) for x, more in zip(folds, trees[1:])]
    monkeypatch.setattr(T, "DRIVER_NODES", 10)
    monkeypatch.setattr(T, "FOREST_ROWS", 64)
    monkeypatch.setattr(T.ForestFiles, "collected", lambda *_: pytest.fail("a large forest on the driver"))
    found = T.forest_errors(blocks, folds, 5, totals, 150)
    assert all(abs(found[i] - e) < 1e-9 for i, e in enumerate(errors))
    for local_rows in (150, 1 << 19):  # finished in portions, or each by a task that has all rows
        (files,) = T.grow_forests(blocks, [T.Learner(growth)], 5, totals, local_rows)
        model = T.forest_model(files, growth, edges)
        assert isinstance(model, T.StoredForest) and np.allclose(model.importances, held.importances, atol=1e-6)
        assert model.settings == held.settings
        got = {tuple(r.features): r.prediction for r in model.transform(df).select("features", "prediction").collect()}
        assert max(abs(got[tuple(x)] - p) for x, p in zip(X, held.predict_array(X))) < 1e-9
    model.save(spark, str(tmp_path / "model"))
    assert np.allclose(T.TreeModel.load(spark, str(tmp_path / "model")).predict_array(X), held.predict_array(X))


def test_trees_are_finished_a_few_at_a_time(spark, monkeypatch):
    """The rows of one portion are dropped before the next is sent."""
    X, y = data(600, 5, 60, 17)
    blocks = T.write_blocks(table(spark, X, y), T.bin_edges(table(spark, X, y), 5), block_rows=100)
    sent, finish, held = [], T.finish_nodes, spark._jsc.sc().env().mapOutputTracker()
    monkeypatch.setattr(T, "NODES_A_CORE", 0)
    monkeypatch.setattr(T, "finish_nodes", lambda *a: sent.append(held.shuffleStatuses().size()) or finish(*a))
    (files,) = T.grow_forests(blocks, [T.Learner(T.Growth(trees=6, depth=12, min_rows=3))], 5, T.fold_totals(blocks), 150)
    assert len(sent) == 6 and max(sent) <= sent[0] and len(files.nodes) == 6
