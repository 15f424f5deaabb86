import heapq

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sinew.operators import evaluate as EV
from sinew.operators import models as M
from sinew.operators import split as SP
from sinew.plans import workflows as WF


@settings(max_examples=100, deadline=None)
@given(sizes=st.lists(st.integers(1, 12), min_size=1, max_size=60), folds=st.integers(1, 6))
def test_counting_equals_the_greedy_assignment(sizes, folds):
    sizes = sorted(sizes, reverse=True)
    heap = [(0, f) for f in range(folds)]
    want = []
    for s in sizes:
        load, f = heapq.heappop(heap)
        want.append(f)
        heapq.heappush(heap, (load + s, f))
    got, loads = [], np.zeros(folds, dtype=np.int64)
    for s in sorted(set(sizes), reverse=True):
        count = sizes.count(s)
        got += SP.fold_of(np.arange(count), loads, s).tolist()
        loads = SP.loads_after(count, loads, s)
    assert got == want
    assert sorted(loads.tolist()) == sorted(load for load, _ in heap)


def features(spark, n=300, d=12, classes=3, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + 2.0 * rng.normal(size=(classes, d))[y] + 50
    x[:, -1] = 150 * x[:, 0]
    rows = [(i % 3, i, i // 10, f"c{y[i]}", x[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "session_id long, k long, trial_id long, label string, f array<double>")
    return x, y, df


def rowwise_lda(x, y):
    """The usual fit on rows: two singular value decompositions."""
    classes = np.unique(y)
    means = np.stack([x[y == c].mean(axis=0) for c in classes])
    priors = np.array([(y == c).mean() for c in classes])
    centre = priors @ means
    within = np.concatenate([x[y == c] - m for c, m in zip(classes, means)])
    std = within.std(axis=0)
    _, s, vt = np.linalg.svd(within / std / np.sqrt(len(x) - len(classes)), full_matrices=False)
    rank = (s > 1e-4).sum()
    scalings = (vt[:rank] / std).T / s[:rank]
    between = (np.sqrt(len(x) * priors / (len(classes) - 1))[:, None] * (means - centre)) @ scalings
    _, s, vt = np.linalg.svd(between, full_matrices=False)
    scalings = scalings @ vt.T[:, : (s > 1e-4 * s[0]).sum()]
    coef = (means - centre) @ scalings
    intercept = -0.5 * (coef**2).sum(axis=1) + np.log(priors)
    weights = coef @ scalings.T
    return weights, intercept - centre @ weights.T


def test_lda_from_statistics_equals_rows_despite_singular_pair(spark):
    x, y, df = features(spark)
    model = M.fit_lda(M.by_class(M.class_moments(df.repartition(7))))
    weights, intercepts = rowwise_lda(x, y)
    want = M.softmax(x @ weights.T + intercepts)
    np.testing.assert_allclose(model.probabilities(x), want, atol=1e-8)


def test_qda_from_statistics_equals_rows(spark):
    x, y, df = features(spark)
    model = M.fit_qda(M.by_class(M.class_moments(df)))
    scores = []
    for c in range(3):
        z = x[y == c]
        mean = z.mean(axis=0)
        _, s, vt = np.linalg.svd(z - mean, full_matrices=False)
        var = 0.9 * s**2 / (len(z) - 1) + 0.1
        d = (x - mean) @ vt.T
        scores.append(-0.5 * ((d**2 / var).sum(axis=1) + np.log(var).sum()) + np.log((y == c).mean()))
    np.testing.assert_allclose(model.scores(x), np.stack(scores, axis=1), rtol=1e-6)


def test_out_of_fold_equals_refitting(spark):
    x, y, df = features(spark)
    folds = SP.group_kfold(df).drop("n")
    rows = df.join(folds, "trial_id")
    held, classes = M.out_of_fold_proba(rows)
    fold = {r.k: r.fold for r in rows.select("k", "fold").collect()}
    at = np.array([fold[k] for k in range(len(x))])
    got = {r.k: r.p for r in held.collect()}
    for f in range(5):
        weights, intercepts = rowwise_lda(x[at != f], y[at != f])
        want = M.softmax(x[at == f] @ weights.T + intercepts)
        np.testing.assert_allclose([got[k] for k in np.flatnonzero(at == f)], want, atol=1e-7)
    assert classes == ("c0", "c1", "c2")


def test_folds_and_split_keep_trials_whole(spark):
    _, _, df = features(spark)
    folds = SP.group_kfold(df)
    assert folds.count() == 30 and folds.select("trial_id").distinct().count() == 30
    split = SP.group_shuffle_split(df)
    SP.check_disjoint(split)
    assert split.filter("split = 'test'").count() == 6
    with pytest.raises(ValueError):
        SP.check_disjoint(split.unionByName(split.selectExpr("trial_id", "'train' as split")))


def test_holdout_is_stable_under_repartitioning(spark):
    _, _, df = features(spark)
    a = {r.k for r in SP.shuffle_holdout(df).filter("holdout").collect()}
    b = {r.k for r in SP.shuffle_holdout(df.repartition(13)).filter("holdout").collect()}
    assert a == b and 10 < len(a) < 60


def test_ensemble_and_specialist_scores(spark):
    x, y, df = features(spark)
    rows = df.join(SP.group_kfold(df).drop("n"), "trial_id")
    blocks = {"a": [0, 1, 2, 3], "b": [4, 5, 6, 7], "c": [8, 9, 10]}
    ensemble = M.fit_ensemble(rows, columns=blocks)
    p = ensemble.probabilities(x)
    assert p.shape == (300, 3) and np.allclose(p.sum(axis=1), 1)
    table = {r.model: r.mean for r in M.specialist_cv(rows, columns=blocks).collect()}
    assert set(table) == {"a", "b", "c", "meta"} and table["meta"] >= max(table["a"], table["b"], table["c"]) - 0.1


def test_specialist_columns():
    sizes = {n: len(c) for n, c in M.specialist_columns().items()}
    assert sizes == {"td": 36, "fd": 24, "cc": 9}
    assert sorted(sum(M.specialist_columns().values(), [])) == list(range(69))


def test_report_of_perfect_guesses(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b"), ("b", "b")], "label string, predicted string")
    report = {r.label: (r.precision, r.recall, r.support) for r in EV.classification_report(df).collect()}
    assert report["weighted avg"] == (1.0, 1.0, 3) and report["a"] == (1.0, 1.0, 1)


def test_fold_normalised_uses_other_folds_only(spark):
    x, y, df = features(spark)
    rows = df.join(SP.group_kfold(df).drop("n"), "trial_id")
    got = {(r.session_id, r.k): r.f for r in WF.fold_normalised(rows).collect()}
    pdf = rows.toPandas()
    one = pdf.iloc[0]
    others = pdf[(pdf["session_id"] == one["session_id"]) & (pdf["fold"] != one["fold"])]
    z = np.stack(others["f"].to_numpy())
    mu = np.mean([z[(others["label"] == c).to_numpy()].mean(axis=0) for c in sorted(others["label"].unique())], axis=0)
    want = (np.array(one["f"]) - mu) / (z.std(axis=0) + 1e-8)
    np.testing.assert_allclose(got[(one["session_id"], one["k"])], want, rtol=1e-6)


def test_dense_net_round_trip(spark):
    rng = np.random.default_rng(0)
    net = M.DenseNet(("a", "b"), [rng.normal(size=(4, 3)), rng.normal(size=(3, 2))], [rng.normal(size=3), rng.normal(size=2)])
    back = M.DenseNet.from_table(net.table(spark), ("a", "b"))
    x = rng.normal(size=(5, 4))
    np.testing.assert_allclose(net.probabilities(x), back.probabilities(x))
