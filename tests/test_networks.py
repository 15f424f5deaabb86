"""Networks trained on the cluster against a plain run over all rows at once."""

import numpy as np
from pyspark.sql import functions as F

from sinew.operators import models as M
from sinew.operators import networks as N

CLASSES = ("a", "b", "c")


def blobs(spark, n=300, width=6, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = rng.normal(0, 1, (n, width)) + 2.0 * np.eye(width)[y]
    rows = [(0, k, CLASSES[c], int(k % 4), v.tolist()) for k, (c, v) in enumerate(zip(y, x))]
    return x, y, spark.createDataFrame(rows, "session_id long, k long, label string, fold int, f array<double>")


def plain_run(x, y, h, sizes, epochs, batches, rate, dropout, seed):
    """ReLU, ReLU, softmax by hand: mini-batches by hash, inverted dropout after the first layer, Adam."""
    rng = np.random.default_rng(seed)
    params = []
    for a, b in zip(sizes[:-1], sizes[1:]):
        edge = np.sqrt(6 / (a + b))
        params += [rng.uniform(-edge, edge, (a, b)), np.zeros(b)]
    m, v, t = [0 * p for p in params], [0 * p for p in params], 0
    part = h % batches
    for epoch in range(epochs):
        for b in np.random.default_rng([seed, epoch]).permutation(batches):
            own = part == b
            w1, b1, w2, b2, w3, b3 = params
            drop = (N.uniforms(h[own], len(b1), seed, t) >= dropout) / (1 - dropout)
            h1 = np.maximum(x[own] @ w1 + b1, 0) * drop
            h2 = np.maximum(h1 @ w2 + b2, 0)
            e = np.exp(h2 @ w3 + b3)
            d3 = e / e.sum(axis=1, keepdims=True) - np.eye(3)[y[own]]
            d2 = d3 @ w3.T * (h2 > 0)
            d1 = d2 @ w2.T * (h1 > 0) * drop
            n, t = own.sum(), t + 1
            grads = [g / n for g in (x[own].T @ d1, d1.sum(0), h1.T @ d2, d2.sum(0), h2.T @ d3, d3.sum(0))]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g**2
                params[i] = params[i] - rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m[i] / (np.sqrt(v[i]) + 1e-7)
    return params


def test_perceptron_equals_a_plain_run(spark):
    x, y, df = blobs(spark)
    h = np.array([r[0] for r in df.select(F.xxhash64("session_id", "k", F.lit(42))).collect()])
    for parts in (1, 5):
        net = N.fit_perceptron(df.repartition(parts), CLASSES, (8, 5), epochs=6, batch=100, rate=1e-2)
        want = plain_run(x, y, h, (6, 8, 5, 3), 6, 3, 1e-2, 0.2, 42)
        for got, p in zip([a for pair in zip(net.weights, net.biases) for a in pair], want):
            np.testing.assert_allclose(got, p, atol=1e-6)


def test_folds_of_one_run_equal_separate_runs(spark):
    """Held-out rows do not reach their fold's model, whatever other models the steps train."""
    _, _, df = blobs(spark)
    kinds = {"mlp": N.Perceptron((8,), 0.0, 1e-2), "svm_rbf": N.KernelMachine(32)}
    joint = N.fit_networks(df, CLASSES, kinds, folds=4, epochs=8, batch=128, scaled=False)
    changed = df.withColumn("f", F.when(F.col("fold") == 2, F.transform("f", lambda v: v * -50)).otherwise(F.col("f")))
    other = N.fit_networks(changed, CLASSES, kinds, folds=4, epochs=8, batch=128, scaled=False, whole=False)
    for kind in kinds:
        for a, b in zip(joint[kind, 2].weights, other[kind, 2].weights):
            np.testing.assert_allclose(a, b, atol=1e-9)
        assert not np.allclose(joint[kind, 1].weights[0], other[kind, 1].weights[0])


def test_scaling_is_the_training_folds(spark):
    x, _, df = blobs(spark, 80)
    shifted = df.withColumn("f", F.transform("f", lambda v: v * 3 + 1e6))
    scales = N._scalings(shifted.select("fold", "f"), 4)
    fold = np.arange(80) % 4
    for held in range(4):
        own = x[fold != held] * 3 + 1e6
        np.testing.assert_allclose(scales[held + 1][0], own.mean(axis=0), rtol=1e-12)
        np.testing.assert_allclose(scales[held + 1][1], own.std(axis=0), rtol=1e-6)


def test_benchmark_beats_chance_on_every_model(spark):
    _, _, df = blobs(spark, 400)
    wide = df.withColumn("f", F.concat("f", F.transform("f", lambda v: v * v)))
    scores = {(r.features, r.model): r["mean"] for r in N.classifier_benchmark({"base": df, "wide": wide}, CLASSES, 4, epochs=40, batch=512).collect()}
    assert len(scores) == 8 and min(scores.values()) > 0.75


def test_rows_without_known_label_are_left_out(spark):
    _, _, df = blobs(spark, 60)
    more = df.unionByName(df.withColumn("label", F.lit("other"))).unionByName(df.withColumn("label", F.lit(None).cast("string")))
    a, b = (N.fit_perceptron(d, CLASSES, (4,), epochs=2, batch=64) for d in (df, more))
    np.testing.assert_allclose(a.weights[0], b.weights[0], atol=1e-12)
    assert M.score(df, a, ["k"]).count() == 60


def test_epochs_are_the_jobs_and_shards_learn_side_by_side(spark, monkeypatch):
    """Many mini-batches in many shards: jobs follow the epochs, not the mini-batches, and what is learnt holds."""
    x, y, df = blobs(spark, 1200)
    monkeypatch.setattr(N, "SHARD_ROWS", 128)
    tracker, group = spark.sparkContext.statusTracker(), "shards"
    spark.sparkContext.setJobGroup(group, group)
    try:
        nets = [N.fit_networks(d, CLASSES, {"mlp": N.Perceptron((8,), 0.0, 1e-2)}, epochs=8, batch=16)["mlp", None] for d in (df, df.repartition(5))]
        jobs = len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 2 * 75  # 75 mini-batches an epoch
    for a, b in zip(nets[0].weights, nets[1].weights):
        np.testing.assert_allclose(a, b, atol=1e-6)
    assert (nets[0].probabilities(x).argmax(axis=1) == y).mean() > 0.8


def test_random_directions_are_drawn_once(monkeypatch):
    """The cosine features' directions are the same in every step, so steps do not draw them again."""
    draws, rng = [], np.random.default_rng
    monkeypatch.setattr(np.random, "default_rng", lambda *a: draws.append(a) or rng(*a))
    kind, x = N.KernelMachine(19), rng(1).normal(0, 1, (50, 7))
    for step in range(5):
        kind.gradients(kind.start(7, 3, 0), x, np.arange(50) % 3, np.arange(50), step, 0)
    assert len(draws) == 1


def test_single_precision_gradients_are_close():
    rng = np.random.default_rng(2)
    x, y = rng.normal(0, 1, (400, 20)), rng.integers(0, 3, 400)
    weights = [rng.normal(0, 0.1, (256, 3)), rng.normal(0, 0.1, 3)]
    a, b = (N.KernelMachine(single=s).gradients(weights, x, y, np.arange(400), 0, 0)[0] for s in (False, True))
    for u, v in zip(a, b):
        np.testing.assert_allclose(u, v, atol=1e-3)


def test_mini_batches_are_packed_rows(spark):
    """One row for each mini-batch, with its rows in order, however the rows come in batches."""
    x, y, df = blobs(spark, 90)
    rows = df.selectExpr("cast(k % 4 as int) AS part", "cast(k % 2 as int) AS shard", "cast(k % 3 as int) AS y", "fold", "k AS h", "f")
    placed = rows.repartitionById(2, F.col("shard")).sortWithinPartitions("shard", "part", "h")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        packed = placed.mapInArrow(N._packed, N.PACKED).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(r["part"] for r in packed) == [0, 1, 2, 3]
    for r in packed:
        k = np.arange(r["part"], 90, 4)
        assert r["shard"] == r["part"] % 2 and np.frombuffer(r["h"], np.int64).tolist() == k.tolist()
        assert np.frombuffer(r["y"], np.int32).tolist() == (k % 3).tolist() and np.frombuffer(r["fold"], np.int32).tolist() == (k % 4).tolist()
        np.testing.assert_array_equal(np.frombuffer(r["x"]).reshape(len(k), -1), x[k])


def test_tasks_hold_whole_shards(spark, monkeypatch):
    """More shards than tasks give the states of a task for each shard: partitioning changes the rounding of sums only."""
    _, _, df = blobs(spark, 600)
    monkeypatch.setattr(N, "SHARD_ROWS", 32)
    fitted = []
    for per_core in (1, 50):
        monkeypatch.setattr(N, "TASKS_PER_CORE", per_core)
        fitted.append(N.fit_networks(df, CLASSES, {"mlp": N.Perceptron((5,), 0.0, 1e-2)}, folds=2, epochs=3, batch=16, whole=False))
    for model in fitted[0]:
        for a, b in zip(fitted[0][model].weights, fitted[1][model].weights):
            np.testing.assert_allclose(a, b, atol=1e-9)
