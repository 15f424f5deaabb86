import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import samples
from sinew.operators import augment as AU
from sinew.operators import windows as W
from sinew.plans import workflows as WF
from sinew.operators import models as M
from sinew.operators import split as SP
from sinew.sources import lines as LN
from sinew.sources import store


def recorded(spark):
    df, _ = samples(spark, 1600, 1500)
    windows = W.sliding_windows(df)
    part = F.floor(F.col("k") / 15)
    label = F.when(part % 2 == 0, "rest").otherwise("fist")
    labels = windows.select("session_id", "k", label.alias("label"), part.cast("int").alias("trial_id"))
    sessions = spark.createDataFrame([(0, "u", 1000), (1, "v", 1000)], "session_id long, user_id string, sampling_rate int")
    return df, windows, labels, sessions


def test_session_round_trip(spark, tmp_path):
    df, windows, labels, sessions = recorded(spark)
    path = str(tmp_path / "store")
    store.write_session(path, sessions, windows, labels, df)
    assert [r.session_id for r in store.list_sessions(spark, path).collect()] == [0, 1]
    info = {r.session_id: (r.num_windows, r.window_samples) for r in store.session_info(spark, path).collect()}
    assert info == {0: (59, 150), 1: (55, 150)}
    back = store.read_session(spark, path, 1)
    assert back.count() == 55 and back.filter("label <> label_original").count() == 0
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "PushedFilters: [IsNotNull(session_id), EqualTo(session_id,1)]" in plan
    training = store.read_all_training(spark, path)
    assert 0 < training.count() < 114
    trials = training.groupBy("trial_id").agg(F.count_distinct("session_id").alias("n"))
    assert trials.filter("n > 1").count() == 0
    one = store.read_training(spark, path, 0)
    assert {r.label_id for r in one.select("label_id").distinct().collect()} == {0, 1}


def test_lengths_are_checked(spark, tmp_path):
    _, windows, labels, sessions = recorded(spark)
    with pytest.raises(ValueError):
        store.write_session(str(tmp_path / "a"), sessions, windows, labels.filter("k > 0"))
    with pytest.raises(ValueError):
        store.write_session(str(tmp_path / "b"), sessions, windows.filter("k < 0"), labels.filter("k < 0"))


def test_other_shapes_are_left_out(spark):
    _, windows, labels, _ = recorded(spark)
    short = windows.filter("session_id = 1").withColumn("x", F.transform("x", lambda c: F.slice(c, 1, 100)))
    mixed = windows.filter("session_id = 0").unionByName(short).join(labels, ["session_id", "k"])
    assert {r.session_id for r in store.combine_training(mixed).select("session_id").distinct().collect()} == {0}


def test_training_job(spark):
    _, windows, labels, _ = recorded(spark)
    rows = windows.join(labels, ["session_id", "k"])
    trained = WF.train_models(WF.training_matrix(rows), folds=3)
    assert trained.lda.classes == ("fist", "rest") and trained.accuracy.count() == 3
    assert trained.ensemble.meta.weights.shape == (2, 6)


def test_one_matrix_gives_what_separate_fits_give(spark):
    """Discriminant, specialists, ensemble and accuracies of the shared passes equal those of trainers that read the matrix by themselves."""
    _, windows, labels, _ = recorded(spark)
    matrix = WF.training_matrix(windows.join(labels, ["session_id", "k"]), multiplier=2)
    trained = WF.train_models(matrix, folds=3)
    folds = SP.group_kfold(matrix.filter("is_real"), ["session_id", "trial_id"], 3).drop("n")
    rows = matrix.join(folds, ["session_id", "trial_id"])
    alone = M.fit_ensemble(rows)
    np.testing.assert_allclose(trained.lda.weights, M.fit_lda(M.by_class(M.class_moments(matrix))).weights, rtol=1e-6, atol=1e-8)
    for name, model in alone.specialists.items():
        np.testing.assert_allclose(trained.ensemble.specialists[name].weights, model.weights, rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(trained.ensemble.meta.weights, alone.meta.weights, rtol=1e-5, atol=1e-7)
    want = {r.fold: (r.n, r.accuracy) for r in M.cross_val_accuracy(rows).collect()}
    assert {r.fold: (r.n, r.accuracy) for r in trained.accuracy.collect()} == want
    assert {r["model"] for r in trained.scores.collect()} == {"td", "fd", "cc", "lda", "meta"}


def test_models_round_trip(spark, tmp_path):
    path = str(tmp_path)
    model = M.LinearModel(("a", "b"), np.eye(2, 5), np.array([0.5, -0.5]))
    store.save_model(spark, path, "first", model.table(spark, "first"), {"reinhard": True})
    store.save_model(spark, path, "my_ensemble", model.table(spark, "e"), {})
    store.save_model(spark, path, "second", model.table(spark, "second"), {})
    assert {r.name for r in store.list_models(spark, path).collect()} == {"first", "second"}
    assert store.latest_model(spark, path) == "second"
    rows, settings = store.load_model(spark, path, "first")
    assert settings["reinhard"] is True and settings["expanded"] is False and settings["channels"] == [0, 1, 2]
    np.testing.assert_array_equal(M.LinearModel.from_table(rows, "first").weights, model.weights)
    assert store.complete_settings({}, 69) == {
        "reinhard": False, "bandpass": False, "normalize": True, "channels": [0, 1, 2], "expanded": True, "cross_channel": True,
    }


def test_sample_lines(spark, tmp_path):
    text = ["2301,2288,2310,2295", " 1.5,2,-3,4e1 ", "1,2,3", "1,2,3,nan", "", '{"status":"x"}', "1,2,3,1f", "1,2,3,4,5", "1,2,3, 7"]
    (tmp_path / "log.txt").write_text("\n".join(text))
    rows = LN.parse_samples(LN.read_lines(spark, str(tmp_path))).collect()
    assert sorted(tuple(r) for r in rows) == [(1.0, 2.0, 3.0, 7.0), (1.5, 2.0, -3.0, 40.0), (2301.0, 2288.0, 2310.0, 2295.0)]
    assert LN.skip_telemetry(LN.read_lines(spark, str(tmp_path))).count() == 7


def test_command_lines(spark):
    text = ['{"cmd": "connect"}', '{"cmd":start_predict', '{"cmd" : "starting"}', '{"x": 1}', '{"cmd": "stopper"}', '{"cmd": "restart"}', '"cmd"']
    got = [r.cmd for r in LN.parse_commands(spark.createDataFrame([(t,) for t in text], "line string")).collect()]
    assert got == ["connect", "start_predict", "start", None, "stop", None, None]
    console = spark.createDataFrame([('{"gesture": "hook-em"}',), ('{"gesture":"HOOK_EM"}',)], "line string")
    assert [r.gesture for r in LN.parse_gesture_commands(console, "console").collect()] == ["hook_em", "none"]
    assert [r.gesture for r in LN.parse_gesture_commands(console).collect()] == ["none", "hook_em"]


def test_predictions_can_be_written_and_read(spark):
    rows = spark.createDataFrame([("fist", 0.93, 5120)], "gesture string, conf double, t_ms long")
    got = LN.parse_predictions(LN.format_predictions(rows)).first()
    assert (got.gesture, got.conf, got.t_ms, got.kind) == ("fist", 0.93, 5120, "prediction")


def test_augmentation(spark):
    df, _ = samples(spark, 400)
    windows = W.sliding_windows(df)
    a = {(r.k, r["copy"]): r.x for r in AU.augment(windows).collect()}
    b = {(r.k, r["copy"]): r.x for r in AU.augment(windows.repartition(5)).collect()}
    assert a == b and len(a) == 3 * windows.count()
    original = {r.k: r.x for r in windows.collect()}
    assert all(a[(k, 0)] == x for k, x in original.items())
    ratio = np.array(a[(0, 1)]).mean() / np.array(original[0]).mean()
    assert 0.75 < ratio < 1.25 and a[(0, 1)] != a[(0, 2)]
