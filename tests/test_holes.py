"""Recordings with lost samples and rows: results must not depend on chunks and go on behind a hole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import hysteresis, probabilities, proba_frame, samples
from sinew.functions import signal
from sinew.operators import filters as FI
from sinew.operators import labels as L
from sinew.operators import smooth as SM
from sinew.operators import windows as W

KEPT = [k for k in range(120) if k not in (7, 8) and k % 13 != 5]


def labelled(spark):
    rows = [(0, k, k * 0.025, k * 0.025 + 0.15, "rest" if (k // 9) % 2 else "fist") for k in KEPT]
    return spark.createDataFrame(rows, "session_id long, k long, start_time double, end_time double, label string"), rows


@pytest.mark.parametrize("size", [8, 64, 4096])
def test_runs_and_changes(spark, size):
    df, rows = labelled(spark)
    changes = [(b[1], a[4], b[4]) for a, b in zip(rows, rows[1:]) if a[4] != b[4]]
    got = L.label_transitions(df, size=size).orderBy("k").collect()
    assert [(r.k, r.from_label, r.label) for r in got] == changes
    runs = L.with_runs(df, size=size).orderBy("k").collect()
    assert [r.run for r in runs] == np.cumsum([0] + [a[4] != b[4] for a, b in zip(rows, rows[1:])]).tolist()


@pytest.mark.parametrize("size", [8, 64, 4096])
def test_smoothing_counts_rows(spark, size):
    p = probabilities(len(KEPT), 4)
    want = hysteresis(p)
    rows = spark.createDataFrame([(0, k, v.tolist()) for k, v in zip(KEPT, p)], "session_id long, k long, p array<double>")
    out = SM.smooth_hysteresis(rows, 4, size=size)
    assert [r.output for r in out.orderBy("k").collect()] == want
    events = [r.k for r in SM.prediction_events(out, size=size).orderBy("k").collect()]
    assert events == [k for k, a, b in zip(KEPT, [-1, *want], want) if b != -1 and a != b]
    dense = SM.smooth_hysteresis(proba_frame(spark, {0: p}), 4)
    assert [r.conf for r in dense.orderBy("k").collect()] == pytest.approx([r.conf for r in out.orderBy("k").collect()])


@pytest.mark.parametrize("size", [1200, 4096])
def test_filters_restart(spark, size):
    df, frame = samples(spark, 3000)
    lost = (frame.i % 700 > 650) | (frame.i == 1200)
    broken = df.filter("NOT (i % 700 > 650 OR i = 1200)")
    got = FI.bandpass_stream(broken, ["ch0"], size=size).orderBy("i").toPandas()
    high = FI.zero_phase(broken, "high", ["ch0"], size=size).orderBy("i").toPandas()
    response = signal.impulse_response(*signal.BANDPASS, signal.BANDPASS_TAPS)
    kept = frame[~lost]
    cuts = np.flatnonzero(np.diff(kept.i) != 1) + 1
    parts = np.split(kept.ch0.to_numpy()[:, None], cuts)
    np.testing.assert_allclose(got.ch0, np.concatenate([signal.convolve_causal(x, response) for x in parts])[:, 0], atol=1e-6)
    whole = np.concatenate([signal.zero_phase(x, signal.HIGHPASS_20, FI.HALO, 9, True, True) for x in parts])
    np.testing.assert_allclose(high.ch0, whole[:, 0], atol=1e-5)


def test_frames_do_not_depend_on_chunks(spark):
    df, _ = samples(spark, 2500)
    broken = df.filter("i % 300 < 280")
    a, b = (FI.moving_rms(broken, ["ch0"], size=s).orderBy("i").toPandas().ch0 for s in (200, 16384))
    np.testing.assert_allclose(a, b)


def test_every_sample_of_a_window_comes_back(spark):
    df, frame = samples(spark, 1500)
    windows = W.sliding_windows(df.filter("i <> 700"))
    back = W.reconstruct_signal(windows).select("i", "ch0").orderBy("i").toPandas()
    k = np.array(sorted(r.k for r in windows.select("k").collect()))
    held = sorted({i for w in k for i in range(25 * w, 25 * w + 150)})
    assert back.i.tolist() == held
    np.testing.assert_allclose(back.ch0, frame.ch0.to_numpy()[held])


def test_shared_folder_is_asked_for(spark, monkeypatch):
    from types import SimpleNamespace

    from sinew import session

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="yarn", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    fake = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(RuntimeError):
        session.checkpoint_folder(fake)


def test_histogram_of_nothing(spark):
    from sinew.operators.evaluate import histogram

    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 2.0)], "g string, v double")
    assert sorted(tuple(r) for r in histogram(rows, "v", 4, ["g"]).collect()) == [("a", 0, 1), ("a", 3, 1), ("b", 3, 1)]
    assert histogram(rows.filter(F.lit(False)), "v", 4, ["g"]).count() == 0
