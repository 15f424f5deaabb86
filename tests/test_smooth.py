import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import hysteresis, proba_frame, probabilities, vote_debounce
from sinew.operators import smooth as SM


def tracks(seed):
    return {s: probabilities(n, seed * 10 + s) for s, n in enumerate((1, 40, 260))}


def outputs(df):
    got = {}
    for r in df.orderBy("session_id", "k").collect():
        got.setdefault(r.session_id, []).append(r.output)
    return got


@pytest.mark.parametrize("size", [8, 4096])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hysteresis_equals_stepping(spark, size, seed):
    p = tracks(seed)
    got = outputs(SM.smooth_hysteresis(proba_frame(spark, p), 4, size=size))
    assert got == {s: hysteresis(x) for s, x in p.items()}


@pytest.mark.parametrize("size,debounce,reject", [(16, 3, 0.4), (4096, 3, 0.4), (16, 1, 0.4), (16, 3, 0.0), (64, 4, 0.5)])
def test_vote_debounce_equals_stepping(spark, size, debounce, reject):
    p = tracks(5)
    got = outputs(SM.smooth_vote_debounce(proba_frame(spark, p), 4, reject=reject, debounce=debounce, size=size))
    assert got == {s: vote_debounce(x, reject=reject, debounce=debounce) for s, x in p.items()}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keep=st.floats(0.05, 0.95), n=st.integers(1, 900))
def test_average_equals_recurrence(spark, keep, n):
    p = probabilities(n, n)
    got = np.array([r.s for r in SM.ema(proba_frame(spark, {0: p}), 4, keep).orderBy("k").collect()])
    s, want = np.full(4, 0.25), []
    for row in p:
        s = keep * s + (1 - keep) * row
        want.append(s)
    np.testing.assert_allclose(got, np.array(want), atol=1e-12)


def test_enter_below_hold_is_refused(spark):
    with pytest.raises(ValueError):
        SM.smooth_hysteresis(proba_frame(spark, {0: probabilities(3, 1)}), 4, enter=0.2, hold=0.3)


def test_statistics(spark):
    p = tracks(7)
    df = SM.smooth_hysteresis(proba_frame(spark, p), 4)
    stats = {r.session_id: (r.predictions, r.changes) for r in SM.stability_stats(df, size=8).collect()}
    for s, x in p.items():
        out = hysteresis(x)
        changes = sum(a != b and a != -1 for a, b in zip(out, out[1:]))
        assert stats[s] == (len(out), changes)
    events = outputs(SM.prediction_events(df, size=8))
    for s, x in p.items():
        out = hysteresis(x)
        want = [b for a, b in zip([-1, *out], out) if b != -1 and b != a]
        assert events.get(s, []) == want
