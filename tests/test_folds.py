import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sinew.functions import folds
from sinew.operators import events as E
from sinew.operators import proportional as P

angles = st.lists(st.floats(60, 140), min_size=1, max_size=60)


@settings(max_examples=200, deadline=None)
@given(targets=angles, entry=st.floats(60, 140))
def test_follow_map_is_the_chunk(targets, entry):
    targets = np.array(targets)
    exact = folds.follow(targets, entry, 6.0, 60.0, 140.0)[-1]
    mapped = folds.follow_advance(folds.follow_maps([targets], 6.0, 60.0, 140.0)[0], np.array([entry]))[0]
    assert abs(exact - mapped) < 1e-9


@settings(max_examples=200, deadline=None)
@given(values=st.lists(st.floats(60, 63), min_size=1, max_size=60), entry=st.one_of(st.just(-1.0), st.floats(60, 63)))
def test_emission_map_is_the_chunk(values, entry):
    values = np.array(values)
    flags = folds.emissions(values, entry, 0.5)
    exact = values[flags][-1] if flags.any() else entry
    mapped = folds.emission_advance(0.5)(folds.emission_maps([values], 0.5)[0], np.array([entry]))[0]
    assert exact == mapped


def levels(spark):
    rng = np.random.default_rng(4)
    tracks = {s: np.clip(0.5 + np.cumsum(rng.normal(0, 0.03, n)), 0, 1) for s, n in enumerate((3, 300))}
    rows = [(s, k, float(v)) for s, t in tracks.items() for k, v in enumerate(t)]
    return tracks, spark.createDataFrame(rows, "session_id long, k long, level_ema double")


def test_slew_and_writes_for_any_chunk(spark):
    tracks, df = levels(spark)
    for size in (7, 4096):
        angle = P.slew_limit(df, size=size)
        got = angle.toPandas().sort_values(["session_id", "k"])
        for s, t in tracks.items():
            want = folds.follow(60 + 80 * t, 60.0, 6.0, 60.0, 140.0)
            np.testing.assert_allclose(got[got["session_id"] == s]["angle"], want, atol=1e-9)
        sent = P.write_filter(angle, size=size).toPandas()
        for s, t in tracks.items():
            want = folds.follow(60 + 80 * t, 60.0, 6.0, 60.0, 140.0)
            assert sorted(sent[sent["session_id"] == s]["k"]) == np.flatnonzero(folds.emissions(want, -1.0, 0.5)).tolist()


def test_assembly_for_any_chunk(spark):
    rng = np.random.default_rng(8)
    rows = [(s, n, int(c), int(rng.integers(0, 4096))) for s in range(2) for n, c in enumerate(rng.integers(0, 4, 200))]
    df = spark.createDataFrame(rows, "session_id long, seq long, channel int, value int")
    want = []
    for s in range(2):
        seen, latest = set(), [0] * 4
        for sid, n, c, v in rows:
            if sid != s:
                continue
            latest[c] = v
            seen.add(c)
            if len(seen) == 4:
                want.append((s, n, *latest))
                seen = set()
    for size in (9, 16384):
        got = [(r.session_id, r.seq, r.ch0, r.ch1, r.ch2, r.ch3) for r in E.assemble_channels(df, size=size).orderBy("session_id", "seq").collect()]
        assert got == want


def test_device_states_for_any_chunk(spark):
    rng = np.random.default_rng(2)
    names = ["connect", "disconnect", "stop", "start", "calibrate", "start_predict", None]
    rows = [(0, n, names[i]) for n, i in enumerate(rng.integers(0, 7, 150))]
    df = spark.createDataFrame(rows, "session_id long, k long, cmd string")
    state, want = "IDLE", []
    for _, _, cmd in rows:
        if cmd == "connect":
            state = "CONNECTED"
        elif cmd == "disconnect" and state != "IDLE":
            state = "IDLE"
        elif cmd == "stop" and state not in ("IDLE", "CONNECTED"):
            state = "CONNECTED"
        elif state == "CONNECTED" and cmd in ("start", "calibrate", "start_predict"):
            state = {"start": "STREAMING", "calibrate": "CALIBRATING", "start_predict": "PREDICTING"}[cmd]
        want.append(state)
    for size in (5, 4096):
        assert [r.state for r in E.device_state_timeline(df, size=size).orderBy("k").collect()] == want
