import numpy as np
import pytest

from helpers import samples
from sinew.operators import windows as W


@pytest.mark.parametrize("n,batch,device", [(149, 0, 0), (150, 1, 0), (174, 1, 0), (175, 2, 1), (2000, 75, 74)])
def test_counts(spark, n, batch, device):
    df, _ = samples(spark, n)
    assert W.sliding_windows(df).count() == batch
    assert W.device_windows(df).count() == device


def test_any_chunk_gives_the_same_windows(spark):
    df, frame = samples(spark, 1300, 400)
    reference = {(r.session_id, r.k): r.x for r in W.sliding_windows(df).collect()}
    small = {(r.session_id, r.k): r.x for r in W.sliding_windows(df, chunk=160).collect()}
    assert reference == small
    x = frame[frame["session_id"] == 0][["ch0", "ch1", "ch2", "ch3"]].to_numpy()
    np.testing.assert_array_equal(np.array(reference[(0, 7)]).T, x[175:325])


def test_hole_drops_only_windows_that_span_it(spark):
    df, _ = samples(spark, 1000)
    got = {r.k for r in W.sliding_windows(df.filter("i <> 500"), chunk=200).collect()}
    assert got == {k for k in range(35) if not 25 * k <= 500 < 25 * k + 150}


def test_flush_partial_keeps_overlap(spark):
    df, _ = samples(spark, 180, 60)
    got = {r.session_id: (r.k, r.n) for r in W.flush_partial(df).collect()}
    assert got == {0: (2, 130), 1: (0, 60)}


def test_reconstruct_returns_the_signal(spark):
    df, frame = samples(spark, 700)
    back = W.reconstruct_signal(W.sliding_windows(df)).toPandas().sort_values("i")
    assert len(back) == 22 * 25 + 150
    np.testing.assert_array_equal(back["ch2"], frame["ch2"][: len(back)])


def test_empty_sessions(spark):
    df, _ = samples(spark, 200)
    empty = df.filter("i < 0")
    assert W.sliding_windows(empty).count() == 0
    assert W.window_index(empty).count() == 0
