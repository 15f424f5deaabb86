import numpy as np
import pytest

from helpers import cascade, samples
from sinew.functions import signal
from sinew.operators import filters as FI

# Sections of the deployed band-pass as the device states them.
SECTIONS = [
    (np.array([0.7320224766, 1.4640449531, 0.7320224766]), np.array([1.0, 1.5597081442, 0.6416146818])),
    (np.array([1.0, -2.0, 1.0]), np.array([1.0, -1.8224796027, 0.8372542588])),
]


def test_design_equals_the_device_coefficients():
    delta = np.eye(1, 400)[0]
    np.testing.assert_allclose(signal.impulse_response(*signal.BANDPASS, 400), cascade(delta, SECTIONS), atol=1e-9)


@pytest.mark.parametrize("design,cut", [(signal.HIGHPASS_20, 20.0), (signal.LOWPASS_10, 10.0), (signal.BANDPASS_4, 20.0), (signal.BANDPASS_4, 450.0)])
def test_half_power_at_the_edge(design, cut):
    h = signal.impulse_response(*design, 2000)
    gain = abs(np.sum(h * np.exp(-2j * np.pi * cut / 1000 * np.arange(2000))))
    assert gain == pytest.approx(np.sqrt(0.5), abs=1e-9)


def test_stream_filter_equals_literal_loop_for_any_chunk(spark):
    df, frame = samples(spark, 3000)
    want = cascade(frame["ch1"].to_numpy(), SECTIONS)
    for size in (400, 16384):
        got = FI.bandpass_stream(df, ["ch1"], size=size).toPandas().sort_values("i")
        np.testing.assert_allclose(got["ch1"], want, atol=1e-5)


def test_window_filter_starts_settled():
    x = np.full((1, 150, 1), 2300.0)
    np.testing.assert_allclose(signal.bandpass_windows(x), 0.0, atol=1e-9)


@pytest.mark.parametrize("kind", ["high", "low", "band"])
def test_zero_phase_chunks_equal_one_pass(spark, kind):
    df, frame = samples(spark, 5200)
    design, pad = {"high": (signal.HIGHPASS_20, 9), "low": (signal.LOWPASS_10, 9), "band": (signal.BANDPASS_4, 27)}[kind]
    want = signal.zero_phase(frame[["ch0"]].to_numpy(), design, 4000, pad, True, True)[:, 0]
    got = FI.zero_phase(df, kind, ["ch0"], size=1000).toPandas().sort_values("i")
    np.testing.assert_allclose(got["ch0"], want, atol=1e-7)


def test_envelope_chunks_equal_one_pass(spark):
    df, _ = samples(spark, 6100)
    one = FI.activity_envelope(df).toPandas().sort_values("i")["env"].to_numpy()
    cut = FI.activity_envelope(df, size=2000).toPandas().sort_values("i")["env"].to_numpy()
    np.testing.assert_allclose(one, cut, atol=1e-6)


def test_recent_rms_warm_up(spark):
    df, frame = samples(spark, 400)
    got = FI.recent_rms(df, size=150).toPandas().sort_values("i")["rms"].to_numpy()
    assert (got[:149] == 0).all()
    x = frame["ch3"].to_numpy()
    assert got[300] == pytest.approx(np.sqrt((x[251:301] ** 2).mean()))
