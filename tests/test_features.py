import numpy as np

from helpers import recording, samples
from sinew.functions import signal
from sinew.operators import features as FE
from sinew.operators import windows as W


def named(x, **options):
    names = FE.FeatureOptions(channels=tuple(range(x.shape[1])), **options).names()
    return dict(zip(names, signal.window_features(x[None], **options)[0]))


def test_names_and_widths():
    assert len(FE.FeatureOptions().names()) == 69
    assert len(FE.FeatureOptions.td4().names()) == 12
    assert len(FE.FeatureOptions(cross_channel=False).names()) == 60


def test_sine_peaks_at_its_bin():
    t = np.arange(150) / 1000
    x = np.stack([np.sin(2 * np.pi * 100 * t)] * 2, axis=1)
    f = named(x, bandpass=False, reinhard=False)
    assert f["ch0_pkf"] == 101.5625
    assert f["cc_01_corr"] == np.float64(1.0) or abs(f["cc_01_corr"] - 1) < 1e-6
    assert f["cc_01_lrms"] == 0.0


def test_constant_signal_is_all_zero_but_defined():
    f = named(np.full((150, 3), 2300.0))
    assert all(np.isfinite(v) for v in f.values())
    assert f["ch0_ar1"] == 0 and f["ch0_rms"] == 0 and f["ch0_zc"] == 0


def test_square_wave_crossings():
    x = np.where(np.arange(150) // 10 % 2 == 0, 1.0, -1.0)[:, None] * np.ones((1, 1))
    f = named(x, bandpass=False, reinhard=False, cross_channel=False)
    assert f["ch0_zc"] == 14 and f["ch0_wamp"] == 14


def test_mav_and_iemg_are_proportional():
    x = recording(150)[["ch0", "ch1", "ch2"]].to_numpy()
    f = named(x)
    assert abs(f["ch1_iemg"] / f["ch1_mav"] - 150) < 1e-9


def test_ar_solves_the_yule_walker_system():
    x = signal.remove_dc(recording(150)[["ch0"]].to_numpy()[None])
    r = np.array([np.dot(x[0, : 150 - k, 0], x[0, k:, 0]) / 150 for k in range(5)])
    want = np.linalg.solve(np.array([[r[abs(i - j)] for j in range(4)] for i in range(4)]), r[1:])
    np.testing.assert_allclose(signal.autoregression(x)[0, 0], want)


def test_samples_and_windows_give_the_same_vectors(spark):
    df, _ = samples(spark, 1500, 420)
    a = {(r.session_id, r.k): r.f for r in FE.extract_features(df, chunk=300).collect()}
    b = {(r.session_id, r.k): r.f for r in FE.features_of_windows(W.sliding_windows(df)).collect()}
    assert a.keys() == b.keys()
    for key in a:
        np.testing.assert_allclose(a[key], b[key], rtol=1e-9, atol=1e-9)


def test_native_and_kernel_agree(spark):
    df, _ = samples(spark, 900)
    options = FE.FeatureOptions.td4()
    kernel = FE.by_name(FE.extract_features(df, options), options).toPandas().set_index("k")
    native = FE.td4_native(df).toPandas()
    for row in native.itertuples():
        for key in ("rms", "wl", "zc", "ssc"):
            assert abs(getattr(row, key) - kernel.loc[row.k, f"ch{row.channel}_{key}"]) < 1e-6


def test_device_features_do_not_depend_on_chunks(spark):
    df, _ = samples(spark, 2600)
    big = {r.k: r.f for r in FE.extract_features(df, continuous=True, first=25).collect()}
    small = {r.k: r.f for r in FE.extract_features(df, continuous=True, first=25, chunk=450).collect()}
    assert len(big) == (2600 - 175) // 25 + 1 and big.keys() == small.keys()
    for k in big:
        np.testing.assert_allclose(big[k], small[k], rtol=1e-6, atol=1e-6)


def test_hole_restarts(spark):
    df, _ = samples(spark, 1000)
    got = {r.k for r in FE.extract_features(df.filter("i <> 500"), chunk=200).collect()}
    assert got == {k for k in range(35) if not 25 * k <= 500 < 25 * k + 150}


def test_cross_spectrum_has_36_values(spark):
    df, _ = samples(spark, 200)
    rows = FE.cross_spectrum(df).collect()
    assert {len(r.f) for r in rows} == {36} and len(rows) == 3
