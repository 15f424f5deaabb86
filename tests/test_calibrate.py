import numpy as np
import pytest
from pyspark.sql import functions as F

from sinew.functions.quantiles import exact_quantiles
from sinew.operators import calibrate as C


@pytest.mark.parametrize("cells", [4096, 64, 2])
def test_exact_quantiles(spark, cells):
    rng = np.random.default_rng(0)
    groups = {"a": rng.normal(size=501), "b": np.repeat(rng.normal(size=7), 30), "c": np.array([5.0]), "d": np.append(rng.normal(size=99), 1e9)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {r.g: (r.p5, r.p50, r.p95) for r in exact_quantiles(df, ["g"], "v", [0.05, 0.5, 0.95], ["p5", "p50", "p95"], cells=cells).collect()}
    for g, vs in groups.items():
        np.testing.assert_allclose(got[g], np.percentile(vs, [5, 50, 95]), rtol=1e-9)


def energy(spark, rest, active):
    rows = [(0, "rest", float(v)) for v in rest] + [(0, "fist", float(v)) for v in active]
    return spark.createDataFrame(rows, "session_id long, label string, ac_rms double")


@pytest.mark.parametrize("seed", range(4))
def test_rest_gate_equals_the_scan(spark, seed):
    rng = np.random.default_rng(seed)
    rest, active = rng.gamma(4, 2, 80), rng.gamma(6, 3, 140)
    got = C.rest_gate(energy(spark, rest, active)).first()
    best, best_error = None, np.inf
    for t in np.linspace(rest.min(), active.max(), 1000):
        error = (rest > t).sum() * len(active) + (active <= t).sum() * len(rest)
        if error < best_error:
            best, best_error = t, error
    assert got.gate == pytest.approx(best, rel=1e-12)
    assert got.rest_miss == pytest.approx((rest > best).mean())


def vectors(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(3, 2, (n, 5))
    x[:, 4] = 7.0
    labels = [("rest", "fist", "open")[i % 3 if i % 5 else 0] for i in range(n)]
    rows = [(i % 2, i, labels[i], x[i].tolist()) for i in range(n)]
    return x, np.array(labels), spark.createDataFrame(rows, "session_id long, k long, label string, f array<double>")


def test_balanced_zscore(spark):
    x, labels, df = vectors(spark)
    got = {r.k: r.f for r in C.session_zscore(df).collect()}
    for s in (0, 1):
        at = np.arange(len(x)) % 2 == s
        means = np.mean([x[at & (labels == c)].mean(axis=0) for c in sorted(set(labels[at]))], axis=0)
        want = (x[at] - means) / (x[at].std(axis=0) + 1e-8)
        # The constant feature has deviation 0 up to rounding.
        np.testing.assert_allclose([got[k][:4] for k in np.flatnonzero(at)], want[:, :4], rtol=1e-9)


def test_statistics_use_real_rows_only(spark):
    _, _, df = vectors(spark)
    fake = df.withColumn("f", F.transform("f", lambda v: v * 100)).withColumn("is_real", F.lit(False))
    both = df.withColumn("is_real", F.lit(True)).unionByName(fake)
    a = {(r.session_id, r.pos): (r.mu, r.sigma) for r in C.session_statistics(df).collect()}
    b = {(r.session_id, r.pos): (r.mu, r.sigma) for r in C.session_statistics(both).collect()}
    assert a == b


def test_device_calibration_needs_ten_windows(spark):
    _, _, df = vectors(spark, 18)
    assert C.device_calibration(df).count() == 0
    assert C.device_calibration(df, least=5).count() > 0


def test_unfitted_session_passes_through(spark):
    _, _, df = vectors(spark)
    fitted = C.fit_calibration(df).filter("session_id = 0")
    out = C.apply_calibration(df, fitted).filter("session_id = 1").join(df.withColumnRenamed("f", "g"), ["session_id", "k"])
    assert out.filter("f <> g").count() == 0
