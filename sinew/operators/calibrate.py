"""Per-session normalisation and calibration of feature vectors.

``features`` has ``session_id, k, f`` and, where classes matter, ``label``. Statistics are built-in
aggregates over the long form, so a large session is combined before the shuffle; a calibration
is one row per session (``mu``, ``sigma`` arrays) and joins back without a hint: Spark broadcasts
it while it is small and splits skewed sessions otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sinew.constants import REST
from sinew.functions.quantiles import exact_quantiles

EPSILON = 1e-8
FLOOR = 1e-6


def _long(features: DataFrame, keep: Sequence[str]) -> DataFrame:
    return features.select(*keep, F.posexplode("f").alias("pos", "v"))


def to_vectors(stats: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows per position → one row per key with an array per column; bounded by the vector length."""
    packed = F.sort_array(F.collect_list(F.struct("pos", *columns)))
    if not by:
        return stats.agg(packed.alias("_p")).select(*[F.col(f"_p.{c}").alias(c) for c in columns])
    return stats.groupBy(*by).agg(packed.alias("_p")).select(*by, *[F.col(f"_p.{c}").alias(c) for c in columns])


def class_statistics(features: DataFrame) -> DataFrame:
    """Count, mean and population variance per session, class and position."""
    return (
        _long(features, ["session_id", "label"])
        .groupBy("session_id", "label", "pos")
        .agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    )


def _deviation(variance: Column, mode: str) -> Column:
    std = F.sqrt(F.greatest(variance, F.lit(0.0)))
    if mode == "add":
        return std + EPSILON
    if mode == "floor":
        return F.when(std > FLOOR, std).otherwise(FLOOR)
    if mode == "one":
        return F.when(std < 1e-12, 1.0).otherwise(std)
    raise ValueError(mode)


def session_statistics(features: DataFrame, *, balanced: bool = True, epsilon: str = "add") -> DataFrame:
    """``session_id, pos, mu, sigma``: class-balanced (or plain) mean and population deviation.

    The overall variance follows from the class moments (within plus between), so both come from
    one pass. Rows with ``is_real`` false do not enter.
    """
    real = features.filter("is_real") if "is_real" in features.columns else features
    if not balanced:
        plain = _long(real, ["session_id"]).groupBy("session_id", "pos").agg(
            F.avg("v").alias("mu"), F.var_pop("v").alias("_var")
        )
        return plain.select("session_id", "pos", "mu", _deviation(F.col("_var"), epsilon).alias("sigma"))
    classes = class_statistics(real)
    whole = Window.partitionBy("session_id", "pos")
    centred = classes.withColumn("_all", F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole))
    spread = F.col("n") * (F.col("var") + (F.col("mean") - F.col("_all")) * (F.col("mean") - F.col("_all")))
    merged = centred.groupBy("session_id", "pos").agg(
        F.avg("mean").alias("mu"), (F.sum(spread) / F.sum("n")).alias("_var")
    )
    return merged.select("session_id", "pos", "mu", _deviation(F.col("_var"), epsilon).alias("sigma"))


def fit_calibration(features: DataFrame, *, balanced: bool = True, epsilon: str = "add") -> DataFrame:
    """One row per session: ``session_id, mu, sigma``."""
    return to_vectors(session_statistics(features, balanced=balanced, epsilon=epsilon), ["session_id"], ["mu", "sigma"])


def standardise(f: Column, mu: Column, sigma: Column) -> Column:
    return F.zip_with(F.zip_with(f, mu, lambda a, m: a - m), sigma, lambda d, s: d / s)


def apply_calibration(features: DataFrame, calibration: DataFrame, sigma_train: DataFrame | None = None) -> DataFrame:
    """(f − mu)/sigma per session; training deviations win where given, unfitted sessions pass through.

    ``sigma_train`` is one row with column ``sigma_train``.
    """
    scale = calibration.select("session_id", "mu", "sigma")
    if sigma_train is not None:
        fixed = F.array(*[F.lit(float(v)) for v in sigma_train.first()["sigma_train"]])
        scale = scale.withColumn("sigma", fixed)
    keep = [c for c in features.columns if c != "f"]
    done = F.when(F.col("mu").isNull(), F.col("f")).otherwise(standardise(F.col("f"), F.col("mu"), F.col("sigma")))
    return features.join(scale, "session_id", "left").select(*keep, done.alias("f"))


def session_zscore(features: DataFrame, *, balanced: bool = True, epsilon: str = "add") -> DataFrame:
    """Every vector in units of its session."""
    return apply_calibration(features, fit_calibration(features, balanced=balanced, epsilon=epsilon))


def plot_zscore(features: DataFrame) -> DataFrame:
    """The plotting variant: plain mean, no epsilon, constant features keep scale 1."""
    return session_zscore(features, balanced=False, epsilon="one")


def invert_calibration(features: DataFrame, calibration: DataFrame) -> DataFrame:
    keep = [c for c in features.columns if c != "f"]
    raw = F.zip_with(F.zip_with("f", "sigma", lambda a, s: a * s), F.col("mu"), lambda a, m: a + m)
    return features.join(calibration.select("session_id", "mu", "sigma"), "session_id").select(*keep, raw.alias("f"))


def training_stats(features: DataFrame) -> DataFrame:
    """``pos, mu_train, sigma_train``: session statistics averaged over sessions."""
    return session_statistics(features).groupBy("pos").agg(
        F.avg("mu").alias("mu_train"), F.avg("sigma").alias("sigma_train")
    )


def raw_centroids(features: DataFrame) -> DataFrame:
    """``label, pos, centroid``: class means averaged over the sessions that have the class."""
    return class_statistics(features).groupBy("label", "pos").agg(F.avg("mean").alias("centroid"))


def rest_delta(features: DataFrame, rest: str = REST) -> DataFrame:
    """``pos, delta``: class-balanced training origin minus the rest centroid."""
    centre = raw_centroids(features).filter(F.col("label") == rest).select("pos", "centroid")
    return training_stats(features).join(centre, "pos").select("pos", (F.col("mu_train") - F.col("centroid")).alias("delta"))


def class_centroids(normalised: DataFrame) -> DataFrame:
    """``label, pos, centroid`` of vectors that are normalised already."""
    return _long(normalised, ["label"]).groupBy("label", "pos").agg(F.avg("v").alias("centroid"))


def calibration_residual(train: DataFrame, calibration_features: DataFrame) -> DataFrame:
    """Per session and common class the distance between training and calibrated centroid.

    ``train`` is ``class_centroids`` of the training data.
    """
    classes = class_statistics(calibration_features).select("session_id", "label", "pos", F.col("mean").alias("_c"))
    scale = session_statistics(calibration_features)
    joined = classes.join(scale, ["session_id", "pos"]).join(train, ["label", "pos"])
    d = F.col("centroid") - (F.col("_c") - F.col("mu")) / F.col("sigma")
    return joined.groupBy("session_id", "label").agg(F.sqrt(F.sum(d * d)).alias("residual"))


def device_calibration(
    rest: DataFrame, sigma_train: DataFrame | None = None, delta: DataFrame | None = None, *, least: int = 10
) -> DataFrame:
    """The device's rest calibration per session: ``session_id, pos, mu, sigma``.

    ``sigma_train`` (pos, sigma_train) replaces deviations where above 1e-6; without it small
    deviations are lifted to a quarter of their mean over the vector. ``delta`` (pos, delta) moves
    the rest mean to the training origin. Sessions with too few windows are left out.
    """
    stats = _long(rest, ["session_id"]).groupBy("session_id", "pos").agg(
        F.count("v").alias("_n"), F.avg("v").alias("mu"), F.var_pop("v").alias("_var")
    ).filter(F.col("_n") >= least)
    std = F.when(F.col("_var") > 1e-12, F.sqrt("_var")).otherwise(FLOOR)
    stats = stats.withColumn("sigma", std)
    if sigma_train is not None:
        stats = stats.join(sigma_train.select("pos", "sigma_train"), "pos", "left").withColumn(
            "sigma", F.when(F.col("sigma_train") > FLOOR, F.col("sigma_train")).otherwise(F.col("sigma"))
        )
    else:
        vector = Window.partitionBy("session_id")
        floor = F.greatest(0.25 * F.avg("sigma").over(vector), F.lit(FLOOR))
        stats = stats.withColumn("_floor", floor).withColumn("sigma", F.greatest("sigma", "_floor"))
    if delta is not None:
        stats = stats.join(delta.select("pos", "delta"), "pos", "left").withColumn(
            "mu", F.col("mu") + F.coalesce("delta", F.lit(0.0))
        )
    return stats.select("session_id", "pos", "mu", "sigma")


def rest_calibration(
    rest: DataFrame, sigma_train: DataFrame | None = None, *, seconds: float = 3.0, hop_ms: float = 25.0
) -> DataFrame:
    """The laptop's calibration from the first max(20, seconds/hop) windows: ``session_id, pos, mu, sigma``."""
    n = max(20, int(seconds * 1000 / hop_ms))
    clip = rest.filter(F.col("k") < n)
    stats = session_statistics(clip, balanced=False, epsilon="floor")
    if sigma_train is None:
        return stats
    return stats.join(sigma_train.select("pos", "sigma_train"), "pos").select(
        "session_id", "pos", "mu", F.col("sigma_train").alias("sigma")
    )


# ---------------------------------------------------------------------------------- rest gate

CANDIDATES = 1000


def rest_gate(energy: DataFrame, rest: str = REST, candidates: int = CANDIDATES) -> DataFrame:
    """Energy threshold per session that best separates rest from activity.

    ``energy`` (session_id, label, ac_rms). Of evenly spaced thresholds between the lowest rest
    and the highest active value the first with the least summed miss rate. A value only matters
    by how many thresholds lie below it, so each session reduces to a histogram over thresholds
    and two running sums; no value meets every threshold.
    """
    is_rest = F.col("label") == rest
    limits = energy.groupBy("session_id").agg(
        F.min(F.when(is_rest, F.col("ac_rms"))).alias("lo"),
        F.max(F.when(~is_rest, F.col("ac_rms"))).alias("hi"),
        F.max(F.when(is_rest, F.col("ac_rms"))).alias("rest_max"),
        F.count_if(is_rest).alias("n_rest"),
        F.count_if(~is_rest).alias("n_active"),
    ).filter((F.col("n_rest") > 0) & (F.col("n_active") > 0))
    step = (F.col("hi") - F.col("lo")) / (candidates - 1)

    def threshold(j: Column) -> Column:
        return F.when(j == candidates - 1, F.col("hi")).otherwise(F.col("lo") + j * step)

    v = F.col("ac_rms")
    guess = F.when(step > 0, F.floor((v - F.col("lo")) / step)).when(v > F.col("lo"), candidates).otherwise(0)
    base = F.least(F.greatest(guess - 2, F.lit(0)), F.lit(candidates)).cast("int")
    near = [F.when((base + d < candidates) & (threshold(base + d) < v), 1).otherwise(0) for d in range(5)]
    below = base + sum(near[1:], near[0])
    histogram = (
        energy.join(limits, "session_id").withColumn("j", F.when(step == 0, F.when(v > F.col("lo"), candidates).otherwise(0)).otherwise(below))
        .groupBy("session_id", "lo", "hi", "rest_max", "n_rest", "n_active", "j")
        .agg(F.count_if(is_rest).alias("_rest"), F.count_if(~is_rest).alias("_active"))
    )
    zero = limits.select(*[c for c in histogram.columns if c in limits.columns], F.lit(0).alias("j"),
                         F.lit(0).cast("long").alias("_rest"), F.lit(0).cast("long").alias("_active"))
    merged = histogram.unionByName(zero).groupBy("session_id", "lo", "hi", "rest_max", "n_rest", "n_active", "j").agg(
        F.sum("_rest").alias("_rest"), F.sum("_active").alias("_active")
    )
    upto = Window.partitionBy("session_id").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    scored = merged.withColumn("rest_miss", 1 - F.sum("_rest").over(upto) / F.col("n_rest")).withColumn(
        "active_miss", F.sum("_active").over(upto) / F.col("n_active")
    ).filter(F.col("j") < candidates)
    # Rates are compared as exact counts so that equal errors are ties.
    error = (F.col("n_rest") - F.sum("_rest").over(upto)) * F.col("n_active") + F.sum("_active").over(upto) * F.col("n_rest")
    ranked = scored.withColumn("_error", error)
    best = ranked.groupBy("session_id").agg(
        F.min_by(
            F.struct(threshold(F.col("j")).alias("gate"), "rest_miss", "active_miss"), F.struct("_error", "j")
        ).alias("_b")
    )
    return best.select("session_id", "_b.gate", "_b.rest_miss", "_b.active_miss")


def energy_summary(energy: DataFrame, rest: str = REST) -> DataFrame:
    """p5, p50, p95, min, max per session and label, and whether a gesture overlaps rest."""
    by = ["session_id", "label"]
    ends = energy.groupBy(*by).agg(F.min("ac_rms").alias("low"), F.max("ac_rms").alias("high"))
    quantiles = exact_quantiles(energy, by, "ac_rms", [0.05, 0.5, 0.95], ["p5", "p50", "p95"])
    resting = ends.filter(F.col("label") == rest).select("session_id", F.col("high").alias("_rest"))
    joined = ends.join(quantiles, by).join(resting, "session_id", "left")
    overlap = (F.col("label") != rest) & (F.col("low") < F.col("_rest"))
    return joined.select(*by, "p5", "p50", "p95", "low", "high", F.coalesce(overlap, F.lit(False)).alias("overlaps_rest"))


def apply_rest_gate(rows: DataFrame, gates: DataFrame, classes: Sequence[str], rest: str = REST) -> DataFrame:
    """Below its session's gate a row is rest with probability 1; ``p`` is kept otherwise."""
    certain = F.array(*[F.lit(1.0 if c == rest else 0.0) for c in classes])
    joined = rows.join(gates.select("session_id", "gate"), "session_id", "left")
    below = F.coalesce(F.col("ac_rms") < F.col("gate"), F.lit(False))
    return joined.select(*[c for c in rows.columns if c != "p"], below.alias("gated"), F.when(below, certain).otherwise(F.col("p")).alias("p"))
