"""Whole jobs: stored sessions to models, samples to smoothed predictions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinew.operators import augment as AU
from sinew.operators import calibrate as C
from sinew.operators import features as FE
from sinew.operators import labels as L
from sinew.operators import models as M
from sinew.operators import smooth as SM
from sinew.operators import split as SP
from sinew.session import settle
from sinew.sources import lines as LN
from sinew.sources import store


def label_recording(samples: DataFrame, schedule: DataFrame, envelope: DataFrame | None = None) -> DataFrame:
    """Samples and prompts to labelled window keys, moved to the activity onset if an envelope is given."""
    from sinew.operators.windows import window_index

    labelled = L.label_windows(window_index(samples), schedule)
    if envelope is None:
        return labelled
    aligned = L.align_to_onset(labelled, envelope).withColumn("label_original", F.col("label"))
    return L.forward_shift(aligned.drop("label").withColumnRenamed("aligned_label", "label"))


def training_matrix(windows: DataFrame, options: FE.FeatureOptions = FE.FeatureOptions(), *, multiplier: int = 1) -> DataFrame:
    """``windows`` (session_id, k, label, trial_id, x) → z-scored vectors shared by all trainers."""
    rows = AU.augment(windows, multiplier) if multiplier > 1 else AU.tile_groups(windows, 1)
    keep = [c for c in rows.columns if c not in ("x", "start_time", "end_time")]
    # Read twice: for the statistics and to be scaled by them.
    return C.session_zscore(settle(FE.features_of_windows(rows, options, keep)))


@dataclass(frozen=True)
class Trained:
    lda: M.LinearModel
    ensemble: M.Ensemble
    #: ``fold, n, accuracy`` of the discriminant
    accuracy: DataFrame
    #: ``model, fold, n, accuracy`` of the discriminant, each specialist and the ensemble
    scores: DataFrame
    #: ``pos, importance`` of the discriminant
    importance: DataFrame


def train_models(matrix: DataFrame, folds: int = 5) -> Trained:
    """Discriminant, ensemble, grouped accuracy and importance from one stored training matrix.

    One pass over it gives the moments per fold and class, whose sums and sub-blocks are all statistics of all models;
    a second one scores every row by the models that did not see its fold. Normalisation happened before the folds, so its
    statistics include the held-out rows; use ``fold_normalised`` to keep a held-out session's statistics out.
    """
    spark = matrix.sparkSession
    assigned = SP.group_kfold(matrix.filter("is_real"), ["session_id", "trial_id"], folds).drop("n")
    rows = settle(matrix.join(assigned, ["session_id", "trial_id"]).select("session_id", "k", "label", "fold", "f"))
    table = settle(M.moment_table(rows, "fold"))
    total = M.label_totals(table)
    columns = M.specialist_columns(len(next(iter(total.values())).mean))
    lda, specialists = M.fit_lda(total), M.fit_specialists(total, columns)
    heads = {**columns, "lda": list(range(sum(map(len, columns.values()))))}
    held, classes = M.out_of_fold_proba(rows, "fold", heads, keep=("session_id", "k", "label", "fold"), table=table)
    held, k, inner = settle(held), len(classes), len(classes) * len(columns)
    stacked = held.select("label", "fold", F.slice("p", 1, inner).alias("f"))
    meta_table = settle(M.moment_table(stacked, "fold"))
    meta = M.fit_lda(M.label_totals(meta_table))
    outer, _ = M.out_of_fold_proba(stacked, "fold", keep=("label", "fold"), table=meta_table)

    def hits(p, scored: DataFrame, name: str) -> DataFrame:
        return scored.select(F.lit(name).alias("model"), "fold", (M.predict_label(p, classes) == F.col("label")).alias("hit"))

    every = hits(F.col("p"), outer, "meta")
    for n, name in enumerate(heads):
        every = every.unionByName(hits(F.slice("p", n * k + 1, k), held, name))
    scores = every.groupBy("model", "fold").agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("accuracy"))
    accuracy = scores.filter("model = 'lda'").drop("model")
    return Trained(lda, M.Ensemble(columns, specialists, meta), accuracy, scores, M.feature_importance(lda.table(spark, "lda")))


def _outside(moments: DataFrame, group: list[str], fold: str) -> DataFrame:
    """``group…, fold, mu, sigma`` vectors of each group's rows outside each of its folds, classes weighing the same in ``mu``.

    Sums are total − fold, about the group's mean, so that large offsets do not cancel. A group that lies in
    one fold has none.
    """
    centre = moments.groupBy(*group, "pos").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_c"))
    about = moments.join(centre, [*group, "pos"]).withColumn("_d", F.col("m") - F.col("_c"))
    sums = {"_n": F.sum("n"), "_s": F.sum(F.col("n") * F.col("_d")), "_q": F.sum(F.col("n") * (F.col("s") + F.col("_d") * F.col("_d")))}
    total = about.groupBy(*group, "label", "pos", "_c").agg(*[v.alias(k) for k, v in sums.items()])
    own = about.groupBy(*group, "label", "pos", fold).agg(*[v.alias(f"_f{k}") for k, v in sums.items()])
    # Every class of the group counts for every fold, also where the fold has no row of it.
    grid = total.join(moments.select(*group, fold).distinct(), group).join(own, [*group, "label", "pos", fold], "left")
    left = grid.select(*group, fold, "pos", "_c", *[(F.col(k) - F.coalesce(f"_f{k}", F.lit(0))).alias(k) for k in sums]).filter("_n > 0")
    mean = F.sum("_s") / F.sum("_n")
    stats = left.groupBy(*group, fold, "pos").agg(
        (F.avg(F.col("_s") / F.col("_n")) + F.first("_c")).alias("mu"),
        (F.sqrt(F.greatest(F.sum("_q") / F.sum("_n") - mean * mean, F.lit(0.0))) + C.EPSILON).alias("sigma"),
    )
    return C.to_vectors(stats, [*group, fold], ["mu", "sigma"])


def fold_normalised(features: DataFrame, fold: str = "fold") -> DataFrame:
    """z-score with statistics of the rows outside the row's own fold.

    ``features`` has raw vectors. Statistics come from the row's session; where the session lies in one fold, as
    in leave-one-session-out, from all other sessions outside the fold. Returns ``f`` per row, no rescan per fold.
    """
    moments = (
        features.select("session_id", "label", fold, F.posexplode("f").alias("pos", "v"))
        .groupBy("session_id", "label", fold, "pos")
        .agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    )
    own = _outside(moments, ["session_id"], fold)
    others = _outside(moments.withColumn("_all", F.lit(0)), ["_all"], fold).select(fold, F.col("mu").alias("_mu"), F.col("sigma").alias("_sigma"))
    keep = [c for c in features.columns if c != "f"]
    joined = features.join(own, ["session_id", fold], "left").join(others, fold, "left")
    mu, sigma = F.coalesce("mu", "_mu"), F.coalesce("sigma", "_sigma")
    return joined.select(*keep, C.standardise(F.col("f"), mu, sigma).alias("f"))


def train_from_store(spark, path: str, folds: int = 5) -> Trained:
    return train_models(training_matrix(store.read_all_training(spark, path)), folds)


def predict_sessions(
    samples: DataFrame, calibration: DataFrame, models: list, *, smoother: str = "hysteresis", one_hot: tuple[int, ...] = ()
) -> DataFrame:
    """Samples to smoothed outputs as on the device: features, calibration, models, average, smoothing.

    ``one_hot`` names the models (by position) whose vector is flattened to winner and rest.
    """
    features = C.apply_calibration(FE.extract_features(samples, continuous=True, first=25), calibration)
    joint = M.score(features, _Average(tuple(models), tuple(one_hot)))
    classes = len(models[0].classes)
    if smoother == "hysteresis":
        return SM.smooth_hysteresis(joint, classes)
    return SM.smooth_vote_debounce(joint, classes)


@dataclass(frozen=True)
class _Average:
    """Mean of several models' probabilities in one pass over the vectors."""

    models: tuple
    one_hot: tuple[int, ...]

    @property
    def classes(self):
        return self.models[0].classes

    def probabilities(self, x):
        import numpy as np

        parts = []
        for n, model in enumerate(self.models):
            p = model.probabilities(x)
            if n in self.one_hot:
                top = p.max(axis=1, keepdims=True)
                flat = np.repeat((1 - top) / (p.shape[1] - 1), p.shape[1], axis=1)
                flat[np.arange(len(p)), p.argmax(axis=1)] = top[:, 0]
                p = flat
            parts.append(p)
        return np.mean(parts, axis=0)


def compare_dump(lines: DataFrame, features: DataFrame) -> DataFrame:
    """Dumped (calibrated) vectors against computed raw ones: ``pos, drift, shift``.

    ``features`` is keyed by (session_id, end).
    """
    from sinew.operators.evaluate import feature_drift

    clipped = LN.dump_slice(lines)
    dump = LN.read_feature_dump(clipped).select("session_id", "end", "f")
    raw = C.invert_calibration(dump, LN.read_dump_calibration(clipped))
    return feature_drift(raw, features, ("session_id", "end"))
