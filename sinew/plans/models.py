"""Queries: fitting and scoring models on labelled vectors."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from sinew.operators import calibrate as C
from sinew.operators import features as FE
from sinew.operators import labels as L
from sinew.operators import models as M
from sinew.operators import networks as N
from sinew.operators import split as SP
from sinew.operators import windows as W
from sinew.plans import discriminants as D
from sinew.plans import fragments as S
from sinew.plans import signals as SG
from sinew.plans import workflows as WF
from sinew.plans.catalog import q, r, register, rounded
from sinew.session import checkpoint_folder, written
from sinew.sources import store
from sinew.sources import testdata as td

CLASSES = tuple(f"c{n}" for n in range(10))
WIDTH = 64
# Column blocks that stand for the three specialists.
BLOCKS = {"td": list(range(0, 32)), "fd": list(range(32, 56)), "cc": list(range(56, 64))}


def _weights(rows: int, columns: int, shift: int = 0) -> np.ndarray:
    """Parameters by rule, so both sides can state them."""
    r_, c = np.meshgrid(np.arange(rows), np.arange(columns), indexing="ij")
    return ((r_ * 31 + c * 17 + shift) % 23 - 11) / 7.0


def _linear(classes: int, columns: int, shift: int = 0) -> M.LinearModel:
    return M.LinearModel(CLASSES[:classes], _weights(classes, columns, shift), (np.arange(classes) % 3 - 1) / 4.0)


def _scores_sql(x: str, rows: int, columns: int, shift: int = 0) -> str:
    """List of w·x + b per class."""
    return (
        f"list_transform(range(0, {rows}), lambda r: (r % 3 - 1) / 4e0 + "
        f"list_sum(list_transform(range(0, {columns}), lambda c: ((r * 31 + c * 17 + {shift}) % 23 - 11) / 7e0 * {x}[c + 1])))"
    )


def _softmax_sql(scores: str) -> str:
    e = f"list_transform({scores}, lambda v: exp(v - list_max({scores})))"
    return f"list_transform({e}, lambda v: v / list_sum({e}))"


def _columns(width: int, name: str = "p") -> list:
    return [r(F.col(name)[c]).alias(f"{name}{c}") for c in range(width)]


def _columns_sql(width: int, name: str = "p") -> str:
    return ", ".join(q(f"{name}[{c + 1}]", f"{name}{c}") for c in range(width))


SCORED = (
    S.VECTORS, f"sc AS MATERIALIZED (SELECT *, {_scores_sql('f', 10, WIDTH)} AS s FROM vec)",
    f"pr AS MATERIALIZED (SELECT session_id, k, label, trial_id, f, {_softmax_sql('s')} AS p FROM sc)",
)


def _scored(spark, sf):
    return M.score(td.vectors(spark, sf), _linear(10, WIDTH), ["session_id", "k", "label", "trial_id"])


@register("score_lda", S.sql(*SCORED, select=f"SELECT session_id, k, {_columns_sql(10)} FROM pr"))
def score_lda(spark, sf):
    return _scored(spark, sf).select("session_id", "k", *_columns(10))


@register("predict_label", S.sql(*SCORED, select="SELECT session_id, k, 'c' || (list_position(p, list_max(p)) - 1) AS predicted FROM pr"))
def predict_label(spark, sf):
    return _scored(spark, sf).select("session_id", "k", M.predict_label(F.col("p"), CLASSES).alias("predicted"))


@register("soft_one_hot", S.sql(*SCORED, "oh AS (SELECT session_id, k, list_transform(range(1, 11), lambda j: CASE WHEN j = list_position(p, list_max(p)) THEN p[j] ELSE (1 - list_max(p)) / 9 END) AS p FROM pr)",
    select=f"SELECT session_id, k, {_columns_sql(10)} FROM oh"))
def soft_one_hot(spark, sf):
    return _scored(spark, sf).select("session_id", "k", M.soft_one_hot(F.col("p")).alias("p")).select("session_id", "k", *_columns(10))


ENSEMBLE = (
    S.VECTORS,
    "sp AS MATERIALIZED (SELECT session_id, k, f[1:32] AS xa, f[33:56] AS xb, f[57:64] AS xc FROM vec)",
    f"ss AS MATERIALIZED (SELECT session_id, k, {_scores_sql('xa', 10, 32, 1)} AS sa, {_scores_sql('xb', 10, 24, 2)} AS sb, {_scores_sql('xc', 10, 8, 3)} AS sc FROM sp)",
    f"sq AS MATERIALIZED (SELECT session_id, k, {_softmax_sql('sa')} || {_softmax_sql('sb')} || {_softmax_sql('sc')} AS f FROM ss)",
    f"sm AS MATERIALIZED (SELECT session_id, k, {_scores_sql('f', 10, 30, 4)} AS s FROM sq)",
    f"en AS MATERIALIZED (SELECT session_id, k, {_softmax_sql('s')} AS p FROM sm)",
)


def _ensemble() -> M.Ensemble:
    specialists = {n: _linear(10, len(at), shift + 1) for shift, (n, at) in enumerate(BLOCKS.items())}
    return M.Ensemble(BLOCKS, specialists, _linear(10, 30, 4))


@register("score_ensemble", S.sql(*ENSEMBLE, select=f"SELECT session_id, k, {_columns_sql(10)} FROM en"))
def score_ensemble(spark, sf):
    return M.score(td.vectors(spark, sf), _ensemble(), ["session_id", "k"]).select("session_id", "k", *_columns(10))


def _layer_sql(x: str, inputs: int, outputs: int, shift: int, relu: bool) -> str:
    y = (
        f"(o % 5 - 2) / 8e0 + list_sum(list_transform(range(0, {inputs}), lambda c: ((c * 31 + o * 17 + {shift}) % 23 - 11) / 7e0 * {x}[c + 1]))"
    )
    return f"list_transform(range(0, {outputs}), lambda o: {'greatest(' + y + ', 0e0)' if relu else y})"


NET = (
    S.VECTORS,
    f"l1 AS MATERIALIZED (SELECT session_id, k, {_layer_sql('f', 64, 32, 5, True)} AS h FROM vec)",
    f"l2 AS MATERIALIZED (SELECT session_id, k, {_layer_sql('h', 32, 16, 6, True)} AS h FROM l1)",
    f"l3 AS MATERIALIZED (SELECT session_id, k, list_transform({_layer_sql('h', 16, 10, 7, False)}, lambda v: v / 1e0) AS s FROM l2)",
    f"nn AS MATERIALIZED (SELECT session_id, k, {_softmax_sql('s')} AS p FROM l3)",
)


def _net() -> M.DenseNet:
    sizes = (64, 32, 16, 10)
    weights = [_weights(a, b, 5 + n) for n, (a, b) in enumerate(zip(sizes[:-1], sizes[1:]))]
    return M.DenseNet(CLASSES, weights, [(np.arange(b) % 5 - 2) / 8.0 for b in sizes[1:]])


@register("score_mlp", S.sql(*NET, select=f"SELECT session_id, k, {_columns_sql(10)} FROM nn"))
def score_mlp(spark, sf):
    return M.score(td.vectors(spark, sf), _net(), ["session_id", "k"]).select("session_id", "k", *_columns(10))


@register("average_models", S.sql(*SCORED, *[p.replace("sm AS", "sme AS").replace("FROM sm)", "FROM sme)") for p in ENSEMBLE[1:]],
    """av AS (SELECT pr.session_id, pr.k, list_transform(range(1, 11), lambda j: CASE WHEN pr.k % 4 = 0 THEN pr.p[j] ELSE (pr.p[j] + en.p[j]) / 2 END) AS p
  FROM pr JOIN en ON en.session_id = pr.session_id AND en.k = pr.k)""",
    select=f"SELECT session_id, k, {_columns_sql(10)} FROM av"))
def average_models(spark, sf):
    """Two models, one of them missing on every fourth row."""
    second = M.score(td.vectors(spark, sf), _ensemble(), ["session_id", "k"]).withColumnRenamed("p", "b")
    both = _scored(spark, sf).join(second, ["session_id", "k"]).withColumn("b", F.when(F.col("k") % 4 != 0, F.col("b")))
    return both.select("session_id", "k", M.average_models(F.col("p"), F.col("b")).alias("p")).select("session_id", "k", *_columns(10))


@register("quantise_int8", S.sql(S.LONG, select=f"""SELECT session_id, k, pos, CAST(least(greatest(round(v / 0.0037e0) + 3, -128), 127) AS INTEGER) AS level,
{q('(least(greatest(round(v / 0.0037e0) + 3, -128), 127) - 3) * 0.0037e0', 'back')} FROM lf"""))
def quantise_int8(spark, sf):
    level = M.quantise_int8(F.col("v"), 0.0037, 3)
    rows = td.vectors(spark, sf).select("session_id", "k", F.posexplode("f").alias("pos", "v"))
    return rows.select("session_id", "k", "pos", level.alias("level"), r(M.dequantise_int8(level, 0.0037, 3)).alias("back"))


# --------------------------------------------------------------------------------- fitted models


def _mean_weights(spark, sf):
    """A model table from the data: class means as weights."""
    rows = td.vectors(spark, sf).select("label", F.posexplode("f").alias("pos", "v")).groupBy("label", "pos").agg(F.avg("v").alias("m"))
    packed = rows.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("_p"))
    return packed.select(F.lit("means").alias("model"), F.col("label").alias("class"), F.lit(0.0).alias("intercept"), F.col("_p.m").alias("w"))


IMPORTANCE = "im AS (SELECT pos, avg(abs(m)) AS importance FROM (SELECT label, pos, avg(v) AS m FROM lf GROUP BY ALL) GROUP BY 1)"


@register("feature_importance", S.sql(S.LONG, IMPORTANCE, select=f"SELECT pos, {q('importance', 'importance')} FROM im"))
def feature_importance(spark, sf):
    return rounded(M.feature_importance(_mean_weights(spark, sf)), ["importance"])


@register("importance_top_k", S.sql(S.LONG, IMPORTANCE, select=f"SELECT pos, {q('importance', 'importance')} FROM im ORDER BY im.importance DESC, pos LIMIT 8"))
def importance_top_k(spark, sf):
    return rounded(M.importance_top_k(_mean_weights(spark, sf)), ["importance"])


@register("class_moments", S.sql(
    S.VECTORS, "mm AS MATERIALIZED (SELECT label, count(*) AS n, list_transform(range(1, 65), lambda i: 0) AS z FROM vec GROUP BY 1)",
    "pairs AS (SELECT label, a, b, covar_pop(f[a + 1], f[b + 1]) * count(*) AS s, avg(f[a + 1]) AS m, count(*) AS n FROM vec, (SELECT unnest(range(0, 64)) AS a) p, (SELECT unnest(range(0, 64)) AS b) q WHERE b >= a GROUP BY ALL)",
    select=f"SELECT label, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, {q('m', 'mean')}, {q('s', 'scatter')}, CAST(n AS DOUBLE) AS n FROM pairs"))
def class_moments(spark, sf):
    """Every entry of the merged class statistics; the matrices are of vector length."""
    stats = M.class_moments(td.vectors(spark, sf))
    rows = [
        (label, a, b, float(m.mean[a]), float(m.scatter[a, b]), m.n)
        for (_, label), m in stats.items() for a in range(WIDTH) for b in range(a, WIDTH)
    ]
    return rounded(spark.createDataFrame(rows, "label string, a long, b long, mean double, scatter double, n double"), ["mean", "scatter"])


ALL = "tr AS MATERIALIZED (SELECT 0 AS g, label, f FROM vec)"


@register("fit_lda", S.sql(
    S.VECTORS, ALL, D.pooled("tr", WIDTH, 10), "rw AS MATERIALIZED (SELECT 0 AS g, session_id, k, label, f FROM vec)", D.posterior("ld", "tr", "rw", WIDTH, 10),
    select=f"SELECT session_id, k, label, {_columns_sql(10)} FROM ld"))
def fit_lda(spark, sf):
    features = td.vectors(spark, sf)
    model = M.fit_lda(M.by_class(M.class_moments(features)))
    return M.score(features, model, ["session_id", "k", "label"]).select("session_id", "k", "label", *_columns(10))


@register("fit_qda", S.sql(
    S.VECTORS, ALL, D.quadratic("qd", "tr", "vec", WIDTH, 10, 0.1), select=f"SELECT session_id, k, label, {_columns_sql(10)} FROM qd"))
def fit_qda(spark, sf):
    features = td.vectors(spark, sf)
    model = M.fit_qda(M.by_class(M.class_moments(features)))
    return M.score(features, model, ["session_id", "k", "label"]).select("session_id", "k", "label", *_columns(10))


def _folded(spark, sf):
    features = td.vectors(spark, sf)
    folds = SP.group_kfold(features).drop("n")
    return features.join(folds, "trial_id")


FOLDS = """tz AS (SELECT trial_id, count(*) AS n FROM vec GROUP BY 1),
od AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY n DESC, trial_id DESC) AS pos FROM tz),
gk AS (
  SELECT CAST(0 AS BIGINT) AS pos, CAST(-1 AS BIGINT) AS trial_id, -1 AS fold, [CAST(0 AS BIGINT), 0, 0, 0, 0] AS loads
  UNION ALL
  SELECT o.pos, o.trial_id, CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER),
    list_transform(range(1, 6), lambda j: loads[j] + CASE WHEN j = list_position(loads, list_min(loads)) THEN o.n ELSE 0 END)
  FROM gk JOIN od o ON o.pos = gk.pos + 1),
fv AS MATERIALIZED (SELECT v.*, g.fold FROM vec v JOIN gk g ON g.trial_id = v.trial_id AND g.pos > 0)"""
APART = "tr AS MATERIALIZED (SELECT g.fold AS g, v.label, v.f FROM (SELECT DISTINCT fold FROM fv) g JOIN fv v ON v.fold <> g.fold)"
HELD = "rw AS MATERIALIZED (SELECT fold AS g, session_id, k, label, f FROM fv)"
ACCURACY = "SELECT g AS fold, count(*) AS n, avg(CAST('c' || (list_position(p, list_max(p)) - 1) = label AS INTEGER)) AS accuracy FROM ld GROUP BY 1"


def _blocks_sql() -> str:
    """Posteriors of every specialist, fitted without the row's fold: ``ld0, ld1, …``."""
    parts = []
    for n, at in enumerate(BLOCKS.values()):
        cut, size = f"f[{at[0] + 1}:{at[-1] + 1}]", len(at)
        parts += [
            f"tr{n} AS MATERIALIZED (SELECT g, label, {cut} AS f FROM tr)", D.pooled(f"tr{n}", size, 10),
            f"rw{n} AS MATERIALIZED (SELECT g, session_id, k, label, {cut} AS f FROM rw)", D.posterior(f"ld{n}", f"tr{n}", f"rw{n}", size, 10),
        ]
    return ",\n".join(parts)


@register("out_of_fold_proba", S.sql(
    S.VECTORS, FOLDS, APART, HELD, _blocks_sql(),
    "al AS (SELECT a.session_id, a.k, a.label, a.g AS fold, list_concat(list_concat(a.p, b.p), c.p) AS p FROM ld0 a JOIN ld1 b ON b.k = a.k JOIN ld2 c ON c.k = a.k)",
    select=f"SELECT session_id, k, label, fold, {_columns_sql(30)} FROM al"))
def out_of_fold_proba(spark, sf):
    held, _ = M.out_of_fold_proba(_folded(spark, sf), columns=BLOCKS)
    return held.select("session_id", "k", "label", "fold", *_columns(30))


@register("cross_val_accuracy", S.sql(S.VECTORS, FOLDS, APART, D.pooled("tr", WIDTH, 10), HELD, D.posterior("ld", "tr", "rw", WIDTH, 10), select=ACCURACY))
def cross_val_accuracy(spark, sf):
    return M.cross_val_accuracy(_folded(spark, sf))


@register("leave_one_session_out_accuracy", S.sql(
    S.VECTORS, "fv AS MATERIALIZED (SELECT *, session_id AS fold FROM vec)", APART, D.pooled("tr", WIDTH, 10), HELD, D.posterior("ld", "tr", "rw", WIDTH, 10), select=ACCURACY))
def leave_one_session_out_accuracy(spark, sf):
    return M.cross_val_accuracy(SP.leave_one_session_out(td.vectors(spark, sf)))


@register("fit_ensemble")
def fit_ensemble(spark, sf):
    ensemble = M.fit_ensemble(_folded(spark, sf), columns=BLOCKS)
    return M.score(td.vectors(spark, sf), ensemble, ["session_id", "k", "label"]).select("session_id", "k", "label", *_columns(10))


@register("specialist_cv")
def specialist_cv(spark, sf):
    return M.specialist_cv(_folded(spark, sf), columns=BLOCKS)


@register("lda_project")
def lda_project(spark, sf):
    features = td.vectors(spark, sf)
    model = M.fit_lda(M.by_class(M.class_moments(features)))
    return M.lda_project(features, model)


@register("fit_mlp")
def fit_mlp(spark, sf):
    features = td.vectors(spark, sf)
    net = N.fit_perceptron(features, CLASSES, epochs=60, rate=1e-2)
    return M.score(features, net, ["session_id", "k", "label"]).select("session_id", "k", "label", *_columns(10))


@register("classifier_benchmark")
def classifier_benchmark(spark, sf):
    """Base 69 and base + MPF 105 values of the long sessions' windows, z-scored per session, folds of whole trials."""
    samples = td.numbered_sessions(spark, sf)
    keys = td.labelled(samples).select("session_id", "k", "label", (F.col("y") - 1995).alias("trial_id"))
    path = f"{checkpoint_folder(spark).rstrip('/')}/benchmark-{uuid.uuid4().hex}"
    base = C.session_zscore(written(FE.extract_features(samples).join(keys, ["session_id", "k"]), f"{path}-base"))
    bands = C.session_zscore(written(FE.cross_spectrum(samples).join(keys, ["session_id", "k"]), f"{path}-bands")).select("session_id", "k", F.col("f").alias("m"))
    folds = SP.group_kfold(keys, ["session_id", "trial_id"]).drop("n")
    rows = written(base.join(bands, ["session_id", "k"]).join(folds, ["session_id", "trial_id"]), f"{path}-rows")
    sets = {"base": rows, "base_mpf": rows.withColumn("f", F.concat("f", "m"))}
    return N.classifier_benchmark(sets, ("fist", "hook_em", "open", "rest", "thumbs_up"), stored=True)


def _matrix(spark, sf):
    """The training matrix of the long sessions: labelled windows, transitions left out, features, z-scores."""
    samples = td.numbered_sessions(spark, sf)
    keys = td.labelled(samples).withColumn("trial_id", (F.col("y") - 1995).cast("long"))
    kept = L.drop_transitions(keys).select("session_id", "k", "label", "trial_id")
    windows = W.sliding_windows(samples).select("session_id", "k", "x").join(kept, ["session_id", "k"])
    return WF.training_matrix(windows)


@register("train_sessions")
def train_sessions(spark, sf):
    """Samples → labels → 69 features → z-scores → discriminant, specialists and ensemble: grouped accuracy of each."""
    return rounded(WF.train_models(_matrix(spark, sf)).scores, ["accuracy"])


DEVICE_MODEL = M.LinearModel(("fist", "hook_em", "open", "rest", "thumbs_up"), _weights(5, 69) / 10, (np.arange(5) % 3 - 1) / 4.0)
_SCORES = "list_transform(range(0, 5), lambda r: (r % 3 - 1) / 4e0 + list_sum(list_transform(range(0, 69), lambda c: ((r * 31 + c * 17) % 23 - 11) / 70e0 * z[c + 1])))"


def predict_sql(calibrates: str = "k < 120", scored: str = "true", number: str = "k") -> tuple[str, ...]:
    """Device features to probability vectors: each session in units of its first windows, then the rule-given model."""
    return (
        *SG.DEVICE, f"dv AS MATERIALIZED (SELECT session_id, k, [{', '.join(SG.NAMES)}] AS f FROM ({SG.feature_sql(SG.NAMES, exact=True)}))",
        f"dl AS (SELECT session_id, k, unnest(range(1, 70)) AS pos, unnest(f) AS v FROM dv WHERE {calibrates})",
        "dc AS (SELECT session_id, pos, avg(v) AS mu, greatest(stddev_pop(v), 1e-6) AS sd FROM dl GROUP BY ALL)",
        "dp AS (SELECT session_id, list(mu ORDER BY pos) AS mu, list(sd ORDER BY pos) AS sd FROM dc GROUP BY 1)",
        f"dz AS (SELECT session_id, {number} AS k, list_transform(range(1, 70), lambda n: (f[n] - mu[n]) / sd[n]) AS z FROM dv JOIN dp USING (session_id) WHERE {scored})",
        f"ds AS MATERIALIZED (SELECT session_id, k, {_SCORES} AS s FROM dz)",
        f"fc AS MATERIALIZED (SELECT session_id, k, {_softmax_sql('s')} AS p FROM ds)",
    )


@register("predict_sessions", S.sql(
    *predict_sql(), S.HYST.removeprefix(S.FC).lstrip(",\n"), select=f"SELECT session_id, k, raw, winner, {q('conf', 'conf', 5)}, output FROM hs"))
def predict_sessions(spark, sf):
    """Samples → device features → calibration → probabilities → average → hysteresis."""
    samples = td.short_sessions(spark, sf).drop("y")
    stats = C.rest_calibration(FE.extract_features(samples, continuous=True, first=25))
    calibration = C.to_vectors(stats, ["session_id"], ["mu", "sigma"])
    out = WF.predict_sessions(samples, calibration, [DEVICE_MODEL])
    return rounded(out.withColumn("k", F.col("k").cast("long")), ["conf"], 5)


@register("predict_sessions_voted", S.sql(
    *predict_sql(), S.VOTE.removeprefix(S.FC).lstrip(",\n"),
    select="SELECT session_id, k, winner, rejected, coalesce(majority, -1) AS majority, output FROM vd"))
def predict_sessions_voted(spark, sf):
    """The same with votes and debounce."""
    samples = td.short_sessions(spark, sf).drop("y")
    stats = C.rest_calibration(FE.extract_features(samples, continuous=True, first=25))
    out = WF.predict_sessions(samples, C.to_vectors(stats, ["session_id"], ["mu", "sigma"]), [DEVICE_MODEL], smoother="votes")
    return out.select("session_id", F.col("k").cast("long").alias("k"), "winner", "rejected", F.coalesce("majority", F.lit(-1)).alias("majority"), "output")


@register("stored_model_scores", S.sql(
    S.VECTORS, f"sc AS MATERIALIZED (SELECT *, {_scores_sql('f', 10, WIDTH, 5)} AS s FROM vec)",
    f"pr AS MATERIALIZED (SELECT session_id, k, {_softmax_sql('s')} AS p FROM sc)", select=f"SELECT session_id, k, {_columns_sql(10)} FROM pr"))
def stored_model_scores(spark, sf):
    """Three models saved, the newest single one found, loaded and applied."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/models-{uuid.uuid4().hex}"
    for name, shift in (("older", 2), ("newer", 5), ("ensemble_parts", 9)):
        store.save_model(spark, path, name, _linear(10, WIDTH, shift).table(spark, name), {"channels": [0, 1, 2]})
    name = store.latest_model(spark, path)
    rows, settings = store.load_model(spark, path, name)
    if not (settings["expanded"] and settings["cross_channel"]):
        raise ValueError("settings that follow from the vector's length are missing")
    model = M.LinearModel.from_table(rows, name)
    model = M.LinearModel(CLASSES, *(np.asarray(x)[[model.classes.index(c) for c in CLASSES]] for x in (model.weights, model.intercepts)))
    return M.score(td.vectors(spark, sf), model, ["session_id", "k"]).select("session_id", "k", *_columns(10))
