"""Queries: comparing labels, features and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from sinew.operators import calibrate as C
from sinew.operators import evaluate as EV
from sinew.operators import features as FE
from sinew.operators import models as M
from sinew.operators import smooth as SM
from sinew.operators import windows as W
from sinew.plans import fragments as S
from sinew.plans import signals as SG
from sinew.plans.catalog import q, r, register, rounded
from sinew.plans.models import CLASSES, SCORED, _scored
from sinew.sources import testdata as td

# Scores by rule on labelled vectors: predicted class against label.
PREDICTED = (*SCORED, "pd AS MATERIALIZED (SELECT session_id, k, label, CASE WHEN k % 3 = 0 THEN label ELSE 'c' || (list_position(p, list_max(p)) - 1) END AS predicted FROM pr)")


def _predicted(spark, sf):
    guess = F.when(F.col("k") % 3 == 0, F.col("label")).otherwise(M.predict_label(F.col("p"), CLASSES))
    return _scored(spark, sf).select("session_id", "k", "label", guess.alias("predicted"))


@register("accuracy", S.sql(*PREDICTED, select=f"SELECT count(*) AS n, {q('avg(CAST(label = predicted AS INTEGER))', 'accuracy')} FROM pd"))
def accuracy(spark, sf):
    return rounded(EV.accuracy(_predicted(spark, sf)), ["accuracy"])


REPORT = """cl AS (SELECT DISTINCT label FROM (SELECT label FROM pd UNION ALL SELECT predicted FROM pd)),
ct AS (SELECT label, (SELECT count(*) FROM pd WHERE pd.label = cl.label) AS support, (SELECT count(*) FROM pd WHERE predicted = cl.label) AS claimed,
  (SELECT count(*) FROM pd WHERE pd.label = cl.label AND predicted = cl.label) AS hit FROM cl),
pq AS (SELECT label, CASE WHEN claimed > 0 THEN hit / claimed ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall, support FROM ct),
rp AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pq),
ra AS (SELECT label, precision, recall, f1, support FROM rp
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM rp
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM rp)"""


@register("classification_report", S.sql(
    *PREDICTED, REPORT, select=f"SELECT label, {q('precision', 'precision')}, {q('recall', 'recall')}, {q('f1', 'f1')}, CAST(support AS BIGINT) AS support FROM ra"))
def classification_report(spark, sf):
    return rounded(EV.classification_report(_predicted(spark, sf)), ["precision", "recall", "f1"])


@register("confusion_matrix", S.sql(
    *PREDICTED, select="SELECT label, " + ", ".join(f"CAST(count_if(predicted = '{c}') AS BIGINT) AS {c}" for c in CLASSES) + " FROM pd GROUP BY 1"))
def confusion_matrix(spark, sf):
    return EV.confusion_matrix(_predicted(spark, sf), CLASSES)


# Two versions of the vectors: the second with small errors that grow with the position.
SECOND = S.LONG + """,
ab AS MATERIALIZED (SELECT session_id, k, pos, v AS b, v + 0.0005e0 * pos * CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END AS a FROM lf),
dr AS MATERIALIZED (SELECT pos, avg(abs(a - b)) / (stddev_pop(b) + 1e-12) AS drift, avg(a) - avg(b) AS shift FROM ab GROUP BY 1)"""


def _pair(spark, sf):
    b = td.vectors(spark, sf)
    sign = F.when(F.col("k") % 2 == 0, 1).otherwise(-1)
    return b.withColumn("f", F.transform("f", lambda v, j: v + 0.0005 * j * sign)), b


@register("feature_drift", S.sql(SECOND, select=f"SELECT pos, {q('drift', 'drift')}, {q('shift', 'shift')} FROM dr"))
def feature_drift(spark, sf):
    return rounded(EV.feature_drift(*_pair(spark, sf)), ["drift", "shift"])


@register("drift_summary", S.sql(
    SECOND, select=f"SELECT {q('median(drift)', 'median')}, {q('max(drift)', 'max')}, arg_max(pos, drift) AS worst_pos, CAST(count_if(drift > 0.01e0) AS BIGINT) AS above FROM dr"))
def drift_summary(spark, sf):
    return rounded(EV.drift_summary(EV.feature_drift(*_pair(spark, sf))), ["median", "max"])


@register("worst_features", S.sql(SECOND, select=f"SELECT pos, {q('drift', 'drift')}, {q('shift', 'shift')} FROM dr ORDER BY dr.drift DESC LIMIT 12"))
def worst_features(spark, sf):
    return rounded(EV.worst_features(EV.feature_drift(*_pair(spark, sf))), ["drift", "shift"])


DRIFTED = (*SCORED, "p2 AS MATERIALIZED (SELECT session_id, k, p AS a, list_transform(range(1, 11), lambda j: 0.9e0 * p[j] + 0.1e0 * p[11 - j]) AS b FROM pr)")


def _score_pair(spark, sf):
    a = _scored(spark, sf).select("session_id", "k", "p")
    mixed = F.zip_with("p", F.reverse("p"), lambda x, y: 0.9 * x + 0.1 * y)
    return a, a.withColumn("p", mixed)


@register("score_drift", S.sql(
    *DRIFTED, select=f"""SELECT count(*) AS n, {q('max(list_max(list_transform(range(1, 11), lambda j: abs(a[j] - b[j]))))', 'max_diff')},
{q('avg(CAST(list_position(a, list_max(a)) = list_position(b, list_max(b)) AS INTEGER))', 'agreement')}, {q('avg(list_max(a))', 'conf_a')}, {q('avg(list_max(b))', 'conf_b')} FROM p2"""))
def score_drift(spark, sf):
    return rounded(EV.score_drift(*_score_pair(spark, sf)), ["max_diff", "agreement", "conf_a", "conf_b"])


@register("winner_counts", S.sql(*SCORED, select="SELECT CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS class_id, count(*) AS n FROM pr GROUP BY 1"))
def winner_counts(spark, sf):
    return EV.winner_counts(_scored(spark, sf))


@register("scale_check", S.sql(
    S.CLASS_STATS, "tr AS (SELECT pos, avg(sigma) AS sigma_train FROM st GROUP BY 1)",
    select=f"SELECT session_id, {q('max(abs(sigma - sigma_train) / (abs(sigma_train) + 1e-9))', 'max_rel')}, max(abs(sigma - sigma_train) / (abs(sigma_train) + 1e-9)) < 1e-5 AS ok FROM st JOIN tr USING (pos) GROUP BY 1"))
def scale_check(spark, sf):
    features = td.vectors(spark, sf)
    return rounded(EV.scale_check(C.session_statistics(features), C.training_stats(features)), ["max_rel"])


@register("label_counts", S.sql(S.FB, S.LABELLED, select="SELECT session_id, label, count(*) AS windows FROM lw GROUP BY ALL"))
def label_counts(spark, sf):
    return EV.label_counts(td.labelled_windows(spark, sf))


@register("feature_summary", S.sql(
    *SG.RAW4, select=" UNION ALL ".join(
        f"SELECT '{key}' AS name, {q(f'min(CAST({key} AS DOUBLE))', 'low')}, {q(f'max(CAST({key} AS DOUBLE))', 'high')}, {q(f'avg(CAST({key} AS DOUBLE))', 'mean')}, {q(f'stddev_pop(CAST({key} AS DOUBLE))', 'std')} FROM td"
        for key in ("rms", "wl", "zc", "ssc"))))
def feature_summary(spark, sf):
    """Over all four channels, windows and sessions."""
    options = FE.FeatureOptions.td4(channels=(0, 1, 2, 3))
    rows = FE.long_form(FE.extract_features(td.short_sessions(spark, sf), options), options)
    named = rows.select(F.element_at(F.split("name", "_"), -1).alias("name"), "value")
    return rounded(EV.feature_summary(named), ["low", "high", "mean", "std"])


@register("label_channel_std", S.sql(
    S.FB, S.LABELLED, S.windows("fb", channels=(0,)),
    select=f"SELECT session_id, label, {q('stddev_pop(v)', 'std')} FROM (SELECT session_id, label, unnest(x0) AS v FROM w JOIN lw USING (session_id, k)) GROUP BY ALL"))
def label_channel_std(spark, sf):
    windows = W.sliding_windows(td.long_sessions(spark, sf), columns=("ch0",))
    labels = td.labelled_windows(spark, sf).select("session_id", "k", "label")
    return rounded(EV.label_channel_std(windows.join(labels, ["session_id", "k"])), ["std"])


@register("histogram", S.sql(
    S.VECTORS, "e AS (SELECT min(f[1]) AS lo, max(f[1]) AS hi FROM vec)",
    select="SELECT label, CAST(least(floor((f[1] - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM vec, e GROUP BY ALL"))
def histogram(spark, sf):
    rows = td.vectors(spark, sf).select("label", F.col("f")[0].alias("axis"))
    return EV.histogram(rows, "axis", 20, ["label"])


SWITCH = """tb AS MATERIALIZED (SELECT session_id, k, arg_min(raw, k) OVER (PARTITION BY session_id, k // 8) AS label, output FROM hs),
tc AS (SELECT *, lag(label) OVER s IS NOT NULL AND lag(label) OVER s <> label AS changed,
  lag(output) OVER s IS NOT NULL AND lag(output) OVER s <> -1 AND lag(output) OVER s <> output AS switched FROM tb WINDOW s AS (PARTITION BY session_id ORDER BY k)),
tr AS (SELECT session_id, CAST(count_if(changed) AS BIGINT) AS true_changes, CAST(count_if(switched) AS BIGINT) AS switches,
  avg(CASE WHEN NOT changed AND output <> -1 THEN CAST(label = output AS INTEGER) END) AS steady FROM tc GROUP BY 1)"""


@register("switch_ratio", S.sql(
    S.HYST, SWITCH, select=f"SELECT session_id, true_changes, switches, {q('steady', 'steady_accuracy')}, {q('switches / true_changes', 'ratio')} FROM tr"))
def switch_ratio(spark, sf):
    outputs = SM.smooth_hysteresis(td.probabilities(spark, sf), 5)
    truth = outputs.groupBy("session_id", F.floor(F.col("k") / 8).alias("b")).agg(F.min_by("raw", "k").alias("label"))
    rows = outputs.withColumn("b", F.floor(F.col("k") / 8)).join(truth, ["session_id", "b"]).select("session_id", "k", "label", "output")
    return rounded(EV.switch_ratio(rows), ["steady_accuracy", "ratio"])


@register("value_range", S.sql(
    S.FA, "e AS (SELECT session_id, min(least(ch0, ch1, ch2, ch3)) AS low, max(greatest(ch0, ch1, ch2, ch3)) AS high FROM fa GROUP BY 1)",
    select=f"SELECT session_id, {q('low', 'low')}, {q('high', 'high')}, {q('low - (high - low) * 0.05e0', 'axis_low')}, {q('high + (high - low) * 0.05e0', 'axis_high')} FROM e"))
def value_range(spark, sf):
    return rounded(EV.value_range(td.short_sessions(spark, sf), ("ch0", "ch1", "ch2", "ch3")), ["low", "high", "axis_low", "axis_high"])
