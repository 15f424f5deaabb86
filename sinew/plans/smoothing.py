"""Queries: output smoothing and the proportional channel."""

from __future__ import annotations

from pyspark.sql import functions as F

from sinew.constants import GESTURES
from sinew.operators import filters as FI
from sinew.operators import proportional as P
from sinew.operators import smooth as SM
from sinew.plans import fragments as S
from sinew.plans.catalog import q, r, register, rounded
from sinew.plans.signals import RECENT
from sinew.sources import testdata as td


@register("ema", S.sql(S.EMA, select="SELECT session_id, k, raw, winner, " + ", ".join(q(f"s[{c + 1}]", f"s{c}") for c in range(5)) + " FROM sm"))
def ema(spark, sf):
    out = SM.ema(td.probabilities(spark, sf), 5)
    return out.select(
        "session_id", "k", SM.winner("p").alias("raw"), SM.winner("s").alias("winner"), *[r(F.col("s")[c]).alias(f"s{c}") for c in range(5)]
    )


@register("smooth_hysteresis", S.sql(S.HYST, select=f"SELECT session_id, k, raw, winner, {q('conf', 'conf')}, output FROM hs"))
def smooth_hysteresis(spark, sf):
    return rounded(SM.smooth_hysteresis(td.probabilities(spark, sf), 5), ["conf"])


@register("smooth_vote_debounce", S.sql(
    S.VOTE, select=f"SELECT session_id, k, raw, winner, {q('conf', 'conf')}, rejected, coalesce(majority, -1) AS majority, {q('confidence', 'confidence')}, output FROM vd"))
def smooth_vote_debounce(spark, sf):
    out = SM.smooth_vote_debounce(td.probabilities(spark, sf), 5)
    return rounded(out.withColumn("majority", F.coalesce("majority", F.lit(-1))), ["conf", "confidence"])


@register("smooth_vote_debounce_no_reject", S.sql(
    S.VOTE.replace("s.conf < 0.40e0", "false"),
    select="SELECT session_id, k, winner, majority, output FROM vd"))
def smooth_vote_debounce_no_reject(spark, sf):
    return SM.smooth_vote_debounce(td.probabilities(spark, sf), 5, reject=0.0).select("session_id", "k", "winner", "majority", "output")


CHANGED = "lag(output) OVER s IS NOT NULL AND lag(output) OVER s <> -1 AND lag(output) OVER s <> output"


@register("stability_stats", S.sql(
    S.HYST, f"c AS (SELECT *, {CHANGED} AS changed FROM hs WINDOW s AS (PARTITION BY session_id ORDER BY k))",
    select=f"""SELECT session_id, count(*) AS predictions, CAST(count_if(changed) AS BIGINT) AS changes, {q('1 - count_if(changed) / count(*)', 'stability')} FROM c GROUP BY 1"""))
def stability_stats(spark, sf):
    return rounded(SM.stability_stats(SM.smooth_hysteresis(td.probabilities(spark, sf), 5)), ["stability"])


@register("raw_vs_smoothed", S.sql(
    S.HYST, select="""SELECT session_id, k, raw, CASE WHEN output = -1 THEN raw ELSE output END AS shown,
CASE WHEN output = -1 THEN false ELSE raw <> output END AS differs FROM hs"""))
def raw_vs_smoothed(spark, sf):
    return SM.raw_vs_smoothed(SM.smooth_hysteresis(td.probabilities(spark, sf), 5))


@register("prediction_events", S.sql(
    S.HYST, select=f"""SELECT session_id, k, {q('conf', 'conf')}, output FROM (SELECT *, lag(output) OVER (PARTITION BY session_id ORDER BY k) AS b FROM hs)
WHERE output <> -1 AND b IS DISTINCT FROM output"""))
def prediction_events(spark, sf):
    out = SM.prediction_events(SM.smooth_hysteresis(td.probabilities(spark, sf), 5))
    return rounded(out.select("session_id", "k", "conf", "output"), ["conf"])


@register("reject_rate_by_run", S.sql(
    S.VOTE, "m AS (SELECT *, CASE WHEN coalesce(lag(output) OVER s, -1) <> output THEN 1 ELSE 0 END AS moved FROM vd WINDOW s AS (PARTITION BY session_id ORDER BY k))",
    "n AS (SELECT *, CAST(sum(moved) OVER (PARTITION BY session_id ORDER BY k) AS BIGINT) AS run FROM m)",
    select=f"SELECT session_id, run, min(k) AS from_k, max(output) AS output, count(*) AS predictions, {q('avg(CAST(rejected AS INTEGER))', 'reject_rate')} FROM n GROUP BY ALL"))
def reject_rate_by_run(spark, sf):
    out = SM.smooth_vote_debounce(td.probabilities(spark, sf), 5)
    return rounded(SM.reject_rate_by_run(out), ["reject_rate"])


# ------------------------------------------------------------------------- proportional channel

LEVELS = """hl AS MATERIALIZED (SELECT session_id, CAST((i - 174) // 25 AS INTEGER) AS k, rms FROM rr WHERE i >= 174 AND (i - 174) % 25 = 0),
th AS MATERIALIZED (SELECT session_id, sqrt(avg(y[1] * y[1])) AS rest_rms, sqrt(avg(y[1] * y[1])) * 2.5e0 AS thr FROM b3 WHERE i >= 0 AND i < 400 GROUP BY 1)"""


@register("flex_threshold", S.sql(S.FA, select=f"SELECT session_id, {q('sqrt(avg(ch3 * ch3))', 'rest_rms')}, {q('sqrt(avg(ch3 * ch3)) * 2.5e0', 'threshold')} FROM fa GROUP BY 1"))
def flex_threshold(spark, sf):
    return rounded(P.flex_threshold(td.short_sessions(spark, sf)), ["rest_rms", "threshold"])


@register("flex_threshold_filtered", S.sql(S.FA, RECENT, LEVELS, select=f"SELECT session_id, {q('rest_rms', 'rest_rms', 5)}, {q('thr', 'threshold', 5)} FROM th"))
def flex_threshold_filtered(spark, sf):
    filtered = FI.bandpass_stream(td.short_sessions(spark, sf), ["ch3"])
    return rounded(P.flex_threshold(filtered, clip=400, filtered=True), ["rest_rms", "threshold"], 5)


# Thresholds near the middle of a session's own levels, so states change.
FLEX = """tm AS MATERIALIZED (SELECT session_id, 0.9e0 * avg(rms) AS thr FROM hl GROUP BY 1),
fx AS (
  SELECT h.session_id, h.k, h.rms, t.thr, CASE WHEN h.rms > 1.3e0 * t.thr THEN 'flex' ELSE 'rest' END AS state FROM hl h JOIN tm t USING (session_id) WHERE h.k = 0
  UNION ALL
  SELECT h.session_id, h.k, h.rms, f.thr, CASE WHEN f.state = 'rest' AND h.rms > 1.3e0 * f.thr THEN 'flex' WHEN f.state = 'flex' AND h.rms < f.thr THEN 'rest' ELSE f.state END
  FROM fx f JOIN hl h ON h.session_id = f.session_id AND h.k = f.k + 1),
fs AS MATERIALIZED (SELECT * FROM fx)"""


def _states(spark, sf):
    levels = FI.hop_levels(td.short_sessions(spark, sf)).select("session_id", "k", "rms")
    limits = levels.groupBy("session_id").agg((0.9 * F.avg("rms")).alias("threshold"))
    return P.flex_state(levels, limits)


@register("flex_state", S.sql(S.FA, RECENT, LEVELS, FLEX, select=f"SELECT session_id, k, {q('rms', 'rms', 5)}, state FROM fs"))
def flex_state(spark, sf):
    return rounded(_states(spark, sf), ["rms"], 5)


@register("state_changes", S.sql(
    S.FA, RECENT, LEVELS, FLEX, select="""SELECT session_id, k, state, CASE state WHEN 'flex' THEN 140e0 ELSE 60e0 END AS angle
FROM (SELECT *, lag(state) OVER (PARTITION BY session_id ORDER BY k) AS b FROM fs) WHERE b IS DISTINCT FROM state"""))
def state_changes(spark, sf):
    out = SM.prediction_events(_states(spark, sf), "state", none="")
    return out.select("session_id", "k", "state", P.state_angle(F.col("state")).alias("angle"))


@register("activation_level", S.sql(
    S.FA, RECENT, LEVELS, "rg AS (SELECT session_id, quantile_cont(rms, 0.1) AS lo, quantile_cont(rms, 0.9) AS hi FROM hl GROUP BY 1)",
    "lv AS (SELECT h.session_id, h.k, least(greatest((rms - 40e0) / (60e0 - 40e0), 0e0), 1e0) AS level FROM hl h)",
    select=f"SELECT session_id, k, {q('CASE WHEN level < 0.05e0 THEN 0e0 ELSE level END', 'level', 5)} FROM lv"))
def activation_level(spark, sf):
    levels = FI.hop_levels(td.short_sessions(spark, sf))
    return levels.select("session_id", "k", r(P.activation_level(F.col("rms"), F.lit(40.0), F.lit(60.0)), 5).alias("level"))


# Long level sequences from the events: one activation value per row.
LEVEL = S.EVENTS + """,
al AS MATERIALIZED (SELECT session_id, k, CASE WHEN l < 0.05e0 THEN 0e0 ELSE l END AS level FROM (
  SELECT session_id, k, least(greatest((value * CASE WHEN k % 24 < 12 THEN 1 ELSE 0 END - 2e0) / (30e0 - 2e0), 0e0), 1e0) AS l FROM ev)),
le AS (
  SELECT session_id, k, (1 - 0.8e0) * level AS e FROM al WHERE k = 0
  UNION ALL SELECT a.session_id, a.k, 0.8e0 * le.e + (1 - 0.8e0) * a.level FROM le JOIN al a ON a.session_id = le.session_id AND a.k = le.k + 1),
lm AS MATERIALIZED (SELECT * FROM le)"""
SLEW = LEVEL + """,
sw AS (
  SELECT session_id, CAST(-1 AS BIGINT) AS k, 60e0 AS angle, -1e0 AS sent, false AS emit FROM lm WHERE k = 0
  UNION ALL
  SELECT session_id, k, angle, CASE WHEN abs(angle - sent) >= 0.5e0 THEN angle ELSE sent END, abs(angle - sent) >= 0.5e0 FROM (
    SELECT l.session_id, l.k, least(greatest(s.angle + least(greatest(60e0 + 80e0 * l.e - s.angle, -6e0), 6e0), 60e0), 140e0) AS angle, s.sent
    FROM sw s JOIN lm l ON l.session_id = s.session_id AND l.k = s.k + 1))"""


def activations(spark, sf):
    gated = F.col("value") * F.when(F.col("k") % 24 < 12, 1).otherwise(0)
    return td.event_rows(spark, sf).select("session_id", "k", P.activation_level(gated, F.lit(2.0), F.lit(30.0)).alias("level"))


def _levels(spark, sf):
    return P.level_ema(activations(spark, sf))


@register("level_ema", S.sql(LEVEL, select=f"SELECT session_id, k, {q('e', 'level_ema')} FROM lm"))
def level_ema(spark, sf):
    return rounded(_levels(spark, sf).drop("level"), ["level_ema"])


@register("slew_limit", S.sql(SLEW, select=f"SELECT session_id, k, {q('angle', 'angle')} FROM sw WHERE k >= 0"))
def slew_limit(spark, sf):
    return rounded(P.slew_limit(_levels(spark, sf)), ["angle"])


@register("write_filter", S.sql(SLEW, select=f"SELECT session_id, k, {q('angle', 'angle')} FROM sw WHERE emit"))
def write_filter(spark, sf):
    return rounded(P.write_filter(P.slew_limit(_levels(spark, sf))), ["angle"])


_POSES = {
    "fist": (155, 155, 180, 165, 150), "hook_em": (155, 45, 180, 165, 25), "open": (65, 45, 45, 30, 25),
    "rest": (110, 100, 112.5, 97.5, 87.5), "thumbs_up": (65, 155, 180, 165, 150),
}
POSE = "pose(gesture, joint, angle) AS (VALUES " + ", ".join(
    f"('{g}', '{j}', {a}e0)" for g, angles in _POSES.items() for j, a in zip(("thumb", "index", "middle", "ring", "pinky"), angles)) + ")"


def _gestures(spark, sf):
    names = F.array(*[F.lit(g) for g in GESTURES])
    return td.event_rows(spark, sf).select("session_id", "k", F.get(names, (F.col("k") % 5).cast("int")).alias("gesture"))


GESTURE = "CASE k % 5 " + " ".join(f"WHEN {n} THEN '{g}'" for n, g in enumerate(GESTURES)) + " END"


@register("gesture_pose", S.sql(S.EVENTS, POSE, select=f"SELECT session_id, k, e.gesture, joint, CAST(angle AS DOUBLE) AS angle FROM (SELECT *, {GESTURE} AS gesture FROM ev) e JOIN pose USING (gesture)"))
def gesture_pose(spark, sf):
    return P.gesture_pose(_gestures(spark, sf)).select("session_id", "k", "gesture", "joint", "angle")


@register("angle_to_duty", S.sql(S.EVENTS, select="SELECT session_id, k, CAST(floor(110e0 + least(greatest(value * 3 - 10, 0e0), 180e0) / 180e0 * 400) AS INTEGER) AS duty FROM ev"))
def angle_to_duty(spark, sf):
    return td.event_rows(spark, sf).select("session_id", "k", P.angle_to_duty(F.col("value") * 3 - 10).alias("duty"))
