"""Queries: schedules, labels, runs and onset alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from sinew.operators import labels as L
from sinew.operators import filters as FI
from sinew.operators import windows as W
from sinew.plans import fragments as S
from sinew.plans.catalog import q, r, register, rounded
from sinew.sources import store
from sinew.sources import testdata as td

GESTURES = ("open", "fist", "hook_em", "thumbs_up")


def _schedule_sql(keys: str, hold: float, rest: float, reps: int = 3) -> str:
    """Prompts listed one after the other and summed up."""
    rows = [("rest", rest)]
    for _ in range(reps):
        for g in GESTURES:
            rows += [(g, hold), ("rest", rest)]
    values = ", ".join(f"({n}, '{g}', {d}e0)" for n, (g, d) in enumerate(rows))
    return f"""plan(trial_id, gesture, duration) AS (VALUES {values}),
sched AS MATERIALIZED (SELECT session_id, CAST(trial_id AS INTEGER) AS trial_id, gesture, CAST(duration AS DOUBLE) AS duration,
  coalesce(sum(duration) OVER (PARTITION BY session_id ORDER BY trial_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM ({keys}) CROSS JOIN plan)"""


@register("prompt_schedule", S.sql(
    _schedule_sql("SELECT DISTINCT l_suppkey AS session_id FROM lineitem", 3, 2),
    select=f"SELECT session_id, trial_id, gesture, {q('start', 'start')}, duration FROM sched"))
def prompt_schedule(spark, sf):
    sessions = td.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("session_id")).distinct()
    return rounded(L.prompt_schedule(sessions, GESTURES), ["start"])


# Six seconds of samples per long session: prompts of a few hundred milliseconds. Offsets keep the
# comparison away from windows that start exactly on a prompt.
HOLD, REST, SHIFT = 0.3, 0.2, 0.1503
FB_KEYS = "SELECT DISTINCT session_id FROM lw"


def _short_schedule(windows):
    return L.prompt_schedule(windows.select("session_id").distinct(), GESTURES, hold=HOLD, rest=REST)


@register("label_windows", S.sql(
    S.FB, S.LABELLED, _schedule_sql(FB_KEYS, HOLD, REST),
    select=f"""SELECT lw.session_id, lw.k, coalesce(gesture, 'unlabeled') AS label, coalesce(trial_id, -1) AS trial_id
FROM lw LEFT JOIN sched ON sched.session_id = lw.session_id AND start_time + {SHIFT}e0 >= start AND start_time + {SHIFT}e0 < start + duration"""))
def label_windows(spark, sf):
    windows = td.labelled_windows(spark, sf).drop("label", "y")
    labelled = L.label_windows(windows, _short_schedule(windows), shift=SHIFT, width=1.0)
    return labelled.select("session_id", "k", "label", "trial_id")


@register("prompt_timeline", S.sql(
    S.FB, S.LABELLED, _schedule_sql(FB_KEYS, HOLD, REST),
    "nx AS (SELECT *, lead(gesture) OVER (PARTITION BY session_id ORDER BY trial_id) AS nxt, sum(duration) OVER (PARTITION BY session_id) AS total FROM sched)",
    select=f"""SELECT lw.session_id, k, trial_id, gesture, {q('start + duration - t', 'time_left')},
CASE WHEN gesture = 'rest' THEN nxt END AS next_gesture, {q('least(1e0, t / (SELECT max(total) FROM nx))', 'progress')}
FROM (SELECT *, start_time + 0.0003e0 AS t FROM lw) lw LEFT JOIN nx ON nx.session_id = lw.session_id AND t >= start AND t < start + duration"""))
def prompt_timeline(spark, sf):
    points = td.labelled_windows(spark, sf).select("session_id", "k", (F.col("start_time") + 0.0003).alias("t"))
    out = L.prompt_timeline(points, _short_schedule(points), width=1.0)
    return rounded(out.drop("t"), ["time_left", "progress"])


@register("label_transitions", S.sql(
    S.FB, S.LABELLED, S.RUNS,
    select="""SELECT session_id, k, from_label, label FROM (
SELECT *, lag(label) OVER (PARTITION BY session_id ORDER BY k) AS from_label FROM lw) WHERE from_label <> label"""))
def label_transitions(spark, sf):
    return L.label_transitions(td.labelled_windows(spark, sf))


@register("label_runs", S.sql(
    S.FB, S.LABELLED, S.RUNS,
    "e AS (SELECT session_id, run, min(k) AS run_k, min(start_time) AS a, max(end_time) AS b FROM runs GROUP BY ALL)",
    select=f"""SELECT session_id, k, label, CAST(run AS BIGINT) AS run, run_k, {q('a', 'run_start')}, {q('b', 'run_end')}
FROM runs JOIN e USING (session_id, run)"""))
def label_runs(spark, sf):
    runs = L.with_runs(td.labelled_windows(spark, sf))
    return rounded(runs.select("session_id", "k", "label", "run", "run_k", "run_start", "run_end"), ["run_start", "run_end"])


@register("forward_shift", S.sql(
    S.FB, S.LABELLED, S.RUNS,
    select="""SELECT session_id, k, CASE WHEN label <> 'rest' AND row_number() OVER (PARTITION BY session_id, run ORDER BY k) <= 4
THEN 'rest' ELSE label END AS label FROM runs"""))
def forward_shift(spark, sf):
    return L.forward_shift(td.labelled_windows(spark, sf)).select("session_id", "k", "label")


DROPPED = """kept AS MATERIALIZED (SELECT r.* FROM runs r JOIN (SELECT session_id, run, min(start_time) AS a, max(end_time) AS b FROM runs GROUP BY ALL) e
  USING (session_id, run) WHERE start_time >= a + 200 / 1000e0 AND end_time <= b - 150 / 1000e0)"""


@register("drop_transitions", S.sql(S.FB, S.LABELLED, S.RUNS, DROPPED, select="SELECT session_id, k, label FROM kept"))
def drop_transitions(spark, sf):
    return L.drop_transitions(td.labelled_windows(spark, sf)).select("session_id", "k", "label")


@register("encode_labels", S.sql(
    S.FB, S.LABELLED, select="SELECT session_id, k, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM lw"))
def encode_labels(spark, sf):
    return L.encode_labels(td.labelled_windows(spark, sf).select("session_id", "k", "label"))


# --------------------------------------------------------------------------------------- onset

ENV = """env AS MATERIALIZED (SELECT session_id, i, ts, sqrt((ch0*ch0 + ch1*ch1 + ch2*ch2 + ch3*ch3) / 4) AS env FROM fb),
bd AS MATERIALIZED (SELECT session_id, k, label, start_time AS prompt_time, CAST(k AS BIGINT) * 25 AS prompt_i FROM (
  SELECT *, lag(label) OVER (PARTITION BY session_id ORDER BY k) AS p FROM lw) WHERE p <> label),
bs AS MATERIALIZED (SELECT bd.*, (SELECT avg(env) FROM env e WHERE e.session_id = bd.session_id AND e.i >= prompt_i - 200 AND e.i < prompt_i) AS base_mean,
  (SELECT stddev_pop(env) FROM env e WHERE e.session_id = bd.session_id AND e.i >= prompt_i - 200 AND e.i < prompt_i) AS base_std FROM bd),
onset AS MATERIALIZED (SELECT *, coalesce((SELECT min(ts) FROM env e WHERE e.session_id = bs.session_id AND e.i >= prompt_i AND e.i < prompt_i + 2000
  AND env > base_mean + 2 * base_std), prompt_time + 0.3e0) AS onset FROM bs)"""


def _envelope(spark, sf):
    return _enveloped(td.long_sessions(spark, sf))


def _enveloped(samples):
    return samples.select("session_id", "i", "ts", FI.rms_across_channels().alias("env"))


@register("onset_baseline", S.sql(
    S.FB, S.LABELLED, ENV, select=f"SELECT session_id, k, label, prompt_i, {q('base_mean', 'base_mean')}, {q('base_std', 'base_std')} FROM bs"))
def onset_baseline(spark, sf):
    based = L.onset_baseline(L.boundaries(td.labelled_windows(spark, sf)), _envelope(spark, sf), size=512)
    return rounded(based.drop("prompt_time"), ["base_mean", "base_std"])


@register("detect_onset", S.sql(S.FB, S.LABELLED, ENV, select=f"SELECT session_id, k, label, {q('onset', 'onset')} FROM onset"))
def detect_onset(spark, sf):
    found = L.detect_onset(L.boundaries(td.labelled_windows(spark, sf)), _envelope(spark, sf))
    return rounded(found.select("session_id", "k", "label", "onset"), ["onset"])


# Onsets of different delay per prompt, some later than the next prompt's.
LATE = "prompt_time + 0.0004 + ((k * 7919) % 11) * 0.15"


@register("apply_boundaries", S.sql(
    S.FB, S.LABELLED, ENV,
    f"late AS (SELECT session_id, k, label, {LATE.replace('0.0004', '0.0004e0').replace('0.15', '0.15e0')} AS onset FROM bd)",
    "eff AS MATERIALIZED (SELECT *, max(onset) OVER (PARTITION BY session_id ORDER BY k) AS eff FROM late)",
    select="""SELECT lw.session_id, lw.k, lw.label, coalesce(
  (SELECT arg_max(e.label, e.k) FROM eff e WHERE e.session_id = lw.session_id AND e.eff <= lw.start_time),
  (SELECT arg_min(f.label, f.k) FROM lw f WHERE f.session_id = lw.session_id)) AS aligned_label FROM lw"""))
def apply_boundaries(spark, sf):
    windows = td.labelled_windows(spark, sf)
    late = L.boundaries(windows).withColumn("onset", F.expr(LATE.replace("0.0004", "0.0004D").replace("0.15", "0.15D")))
    return L.apply_boundaries(windows, late, width=1.0).select("session_id", "k", "label", "aligned_label")


@register("align_to_onset", S.sql(
    S.FB, S.LABELLED, ENV, "eff AS MATERIALIZED (SELECT *, max(onset) OVER (PARTITION BY session_id ORDER BY k) AS eff FROM onset)",
    select="""SELECT lw.session_id, lw.k, lw.label, coalesce(
  (SELECT arg_max(e.label, e.k) FROM eff e WHERE e.session_id = lw.session_id AND e.eff <= lw.start_time),
  (SELECT arg_min(f.label, f.k) FROM lw f WHERE f.session_id = lw.session_id)) AS aligned_label FROM lw"""))
def align_to_onset(spark, sf):
    samples = td.numbered_sessions(spark, sf)
    aligned = L.align_to_onset(td.labelled(samples), _enveloped(samples))
    return aligned.select("session_id", "k", "label", "aligned_label")


@register("expected_label_per_hop", S.sql(
    S.FB, S.LABELLED, S.RUNS, DROPPED,
    "hops AS (SELECT session_id, unnest(range(2000, n - 150 + 1, 25)) AS hop_i FROM (SELECT session_id, count(*) AS n FROM fb GROUP BY 1))",
    select="""SELECT h.session_id, h.hop_i, coalesce((SELECT arg_min(label, (abs(d.k * 25 - h.hop_i - 7), d.k)) FROM kept d
  WHERE d.session_id = h.session_id AND abs(d.k * 25 - h.hop_i - 7) <= 25), 'rest') AS label FROM hops h"""))
def expected_label_per_hop(spark, sf):
    samples = td.long_sessions(spark, sf)
    kept = L.drop_transitions(td.labelled_windows(spark, sf))
    placed = kept.select("session_id", (F.col("k").cast("long") * 25 - 7).alias("start_i"), "label")
    return L.expected_label_per_hop(W.session_lengths(samples), placed)


# -------------------------------------------------------------------------------- session store


@register("session_catalog", S.sql(
    S.FB, S.LABELLED,
    select=f"""SELECT session_id, count(*) AS num_windows, {q('min(start_time)', 'first_time')}, {q('max(end_time)', 'last_time')},
string_agg(DISTINCT label, ',' ORDER BY label) AS gestures FROM lw GROUP BY 1"""))
def session_catalog(spark, sf):
    return rounded(store.session_catalog(td.labelled_windows(spark, sf)), ["first_time", "last_time"])


@register("session_samples", S.sql(
    S.FA, S.windows(), select=f"""SELECT session_id, k, count(*) AS n, {q('start_time', 'first_t')}, {q('start_time + 149 / 1000e0', 'last_t')},
{q('list_sum(x1)', 'sum1')} FROM w GROUP BY session_id, k, start_time, x1""".replace("count(*)", "CAST(150 AS BIGINT)")))
def session_samples(spark, sf):
    rows = store.session_samples(W.sliding_windows(td.short_sessions(spark, sf)))
    return rows.groupBy("session_id", "k").agg(
        F.count("*").alias("n"), r(F.min("t")).alias("first_t"), r(F.max("t")).alias("last_t"), r(F.sum("ch1")).alias("sum1")
    )


@register("combine_training", S.sql(
    S.FB, S.LABELLED, S.RUNS, DROPPED,
    "per AS (SELECT session_id, max(CASE WHEN session_id % 3 = 1 THEN k ELSE y - 1995 END) + 1 AS n FROM kept GROUP BY 1)",
    "o AS (SELECT session_id, coalesce(sum(n) OVER (ORDER BY session_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM per)",
    select="""SELECT session_id, k, label, CAST(CASE WHEN session_id % 3 = 1 THEN k ELSE y - 1995 END + off AS BIGINT) AS trial_id,
CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM kept JOIN o USING (session_id)"""))
def combine_training(spark, sf):
    """Sessions without trial ids get one trial per window; here every third session has none."""
    samples = td.numbered_sessions(spark, sf)
    keys = td.labelled(samples)
    trial = F.when(F.col("session_id") % 3 != 1, F.col("y") - 1995)
    windows = W.sliding_windows(samples).select("session_id", "k", "x")
    rows = keys.withColumn("trial_id", trial).drop("y").join(windows, ["session_id", "k"])
    return store.combine_training(rows).select("session_id", "k", "label", "trial_id", "label_id")
