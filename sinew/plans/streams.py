"""Queries: the streaming operators, held against the same SQL as their batch versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sinew.operators.features import by_name
from sinew.plans import fragments as S
from sinew.plans import models as MO
from sinew.plans import signals as SG
from sinew.plans import smoothing as SM
from sinew.plans import stores as ST
from sinew.plans.catalog import q, r, register, rounded
from sinew.sources import store
from sinew.sources import testdata as td
from sinew.session import settle
from sinew.streaming import live as LV
from sinew.streaming import outputs as LO
from sinew.streaming import runs as RN


def _slices(df, order: str, edges):
    """The whole table in consecutive ranges of ``order``."""
    df = settle(df)
    bounds = [None, *edges, None]
    for low, high in zip(bounds[:-1], bounds[1:]):
        part = df
        if low is not None:
            part = part.filter(F.col(order) >= low)
        if high is not None:
            part = part.filter(F.col(order) < high)
        yield part


def _closed(slices, rows, operator):
    """Append mode: windows come out as the watermark passes them, the last ones after a heartbeat."""
    out = RN.replay([*slices, LV.heartbeat(rows)], operator)
    return out.filter("session_id IS NOT NULL")


@register("stream_windows", S.sql(S.FA, S.windows(), select=SG.CHECKS))
def stream_windows(spark, sf):
    samples = td.short_sessions(spark, sf).drop("y")
    return SG._checks(RN.replay(_slices(samples, "i", [137, 400]), LV.stream_windows))


@register("stream_features", S.sql(*SG._all_parts(SG.AR, SG.SPECTRUM, SG.CROSS), select=SG.feature_sql(SG.NAMES)))
def stream_features(spark, sf):
    samples = td.short_sessions(spark, sf).drop("y")
    out = RN.replay(_slices(samples, "i", [137, 400]), LV.stream_features)
    return SG._named(out, SG.FULL, SG.NAMES)


@register("stream_smooth", S.sql(S.HYST, select=f"SELECT session_id, k, winner, {q('conf', 'conf')}, output FROM hs"))
def stream_smooth(spark, sf):
    proba = td.probabilities(spark, sf).select("session_id", "k", "p")
    return rounded(RN.replay(_slices(proba, "k", [13, 40]), LV.stream_smooth), ["conf"])


@register("stream_events", S.sql(
    S.HYST, select="""SELECT session_id, k, output FROM (SELECT *, lag(output) OVER (PARTITION BY session_id ORDER BY k) AS b FROM hs)
WHERE output <> -1 AND b IS DISTINCT FROM output"""))
def stream_events(spark, sf):
    """Only changes of the output."""
    proba = td.probabilities(spark, sf).select("session_id", "k", "p")
    out = RN.replay(_slices(proba, "k", [13, 40]), lambda s: LV.stream_smooth(s, on_change=True))
    return out.select("session_id", "k", "output")


@register("stream_vote_debounce", S.sql(
    S.VOTE, select=f"SELECT session_id, k, raw, winner, {q('conf', 'conf')}, rejected, coalesce(majority, -1) AS majority, {q('confidence', 'confidence')}, output FROM vd"))
def stream_vote_debounce(spark, sf):
    """The SQL of the batch query: votes and debounce over three triggers."""
    proba = td.probabilities(spark, sf).select("session_id", "k", "p")
    out = RN.replay(_slices(proba, "k", [13, 40]), LO.stream_vote_debounce)
    return rounded(out.withColumn("majority", F.coalesce("majority", F.lit(-1))), ["conf", "confidence"])


@register("stream_write_filter", S.sql(SM.SLEW, select=f"SELECT session_id, k, {q('angle', 'angle')} FROM sw WHERE emit"))
def stream_write_filter(spark, sf):
    """Levels to written angles over three triggers, by the SQL of the batch chain."""
    levels = SM.activations(spark, sf)
    return rounded(RN.replay(_slices(levels, "k", [9, 31]), LO.stream_write_filter), ["angle"])


#: Positions that never come, and positions that come two triggers late.
GONE, DELAYED = "i % 97 = 5", "i % 50 = 7 AND i >= 100 AND i < 300"


@register("stream_late_rows", S.sql(
    S.FA, f"a AS (SELECT session_id, i, {GONE} AS gone, {DELAYED} AS delayed FROM fa)",
    select="""SELECT session_id, CAST(count_if(delayed AND NOT gone) AS BIGINT) AS late,
CAST(max(i) FILTER (NOT gone AND NOT delayed) + 1 - count_if(NOT gone AND NOT delayed) AS BIGINT) AS lost, CAST(0 AS BIGINT) AS repeated FROM a GROUP BY 1"""))
def stream_late_rows(spark, sf):
    """Rows left out as late and positions lost, counted per session over three triggers."""
    came = settle(td.short_sessions(spark, sf).drop("y").filter(f"NOT ({GONE})"))
    first, second, third = _slices(came.filter(f"NOT ({DELAYED})"), "i", [200, 400])
    out = RN.replay([first, second, third.unionByName(came.filter(DELAYED))], LV.stream_late_rows)
    return out.groupBy("session_id").agg(*[F.sum(c).alias(c) for c in ("late", "lost", "repeated")])


@register("stream_tumbling", S.sql(
    S.FA, select=f"SELECT session_id, i // 150 AS w, count(*) AS n, {', '.join(q(f'sqrt(avg({c} * {c}))', c) for c in SG.CH)} FROM fa GROUP BY ALL"))
def stream_tumbling(spark, sf):
    samples = td.short_sessions(spark, sf).select("session_id", "i", F.timestamp_millis("i").alias("at"), *SG.CH)
    out = _closed(_slices(samples, "i", [137, 400]), samples, lambda s: LV.time_windows(s, list(SG.CH), slide=None, lateness="50 milliseconds"))
    return out.select("session_id", F.floor(F.unix_millis("start") / 150).alias("w"), "n", *[r(c).alias(c) for c in SG.CH])


@register("stream_sliding_time", S.sql(
    S.FA, "o AS (SELECT session_id, unnest(range(i // 25 - 5, i // 25 + 1)) AS w, ch0, ch1, ch2, ch3 FROM fa)",
    select=f"SELECT session_id, w, count(*) AS n, {', '.join(q(f'sqrt(avg({c} * {c}))', c) for c in SG.CH)} FROM o GROUP BY ALL"))
def stream_sliding_time(spark, sf):
    samples = td.short_sessions(spark, sf).select("session_id", "i", F.timestamp_millis("i").alias("at"), *SG.CH)
    out = _closed(_slices(samples, "i", [137, 300, 450]), samples, lambda s: LV.time_windows(s, list(SG.CH), lateness="50 milliseconds"))
    return out.select("session_id", F.floor(F.unix_millis("start") / 25).alias("w"), "n", *[r(c).alias(c) for c in SG.CH])


GAP_US = 6 * 3600 * 1_000_000


@register("stream_sessions", S.sql(
    S.EVENTS, f"g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER s < {GAP_US} THEN 0 ELSE 1 END AS opens FROM ev WINDOW s AS (PARTITION BY session_id ORDER BY ts_us))",
    "h AS (SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY ts_us) AS run FROM g)",
    select=f"SELECT session_id, min(ts_us) AS start_us, max(ts_us) + {GAP_US} AS end_us, count(*) AS n FROM h GROUP BY session_id, run"))
def stream_sessions(spark, sf):
    rows = settle(td.event_rows(spark, sf).select("session_id", "k", "ts_us", F.timestamp_micros("ts_us").alias("at")))
    first, last = rows.agg(F.min("ts_us"), F.max("ts_us")).first()
    edges = [first + (last - first) * n // 3 for n in (1, 2)]
    out = _closed(_slices(rows, "ts_us", edges), rows, lambda s: LV.activity_sessions(s, "6 hours", "1 hour"))
    return out.select("session_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@register("silence_alarms", S.sql(
    S.EVENTS, "m AS (SELECT session_id, ts_us // 1000 AS ms FROM ev)",
    "n AS (SELECT session_id, ms, lead(ms) OVER (PARTITION BY session_id ORDER BY ms) AS later FROM m)",
    select=f"SELECT session_id, ms AS silent_from FROM n WHERE later IS NULL OR later - ms > {GAP_US // 1000}"))
def silence_alarms(spark, sf):
    """Pauses of more than six hours and the last row of every user, over three triggers and a heartbeat."""
    rows = settle(td.event_rows(spark, sf).select("session_id", "ts_us", F.timestamp_micros("ts_us").alias("at")))
    first, last = rows.agg(F.min("ts_us"), F.max("ts_us")).first()
    edges = [first + (last - first) * n // 3 for n in (1, 2)]
    slices = [*_slices(rows, "ts_us", edges), LV.heartbeat(rows), LV.heartbeat(rows, "2 days")]
    return RN.replay(slices, lambda s: LV.silence_alarms(s, GAP_US // 1000)).filter("session_id IS NOT NULL")


@register("stream_features_continuous", S.sql(*SG.DEVICE, select=SG.feature_sql(SG.NAMES)))
def stream_features_continuous(spark, sf):
    """Device features from a filter that runs on over the triggers."""
    samples = td.short_sessions(spark, sf).drop("y")
    out = RN.replay(_slices(samples, "i", [137, 400]), lambda s: LV.stream_features(s, first=25, continuous=True))
    return SG._named(out, SG.FULL, SG.NAMES)


@register("stream_predict", S.sql(
    *MO.predict_sql("k < 8", "k >= 8", "k - 8"), S.HYST.removeprefix(S.FC).lstrip(",\n"),
    select=f"SELECT session_id, CAST(k + 8 AS INTEGER) AS k, winner, {q('conf', 'conf', 5)}, output FROM hs"))
def stream_predict(spark, sf):
    """Samples to smoothed classes: the first eight windows calibrate, the others are scored with a rule-given model."""
    samples = td.short_sessions(spark, sf).drop("y")
    out = RN.replay(_slices(samples, "i", [300, 450]), lambda s: LV.stream_predict(s, MO.DEVICE_MODEL, calibration_windows=8))
    return rounded(out.select("session_id", "k", "winner", "conf", "output"), ["conf"], 5)


REPLAY_TRIGGERS = 4


@register("replay_session", S.sql(S.FB, S.windows("fb"), select=SG.CHECKS))
def replay_session(spark, sf):
    """Stored samples as a stream, cut into windows; the files come in a few triggers, however many there are."""
    path = ST.stored_sessions(spark, sf)
    source = store.replay_stream(spark, path, files_per_trigger=-(-store.sample_files(spark, path) // REPLAY_TRIGGERS))
    base = RN.scratch(spark, "replay")
    RN.run_available(LV.stream_windows(source), f"{base}/out", f"{base}/state")
    return SG._checks(spark.read.parquet(f"{base}/out"))
