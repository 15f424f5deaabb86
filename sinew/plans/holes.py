"""Queries over recordings with lost samples or rows: positions are dropped by a rule, and windows, filters, runs and outputs go on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinew.functions import signal
from sinew.operators import filters as FI
from sinew.operators import labels as L
from sinew.operators import smooth as SM
from sinew.operators import windows as W
from sinew.ordered import chunk_of, dense_index
from sinew.plans import fragments as S
from sinew.plans.catalog import q, register, rounded
from sinew.plans.signals import CH, recursion, zero_phase_sql
from sinew.sources import testdata as td

# Of every 200 samples the positions 150-159 are lost, which leaves stretches of 190.
LOST = "i % 200 BETWEEN 150 AND 159"
FH = f"""fh AS MATERIALIZED (
  SELECT session_id * 1000 + (i + 40) // 200 AS session_id, i - greatest(0, 200 * ((i + 40) // 200) - 40) AS i, ts, ch0, ch1, ch2, ch3
  FROM fa WHERE NOT ({LOST}))"""
WH = f"""wh AS MATERIALIZED (SELECT a.session_id, CAST(a.i // 25 AS INTEGER) AS k, a.ts AS start_time, b.ts AS end_time
  FROM fa a JOIN fa b ON b.session_id = a.session_id AND b.i = a.i + 149
  WHERE a.i % 25 = 0 AND (a.i + 40) // 200 = (a.i + 189) // 200 AND NOT (a.{LOST}) AND NOT (b.{LOST}))"""


def broken(spark, sf) -> DataFrame:
    return td.short_sessions(spark, sf).filter(f"NOT ({LOST})")


def by_stretch(df: DataFrame) -> DataFrame:
    """Stretches numbered as sessions of their own, as in the SQL."""
    stretch = F.floor((F.col("i") + 40) / 200)
    return df.withColumns({
        "session_id": F.col("session_id") * 1000 + stretch, "i": F.col("i") - F.greatest(F.lit(0), 200 * stretch - 40),
    })


@register("windows_with_holes", S.sql(S.FA, WH, select=f"SELECT session_id, k, {q('start_time', 'start_time')}, {q('end_time', 'end_time')} FROM wh"))
def windows_with_holes(spark, sf):
    """No window spans a hole."""
    out = W.sliding_windows(broken(spark, sf)).select("session_id", "k", "start_time", "end_time")
    return rounded(out, ["start_time", "end_time"])


@register("reconstruct_with_holes", S.sql(
    S.FA, WH, "o AS (SELECT f.session_id, f.i, max(w.k) AS k FROM fa f JOIN wh w ON w.session_id = f.session_id AND f.i BETWEEN 25 * w.k AND 25 * w.k + 149 GROUP BY ALL)",
    select=f"SELECT session_id, i, ch0, {q('ch1', 'ch1')}, ch2, ch3, 'w' || k AS label FROM fa JOIN o USING (session_id, i)"))
def reconstruct_with_holes(spark, sf):
    """Every sample of a window comes back, with the label of the last window that holds it."""
    windows = W.sliding_windows(broken(spark, sf)).withColumn("label", F.concat(F.lit("w"), "k"))
    return rounded(W.reconstruct_signal(windows), ["ch1"])


@register("bandpass_with_holes", S.sql(S.FA, FH, recursion("bs", "fh", signal.BANDPASS, range(4)),
    select="SELECT session_id, i, " + ", ".join(q(f"y[{c + 1}]", f"ch{c}", 5) for c in range(4)) + " FROM bs WHERE i >= 0"))
def bandpass_with_holes(spark, sf):
    """The filter starts again behind each hole."""
    return rounded(by_stretch(FI.bandpass_stream(broken(spark, sf))).drop("ts"), CH, 5)


@register("zero_phase_with_holes", S.sql(
    S.FA, FH, "fl AS MATERIALIZED (SELECT * FROM fh SEMI JOIN (SELECT session_id FROM fh GROUP BY 1 HAVING count(*) > 9) USING (session_id))",
    zero_phase_sql("zp", "fl", signal.HIGHPASS_20, (0, 1, 2, 3), 9),
    select=f"SELECT session_id, i, {', '.join(q(c, c, 5) for c in CH)} FROM zp"))
def zero_phase_with_holes(spark, sf):
    """Both ends of a stretch are extended like those of a session; stretches too short for that are left to tests."""
    out = by_stretch(FI.zero_phase(broken(spark, sf), "high")).drop("ts")
    long = out.groupBy("session_id").agg(F.count("*").alias("_n")).filter("_n > 9").select("session_id")
    return rounded(out.join(long, "session_id", "left_semi"), CH, 5)


@register("moving_rms_with_holes", S.sql(S.FA, select="SELECT session_id, i, " + ", ".join(
    q(f"sqrt(sum(ch{c} * ch{c}) OVER s / 150)", f"ch{c}") for c in range(4))
    + f" FROM fa WHERE NOT ({LOST}) WINDOW s AS (PARTITION BY session_id ORDER BY i RANGE BETWEEN 75 PRECEDING AND 74 FOLLOWING)"))
def moving_rms_with_holes(spark, sf):
    return rounded(FI.moving_rms(broken(spark, sf)), CH)


LABELLED = S.LABELLED.replace("lw AS MATERIALIZED", "la AS MATERIALIZED") + ",\nlw AS MATERIALIZED (SELECT * FROM la WHERE k % 11 NOT IN (7, 8))"


@register("runs_with_holes", S.sql(
    S.FB, LABELLED, S.RUNS, "e AS (SELECT session_id, run, min(k) AS run_k, min(start_time) AS a, max(end_time) AS b FROM runs GROUP BY ALL)",
    select=f"""SELECT session_id, k, label, CAST(run AS BIGINT) AS run, run_k, {q('a', 'run_start')}, {q('b', 'run_end')}
FROM runs JOIN e USING (session_id, run)"""))
def runs_with_holes(spark, sf):
    """A run goes on over absent windows."""
    runs = L.with_runs(td.labelled_windows(spark, sf).filter("k % 11 NOT IN (7, 8)"), size=64)
    return rounded(runs.select("session_id", "k", "label", "run", "run_k", "run_start", "run_end"), ["run_start", "run_end"])


# The rows that are left, numbered anew: outputs depend on rows, not on positions.
RENUMBERED = "fc AS MATERIALIZED (SELECT * REPLACE (row_number() OVER (PARTITION BY session_id ORDER BY k) - 1 AS k) FROM fd WHERE k % 23 < 19)"


def _renumbered(sql: str) -> str:
    return sql.replace("fc AS MATERIALIZED", "fd AS MATERIALIZED").replace(",\nem AS (", f",\n{RENUMBERED},\nem AS (")


def _ranked(df: DataFrame) -> DataFrame:
    return dense_index(df, ["session_id"], ["k"], chunk_of("k", 4096), "rank").drop("k").withColumnRenamed("rank", "k")


@register("smooth_with_holes", S.sql(_renumbered(S.HYST), select=f"SELECT session_id, k, raw, winner, {q('conf', 'conf')}, output FROM hs"))
def smooth_with_holes(spark, sf):
    rows = td.probabilities(spark, sf).filter("k % 23 < 19")
    return rounded(_ranked(SM.smooth_hysteresis(rows, 5, size=64)), ["conf"]).select("session_id", "k", "raw", "winner", "conf", "output")


@register("events_with_holes", S.sql(
    _renumbered(S.HYST), select=f"""SELECT session_id, k, output FROM (SELECT *, lag(output) OVER (PARTITION BY session_id ORDER BY k) AS b FROM hs)
WHERE output <> -1 AND b IS DISTINCT FROM output"""))
def events_with_holes(spark, sf):
    rows = td.probabilities(spark, sf).filter("k % 23 < 19")
    outputs = SM.smooth_hysteresis(rows, 5)
    events = SM.prediction_events(outputs, size=16).select("session_id", "k", F.col("output").alias("event"))
    return _ranked(outputs.join(events, ["session_id", "k"], "left")).filter("event IS NOT NULL").select("session_id", "k", "output")
