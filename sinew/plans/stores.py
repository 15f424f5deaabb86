"""Queries: sessions written to a store in the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sinew.operators import windows as W
from sinew.plans import fragments as S
from sinew.plans.catalog import q, register, rounded
from sinew.plans.labelling import DROPPED
from sinew.session import checkpoint_folder
from sinew.sources import store
from sinew.sources import testdata as td

ONE = 0  # a session every size has


def stored_sessions(spark, sf) -> str:
    """Path of a store that holds all long sessions, trials being the years.

    The samples are numbered once, into a table that windows, labels and the stored samples are all read from.
    """
    path = f"{checkpoint_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    samples = td.numbered_sessions(spark, sf)
    labels = td.labelled(samples).select("session_id", "k", "label", (F.col("y") - 1995).alias("trial_id"))
    windows = W.sliding_windows(samples).select("session_id", "k", "start_time", "end_time", "x")
    # Sessions of the labels are those of the windows: the store takes no others.
    sessions = labels.select("session_id").distinct().withColumn("user_id", F.concat(F.lit("user"), F.col("session_id") % 3))
    store.write_session(path, sessions, windows, labels, samples.drop("y"))
    return path


SUMS = ", ".join(q(f"list_sum(w.x{c})", f"sum{c}", 2) for c in range(4))


def _sums(windows):
    total = lambda c: F.aggregate(F.get("x", F.lit(c)), F.lit(0.0), lambda a, v: a + v)
    return windows.withColumns({f"sum{c}": F.round(total(c), 2) for c in range(4)}).drop("x")


@register("read_session", S.sql(
    S.FB, S.windows("fb"), S.LABELLED,
    select=f"""SELECT w.session_id, w.k, {q('w.start_time', 'start_time')}, {q('w.end_time', 'end_time')}, l.label, l.label AS label_original, l.y - 1995 AS trial_id, {SUMS}
FROM w JOIN lw l ON l.session_id = w.session_id AND l.k = w.k WHERE w.session_id = {ONE}"""))
def read_session(spark, sf):
    return rounded(_sums(store.read_session(spark, stored_sessions(spark, sf), ONE)), ["start_time", "end_time"])


@register("read_training", S.sql(
    S.FB, S.LABELLED, S.RUNS, DROPPED,
    select=f"""SELECT session_id, k, label, y - 1995 AS trial_id, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id
FROM kept WHERE session_id = {ONE}"""))
def read_training(spark, sf):
    return store.read_training(spark, stored_sessions(spark, sf), ONE).select("session_id", "k", "label", "trial_id", "label_id")


@register("read_all_training", S.sql(
    S.FB, S.LABELLED, S.RUNS, DROPPED,
    "per AS (SELECT session_id, max(y - 1995) + 1 AS n FROM kept GROUP BY 1)",
    "o AS (SELECT session_id, coalesce(sum(n) OVER (ORDER BY session_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM per)",
    select="""SELECT session_id, k, label, CAST(y - 1995 + off AS BIGINT) AS trial_id,
CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM kept JOIN o USING (session_id)"""))
def read_all_training(spark, sf):
    return store.read_all_training(spark, stored_sessions(spark, sf)).select("session_id", "k", "label", "trial_id", "label_id")


@register("session_info", S.sql(
    S.FB, S.windows("fb"), select="""SELECT session_id, 'user' || session_id % 3 AS user_id, count(*) AS num_windows, 150 AS window_samples,
false AS alignment_enabled, true AS has_trial_ids FROM w GROUP BY 1"""))
def session_info(spark, sf):
    return store.session_info(spark, stored_sessions(spark, sf))


@register("list_sessions", S.sql(S.FB, S.windows("fb"), select="SELECT DISTINCT session_id FROM w"))
def list_sessions(spark, sf):
    return store.list_sessions(spark, stored_sessions(spark, sf))


@register("stored_samples", S.sql(S.FB, select=f"SELECT session_id, i, {q('ts', 'ts')}, ch0, {q('ch1', 'ch1')}, ch2, ch3 FROM fb"))
def stored_samples(spark, sf):
    return rounded(spark.read.parquet(f"{stored_sessions(spark, sf)}/samples").drop("part"), ["ts", "ch1"])
