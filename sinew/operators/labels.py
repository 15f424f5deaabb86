"""Prompt schedules, window labels and everything that acts on runs of equal labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sinew.constants import (
    FORWARD_SHIFT_MS,
    HOLD_SEC,
    HOP,
    LABEL_SHIFT_SEC,
    ONSET_BASELINE_MS,
    ONSET_FACTOR,
    ONSET_FALLBACK_SEC,
    ONSET_SEARCH_MS,
    RATE_HZ,
    REPETITIONS,
    REST,
    REST_SEC,
    TRANSITION_END_MS,
    TRANSITION_START_MS,
    UNLABELED,
)
from sinew.ordered import (
    Scan,
    asof_backward,
    asof_nearest,
    chunk_of,
    interval_join,
    running,
    with_neighbours,
)
from sinew.session import settle

CHUNK_WINDOWS = 4096


def prompt_schedule(
    sessions: DataFrame,
    gestures: Sequence[str],
    hold: float = HOLD_SEC,
    rest: float = REST_SEC,
    repetitions: int = REPETITIONS,
) -> DataFrame:
    """Prompts of every session: rest first, then per repetition each gesture followed by rest.

    ``session_id, trial_id, gesture, start, duration``. Prompt length alternates strictly, so the
    start is arithmetic on the trial number.
    """
    per_cycle = len(gestures)
    names = F.array(*[F.lit(g) for g in gestures])
    trial = F.col("trial_id")
    is_rest = trial % 2 == 0
    gesture = F.get(names, (F.floor((trial - 1) / 2) % per_cycle).cast("int"))
    started = F.ceil(trial / 2)
    return (
        sessions.select("session_id", F.explode(F.sequence(F.lit(0), F.lit(2 * per_cycle * repetitions))).alias("trial_id"))
        .select(
            "session_id",
            "trial_id",
            F.when(is_rest, REST).otherwise(gesture).alias("gesture"),
            (started * rest + (trial - started) * hold).cast("double").alias("start"),
            F.when(is_rest, F.lit(float(rest))).otherwise(F.lit(float(hold))).alias("duration"),
        )
    )


def prompt_timeline(points: DataFrame, schedule: DataFrame, *, at: str = "t", width: float = 64.0) -> DataFrame:
    """What the prompt shows at each time: gesture, time left, progress and, at rest, what comes next."""
    total = schedule.groupBy("session_id").agg(F.max(F.col("start") + F.col("duration")).alias("_total"))
    prompts = neighbours(schedule, ["gesture"], order="trial_id").select(
        "session_id", "trial_id", "gesture", "start", (F.col("start") + F.col("duration")).alias("end"),
        F.col("next_gesture").alias("_next"),
    )
    located = interval_join(
        points, prompts, ["session_id"], F.col(at), "start", "end", ["trial_id", "gesture", "end", "_next"], width=width
    ).join(total, "session_id", "left")
    return located.select(
        *points.columns,
        "trial_id",
        "gesture",
        (F.col("end") - F.col(at)).alias("time_left"),
        F.when(F.col("gesture") == REST, F.col("_next")).alias("next_gesture"),
        F.least(F.lit(1.0), F.col(at) / F.col("_total")).alias("progress"),
    )


def label_windows(
    windows: DataFrame,
    schedule: DataFrame,
    *,
    shift: float = LABEL_SHIFT_SEC,
    width: float = 64.0,
    starts: DataFrame | None = None,
) -> DataFrame:
    """Label and trial of the prompt that holds ``start_time + shift``.

    ``starts`` (session_id, session_start) moves window times onto the schedule's clock.
    """
    at = F.col("start_time") + shift
    rows = windows
    if starts is not None:
        rows = rows.join(starts, "session_id", "left")
        at = at - F.col("session_start")
    prompts = schedule.select(
        "session_id", "trial_id", F.col("gesture").alias("label"), "start",
        (F.col("start") + F.col("duration")).alias("end"),
    )
    matched = interval_join(rows, prompts, ["session_id"], at, "start", "end", ["label", "trial_id"], width=width)
    return matched.select(
        *windows.columns,
        F.coalesce("label", F.lit(UNLABELED)).alias("label"),
        F.coalesce("trial_id", F.lit(-1)).cast("int").alias("trial_id"),
    )


def neighbours(df: DataFrame, columns: Sequence[str], *, order: str = "k", size: int = CHUNK_WINDOWS) -> DataFrame:
    """Add ``prev_*`` and ``next_*``, the values of the rows before and after; positions may have holes."""
    return with_neighbours(df, ["session_id"], order, columns, chunk_of(order, size), after=True)


def label_transitions(labels: DataFrame, *, size: int = CHUNK_WINDOWS) -> DataFrame:
    """Positions at which the label changes, with both labels."""
    moved = neighbours(labels.select("session_id", "k", "label"), ["label"], size=size)
    return moved.filter(F.col("prev_label") != F.col("label")).select(
        "session_id", "k", F.col("prev_label").alias("from_label"), "label"
    )


def with_runs(labels: DataFrame, *, size: int = CHUNK_WINDOWS) -> DataFrame:
    """Add ``run`` (0, 1, …), ``run_k``, ``run_start`` and ``run_end`` of the run a window is in.

    A run may hold a large share of all rows, so its bounds arrive by prefix scan from both sides
    instead of a join on the run.
    """
    marked = neighbours(labels, ["label"], size=size)
    opens = F.col("prev_label").isNull() | (F.col("prev_label") != F.col("label"))
    closes = F.col("next_label").isNull() | (F.col("next_label") != F.col("label"))
    scans = {
        "run": Scan("sum", opens.cast("long")),
        "run_k": Scan("last", F.when(opens, F.col("k"))),
        "run_start": Scan("last", F.when(opens, F.col("start_time"))),
        "run_end": Scan("last", F.when(closes, F.col("end_time")), reverse=True),
    }
    done = running(marked, ["session_id"], ["k"], chunk_of("k", size), scans)
    return done.withColumn("run", F.col("run") - 1).drop("prev_label", "next_label")


def forward_shift(labels: DataFrame, ms: float = FORWARD_SHIFT_MS, hop_ms: float = HOP, *, size: int = CHUNK_WINDOWS) -> DataFrame:
    """The first windows of each non-rest run become rest; runs are those before the change."""
    n = max(1, round(ms / hop_ms))
    runs = with_runs(labels, size=size)
    early = (F.col("label") != REST) & (F.col("k") - F.col("run_k") < n)
    return runs.select(
        *[c for c in labels.columns if c != "label"],
        F.when(early, F.lit(REST)).otherwise(F.col("label")).alias("label"),
    )


def drop_transitions(
    labels: DataFrame, start_ms: float = TRANSITION_START_MS, end_ms: float = TRANSITION_END_MS, *, size: int = CHUNK_WINDOWS
) -> DataFrame:
    """Without the windows near the start (reaction) and end (anticipation) of their run."""
    runs = with_runs(labels, size=size)
    keep = (F.col("start_time") >= F.col("run_start") + start_ms / 1000.0) & (
        F.col("end_time") <= F.col("run_end") - end_ms / 1000.0
    )
    return runs.filter(keep).select(*labels.columns)


def encode_labels(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``label_id``, the label's rank among the distinct labels in order."""
    distinct = labels.select(*by, "label").distinct()
    frame = Window.partitionBy(*by).orderBy("label") if by else Window.orderBy("label")
    ids = distinct.withColumn("label_id", (F.dense_rank().over(frame) - 1).cast("int"))
    return labels.join(ids, [*by, "label"]).select(*labels.columns, "label_id")


# ------------------------------------------------------------------------------ onset alignment


def boundaries(labels: DataFrame, hop: int = HOP, *, size: int = CHUNK_WINDOWS) -> DataFrame:
    """Label changes as prompts: window, time and index of the first sample of the new label."""
    moved = neighbours(labels.select("session_id", "k", "label", "start_time"), ["label"], size=size)
    return moved.filter(F.col("prev_label") != F.col("label")).select(
        "session_id", "k", "label", F.col("start_time").alias("prompt_time"),
        (F.col("k").cast("long") * hop).alias("prompt_i"),
    )


def _near(marks: DataFrame, envelope: DataFrame, low: Column, high: Column, size: int) -> DataFrame:
    """Envelope rows with low ≤ i < high per boundary, by an equi join on (session, cell of i)."""
    cells = marks.withColumn("_low", F.greatest(low, F.lit(0))).withColumn("_high", high).withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("_low") / size), F.floor(F.col("_high") / size)))
    )
    placed = envelope.select(
        "session_id", "i", "ts", "env", F.floor(F.col("i") / size).alias("_cell")
    )
    return cells.join(placed, ["session_id", "_cell"]).filter((F.col("i") >= F.col("_low")) & (F.col("i") < F.col("_high")))


def onset_baseline(marks: DataFrame, envelope: DataFrame, baseline: int = ONSET_BASELINE_MS, *, size: int = 8192) -> DataFrame:
    """Mean and population deviation of the envelope before each boundary."""
    near = _near(marks, envelope, F.col("prompt_i") - baseline, F.col("prompt_i"), size)
    stats = near.groupBy("session_id", "k").agg(
        F.avg("env").alias("base_mean"), F.stddev_pop("env").alias("base_std")
    )
    return marks.join(stats, ["session_id", "k"], "left")


def detect_onset(
    marks: DataFrame,
    envelope: DataFrame,
    factor: float = ONSET_FACTOR,
    search: int = ONSET_SEARCH_MS,
    baseline: int = ONSET_BASELINE_MS,
    fallback: float = ONSET_FALLBACK_SEC,
    *,
    size: int = 8192,
) -> DataFrame:
    """Time the envelope first exceeds mean + factor·deviation, else prompt + fallback.

    The envelope is joined once: each boundary gathers its baseline statistics and the stretch to
    search, which is at most ``search`` samples long.
    """
    near = _near(marks, envelope, F.col("prompt_i") - baseline, F.col("prompt_i") + search, size)
    before = F.col("i") < F.col("prompt_i")
    gathered = near.groupBy("session_id", "k").agg(
        F.avg(F.when(before, F.col("env"))).alias("base_mean"),
        F.stddev_pop(F.when(before, F.col("env"))).alias("base_std"),
        F.collect_list(F.when(~before, F.struct("i", "ts", "env"))).alias("_ahead"),
    )
    limit = F.col("base_mean") + factor * F.col("base_std")
    first = F.array_min(F.filter("_ahead", lambda s: s["env"] > limit))
    found = gathered.select("session_id", "k", "base_mean", "base_std", first["ts"].alias("_onset"))
    return marks.join(found, ["session_id", "k"], "left").select(
        *marks.columns, "base_mean", "base_std", F.coalesce("_onset", F.col("prompt_time") + fallback).alias("onset")
    )


def apply_boundaries(labels: DataFrame, onsets: DataFrame, *, width: float = 64.0, size: int = CHUNK_WINDOWS) -> DataFrame:
    """Move labels to their onsets: boundaries are consumed in order, so a late one holds back the next.

    Before the first boundary the label of window 0 stays.
    """
    effective = running(
        onsets.select("session_id", "k", "onset", F.col("label").alias("aligned")),
        ["session_id"], ["k"], chunk_of("k", size), {"effective": Scan("max", F.col("onset"))},
    )
    opening = labels.groupBy("session_id").agg(F.min_by("label", "k").alias("_first"))
    placed = asof_backward(
        labels, effective.withColumnRenamed("k", "_seq"), ["session_id"], "start_time", "effective", ["aligned"],
        tie="_seq", width=width,
    )
    return placed.join(opening, "session_id").select(
        *labels.columns, F.coalesce("aligned", "_first").alias("aligned_label")
    )


def align_to_onset(labels: DataFrame, envelope: DataFrame, **options) -> DataFrame:
    """Boundaries → onsets → aligned labels.

    Boundaries and onsets are one row per prompt and settled, so the envelope is computed once.
    """
    marks = settle(boundaries(labels))
    return apply_boundaries(labels, settle(detect_onset(marks, envelope, **options)))


def expected_label_per_hop(
    lengths: DataFrame, labels: DataFrame, *, begin: int = 2000, tail: int = 150, hop: int = HOP, tolerance: int = 25,
    width: int = 65536,
) -> DataFrame:
    """Label of the nearest labelled window for each hop of a replay, rest where none is close.

    ``lengths`` (session_id, n), ``labels`` (session_id, start_i, label).
    """
    hops = lengths.filter(F.col("n") - tail >= begin).select(
        "session_id", F.explode(F.sequence(F.lit(begin).cast("long"), F.col("n") - tail, F.lit(hop).cast("long"))).alias("hop_i")
    )
    near = asof_nearest(hops, labels, ["session_id"], "hop_i", "start_i", ["label"], width=width)
    return near.select(
        "session_id", "hop_i",
        F.when(F.col("distance") <= tolerance, F.col("label")).otherwise(F.lit(REST)).alias("label"),
    )
