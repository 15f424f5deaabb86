"""The proportional channel: muscle level to joint angle, and the tables commands are made from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sinew.constants import (
    ANGLE_FLEX,
    ANGLE_REST,
    DEADZONE,
    DUTY_MAX,
    DUTY_MIN,
    EXTENDED,
    FLEX_HYSTERESIS,
    FLEX_MULTIPLIER,
    HOP,
    JOINT_LIMITS,
    LEVEL_KEEP,
    REST,
    SLEW_DEG,
    WRITE_DEG,
)
from sinew.functions import folds
from sinew.operators.smooth import averaged
from sinew.ordered import Scan, chunk_of, running

CHUNK_ROWS = 4096


def flex_threshold(samples: DataFrame, value: str = "ch3", clip: int | None = None, filtered: bool = False) -> DataFrame:
    """RMS of the rest clip times 2.5 per session; a filtered buffer below 1e-6 is not valid."""
    rows = samples if clip is None else samples.filter(F.col("i") < clip)
    rms = rows.groupBy("session_id").agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rest_rms"))
    threshold = F.col("rest_rms") * FLEX_MULTIPLIER
    if filtered:
        threshold = F.when(F.col("rest_rms") >= 1e-6, threshold)
    return rms.withColumn("threshold", threshold)


def flex_state(rows: DataFrame, thresholds: DataFrame, *, size: int = CHUNK_ROWS) -> DataFrame:
    """flex above 1.3 × threshold, rest below it, otherwise as before; without threshold rest.

    ``rows`` (session_id, k, rms).
    """
    joined = rows.join(thresholds.select("session_id", "threshold"), "session_id", "left")
    event = F.when(F.col("rms") > FLEX_HYSTERESIS * F.col("threshold"), 1).when(F.col("rms") < F.col("threshold"), 0)
    done = running(joined, ["session_id"], ["k"], chunk_of("k", size), {"_state": Scan("last", event)})
    usable = F.col("threshold") > 0
    state = F.when(usable & (F.coalesce("_state", F.lit(0)) == 1), "flex").otherwise("rest")
    return done.select(*rows.columns, state.alias("state"))


def state_angle(state: Column) -> Column:
    return F.when(state == "flex", ANGLE_FLEX).otherwise(ANGLE_REST)


def calibration_phase(i: Column, *, settle: int = 1500, rest: int = 5000, peak: int = 2000) -> Column:
    """rest or max for the collected stretches of a calibration recording, null while settling."""
    rest_end = settle + rest
    max_start = rest_end + settle
    return F.when((i >= settle) & (i < rest_end), "rest").when((i >= max_start) & (i < max_start + peak), "max")


def calibration_clip(rows: DataFrame, value: str = "rms", *, settle: int = 1500, rest: int = 5000, peak: int = 2000,
                     hop: int = HOP) -> DataFrame:
    """Mean, extremes and count of the hop values in each phase: one value per ``hop`` samples."""
    i = F.col("i")
    begin = F.when(F.col("phase") == "rest", settle).otherwise(settle + rest + settle)
    return (
        rows.withColumn("phase", calibration_phase(i, settle=settle, rest=rest, peak=peak))
        .filter(F.col("phase").isNotNull() & ((i - begin) % hop == hop - 1))
        .groupBy("session_id", "phase")
        .agg(F.count("*").alias("hops"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    )


def two_point_calibration(clip: DataFrame) -> DataFrame:
    """Rest and max level per session from ``calibration_clip``; valid if max exceeds 1.2 × rest."""
    return (
        clip.groupBy("session_id")
        .agg(
            F.max(F.when(F.col("phase") == "rest", F.col("mean"))).alias("rest_rms"),
            F.max(F.when(F.col("phase") == "max", F.col("mean"))).alias("max_rms"),
        )
        .withColumn("valid", F.coalesce(F.col("max_rms") > 1.2 * F.col("rest_rms"), F.lit(False)))
    )


def activation_level(rms: Column, rest: Column, peak: Column) -> Column:
    """Level in 0..1 between the two calibration points with a dead zone at rest."""
    level = F.least(F.greatest((rms - rest) / (peak - rest), F.lit(0.0)), F.lit(1.0))
    return F.when(peak <= rest, 0.0).when(level < DEADZONE, 0.0).otherwise(level)


def level_ema(rows: DataFrame, value: str = "level", keep: float = LEVEL_KEEP, *, size: int | None = None) -> DataFrame:
    """Add ``level_ema``, the averaged level starting from 0."""
    return averaged(rows, [F.col(value)], keep, 0.0, ["level_ema"], size=size)


def slew_limit(rows: DataFrame, value: str = "level_ema", limit: float = SLEW_DEG, *, size: int = CHUNK_ROWS) -> DataFrame:
    """``session_id, k, angle``: the angle follows 60 + 80·level by at most ``limit`` per row."""
    low, high = ANGLE_REST, ANGLE_FLEX

    def replay(chunks: list[folds.Chunk], states: list[np.ndarray]) -> list[dict[str, np.ndarray]]:
        angles = folds.follow_many([c["_target"] for c in chunks], np.array([s[0] for s in states]), limit, low, high)
        return [{"k": c["k"], "angle": a} for c, a in zip(chunks, angles)]

    targets = rows.select("session_id", "k", (F.lit(low) + (high - low) * F.col(value)).alias("_target"))
    return folds.chunk_fold(
        targets, "k", ["_target"], size,
        start=[low],
        summarise=lambda chunks: folds.follow_maps([c["_target"] for c in chunks], limit, low, high),
        advance=folds.follow_advance,
        replay=replay,
        outputs=[T.StructField("angle", T.DoubleType())],
    )


def write_filter(rows: DataFrame, threshold: float = WRITE_DEG, *, size: int = CHUNK_ROWS) -> DataFrame:
    """Only angles that moved at least ``threshold`` since the last one written (−1 at first)."""

    def replay(chunks: list[folds.Chunk], states: list[np.ndarray]) -> list[dict[str, np.ndarray]]:
        sent = folds.emissions_many([c["angle"] for c in chunks], np.array([s[0] for s in states]), threshold)
        return [{"k": c["k"][f], "angle": c["angle"][f]} for c, f in zip(chunks, sent)]

    return folds.chunk_fold(
        rows.select("session_id", "k", "angle"), "k", ["angle"], size,
        start=[-1.0],
        summarise=lambda chunks: folds.emission_maps([c["angle"] for c in chunks], threshold),
        advance=folds.emission_advance(threshold),
        replay=replay,
        outputs=[T.StructField("angle", T.DoubleType())],
    )


def pose_table(spark: SparkSession) -> DataFrame:
    """gesture × joint → angle (five gestures, five joints)."""
    rows = []
    for joint, low, high in JOINT_LIMITS:
        rows.append((REST, joint, (low + high) / 2))
        rows += [(g, joint, low if joint in extended else high) for g, extended in EXTENDED.items()]
    return spark.createDataFrame(rows, "gesture string, joint string, angle double")


def gesture_pose(gestures: DataFrame, column: str = "gesture") -> DataFrame:
    """Joint angles of each row's gesture; the 25-row table is the side Spark may broadcast."""
    table = pose_table(gestures.sparkSession).withColumnRenamed("gesture", column)
    return gestures.join(table, column)


def angle_to_duty(angle: Column) -> Column:
    clamped = F.least(F.greatest(angle, F.lit(0.0)), F.lit(180.0))
    return F.floor(F.lit(float(DUTY_MIN)) + clamped / 180.0 * (DUTY_MAX - DUTY_MIN)).cast("int")
