"""Session and model stores on Parquet.

A store holds ``sessions`` (one row each), ``windows`` and ``samples``. Both large tables are
partitioned by a hash part of the session, so any number of sessions makes a bounded number of
folders. Writing tasks take (part, session, cell of the position) groups, merged or split by their
size, so their number grows with the data and one long session is many files. Files are sorted,
which lets a read of one session prune the folder and then the row groups.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sinew.constants import HOP, RATE_HZ
from sinew.operators import labels as L
from sinew.ordered import Scan, running
from sinew.session import settle

CELL_WINDOWS = 1 << 17
SESSIONS_PER_CHUNK = 1 << 16
CELL_SAMPLES = CELL_WINDOWS * HOP
# Of `<user>_<time>` names: reaches into the time, so that one user's sessions are many chunks.
NAME_PREFIX = 24


PARTS = 256


def part_of(session: F.Column, parts: int = PARTS) -> F.Column:
    return F.pmod(F.xxhash64(session.cast("string")), F.lit(parts)).cast("int")


def _celled(rows: DataFrame, order: str, cell: int) -> DataFrame:
    return rows.withColumn("part", part_of(F.col("session_id"))).withColumn("_cell", F.floor(F.col(order) / cell))


def _placed(rows: DataFrame, order: str, cell: int) -> DataFrame:
    return _celled(rows, order, cell).repartition("part", "session_id", "_cell")


@contextmanager
def _together(spark: SparkSession) -> Iterator[None]:
    """Joins keep a partitioning by some of their keys instead of shuffling both sides again by all of them."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _write(rows: DataFrame, path: str, order: str, cell: int, mode: str) -> None:
    placed = _celled(rows, order, cell)
    sorted_rows = placed.hint("rebalance", "part", "session_id", "_cell").sortWithinPartitions("part", "session_id", order).drop("_cell")
    sorted_rows.write.mode(mode).partitionBy("part").parquet(path)


def session_name(user: str, started) -> F.Column:
    """Identifier of a session: user and start time."""
    user = F.col(user) if isinstance(user, str) else user
    return F.concat(user, F.lit("_"), F.date_format(started, "yyyyMMdd_HHmmss"))


def session_counts(windows: DataFrame) -> DataFrame:
    """``session_id, num_windows, window_samples``, settled: one row per session from one pass over the windows."""
    return settle(windows.groupBy("session_id").agg(
        F.count("*").alias("num_windows"), F.first(F.size(F.get("x", F.lit(0)))).alias("window_samples")
    ))


def check_lengths(counts: DataFrame, labels: DataFrame) -> None:
    """Error if a session has no windows, or windows (their ``session_counts``) and labels differ in number."""
    left = counts.select("session_id", F.col("num_windows").alias("windows"))
    right = labels.groupBy("session_id").agg(F.count("*").alias("labels"))
    wrong = left.join(right, "session_id", "full").filter(
        F.coalesce("windows", F.lit(0)) != F.coalesce("labels", F.lit(0))
    )
    bad = wrong.limit(1).collect()
    if bad:
        raise ValueError(f"windows and labels differ in session {bad[0]['session_id']}")
    if counts.isEmpty():
        raise ValueError("no windows to store")


def write_session(
    path: str,
    sessions: DataFrame,
    windows: DataFrame,
    labels: DataFrame,
    samples: DataFrame | None = None,
    *,
    envelope: DataFrame | None = None,
    shift: bool = True,
    mode: str = "append",
) -> None:
    """Store sessions with aligned and original labels.

    ``labels`` (session_id, k, label, trial_id). With ``envelope`` the labels are moved to the
    activity onset and the start of each run becomes rest; the original stays beside it.
    """
    counts = session_counts(windows)
    check_lengths(counts, labels)
    stored = labels.withColumn("label_original", F.col("label"))
    if envelope is not None:
        stored = stored.join(windows.select("session_id", "k", "start_time", "end_time"), ["session_id", "k"])
        stored = L.align_to_onset(stored, envelope).drop("label").withColumnRenamed("aligned_label", "label")
        if shift:
            stored = L.forward_shift(stored)
    wanted = stored.select("session_id", "k", "label", "label_original", "trial_id")
    with _together(windows.sparkSession):
        # Windows are far larger than their labels: both go to the writing tasks and are joined there, so windows move once.
        joined = _placed(windows, "k", CELL_WINDOWS).join(_placed(wanted, "k", CELL_WINDOWS), ["part", "session_id", "_cell", "k"])
        ordered = joined.sortWithinPartitions("part", "session_id", "_cell", "k")
        columns = [*windows.columns, "label", "label_original", "trial_id"]
        ordered.select(*["session_id", "k"], *[c for c in columns if c not in ("session_id", "k")], "part").write.mode(mode).partitionBy("part").parquet(f"{path}/windows")
    if samples is not None:
        _write(samples, f"{path}/samples", "i", CELL_SAMPLES, mode)
    sessions.join(counts, "session_id").withColumn("alignment_enabled", F.lit(envelope is not None)).withColumn(
        "has_trial_ids", F.lit("trial_id" in labels.columns)
    ).write.mode(mode).parquet(f"{path}/sessions")


def list_sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/sessions").select("session_id").orderBy("session_id")


def session_info(spark: SparkSession, path: str) -> DataFrame:
    """Metadata only; no window is read."""
    return spark.read.parquet(f"{path}/sessions")


def read_session(spark: SparkSession, path: str, session_id) -> DataFrame:
    here = (F.col("part") == part_of(F.lit(session_id))) & (F.col("session_id") == session_id)
    return spark.read.parquet(f"{path}/windows").filter(here).drop("part")


def session_samples(windows: DataFrame, rate: float = RATE_HZ) -> DataFrame:
    """Samples of stored windows with their time: window start + position / rate."""
    channels = F.arrays_zip(*[F.get("x", F.lit(c)).alias(f"ch{c}") for c in range(4)])
    return windows.select("session_id", "k", "start_time", F.posexplode(channels).alias("j", "_v")).select(
        "session_id", "k", "j", (F.col("start_time") + F.col("j") / rate).alias("t"), "_v.*"
    )


def read_training(spark: SparkSession, path: str, session_id, *, drop: bool = True) -> DataFrame:
    """One session's windows with label ids, without transition windows if ``drop``."""
    rows = read_session(spark, path, session_id)
    kept = L.drop_transitions(rows) if drop else rows
    return L.encode_labels(kept)


def combine_training(windows: DataFrame, *, drop: bool = True) -> DataFrame:
    """All sessions as one training table.

    Sessions whose window shape differs from the first one's are left out, transitions are
    dropped per session, missing trials become one per window, and trial ids are made unique by
    the running number of trials of the sessions before. All of this only needs window keys, so
    the samples of the windows are joined on last and shuffled once.
    """
    shape = F.struct(F.size("x").alias("channels"), F.size(F.get("x", F.lit(0))).alias("samples"))
    shapes = windows.groupBy("session_id").agg(F.min(shape).alias("shape"))
    first = shapes.agg(F.min_by("shape", "session_id").alias("shape"))
    keys = windows.drop("x").join(
        shapes.join(first, "shape", "left_semi").select("session_id"), "session_id", "left_semi"
    )
    # Keys only, read by several small aggregates below.
    kept = settle(L.drop_transitions(keys) if drop else keys)
    trial = F.coalesce("trial_id", F.col("k")).cast("long")
    coded = L.encode_labels(global_trials(kept.withColumn("trial_id", trial)))
    return coded.join(windows.select("session_id", "k", "x"), ["session_id", "k"])


def global_trials(rows: DataFrame) -> DataFrame:
    """Trial ids unique over sessions: plus max + 1 of every earlier session.

    A prefix scan over one row per session, itself cut into chunks of sessions.
    """
    per = rows.groupBy("session_id").agg((F.max("trial_id") + 1).alias("_n")).withColumn("_all", F.lit(0))
    numeric = isinstance(rows.schema["session_id"].dataType, T.IntegralType)
    block = F.floor(F.col("session_id") / SESSIONS_PER_CHUNK) if numeric else F.substring("session_id", 1, NAME_PREFIX)
    offsets = running(per, ["_all"], ["session_id"], block, {"_offset": Scan("sum", F.col("_n"), exclusive=True)})
    return (
        rows.join(offsets.select("session_id", F.coalesce("_offset", F.lit(0)).alias("_offset")), "session_id")
        .withColumn("trial_id", F.col("trial_id") + F.col("_offset")).select(*rows.columns)
    )


def read_all_training(spark: SparkSession, path: str, *, drop: bool = True) -> DataFrame:
    return combine_training(spark.read.parquet(f"{path}/windows").drop("part"), drop=drop)


def sample_files(spark: SparkSession, path: str) -> int:
    """Number of files that hold the stored samples."""
    return len(spark.read.parquet(f"{path}/samples").inputFiles())


def replay_stream(spark: SparkSession, path: str, *, files_per_trigger: int = 1) -> DataFrame:
    """Stored samples as a streaming source."""
    schema = spark.read.parquet(f"{path}/samples").schema
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}/samples").drop("part")
    )


# ------------------------------------------------------------------------------------- models

SETTINGS_DEFAULTS = {"reinhard": False, "bandpass": False, "normalize": True, "channels": [0, 1, 2]}


def complete_settings(settings: dict, features: int) -> dict:
    """Settings of older model files: what the vector's length implies, then the defaults."""
    return {
        **SETTINGS_DEFAULTS,
        "expanded": features > 12,
        "cross_channel": features > 60,
        **settings,
    }


def save_model(spark: SparkSession, path: str, name: str, rows: DataFrame, settings: dict) -> None:
    """A model is its parameter rows plus one settings row."""
    rows.write.mode("overwrite").parquet(f"{path}/{name}/parameters")
    spark.createDataFrame([(name, json.dumps(settings))], "name string, settings string").withColumn(
        "saved", F.current_timestamp()
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}/settings")


def load_model(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, dict]:
    rows = spark.read.parquet(f"{path}/{name}/parameters")
    stored = json.loads(spark.read.parquet(f"{path}/{name}/settings").first()["settings"])
    width = rows.select(F.size("w")).first()[0] if "w" in rows.columns else 0
    return rows, complete_settings(stored, width)


def list_models(spark: SparkSession, path: str) -> DataFrame:
    """Stored single models (ensembles are listed apart) with their time, newest first."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
        .load(path).select("path", "modificationTime")
    )
    named = files.withColumn("name", F.regexp_extract("path", r"([^/]+)/settings/[^/]+$", 1)).filter(F.col("name") != "")
    return (
        named.filter(~F.lower("name").contains("ensemble")).groupBy("name")
        .agg(F.max("modificationTime").alias("saved")).orderBy(F.desc("saved"), F.desc("name"))
    )


def latest_model(spark: SparkSession, path: str) -> str | None:
    row = list_models(spark, path).first()
    return row["name"] if row else None


def session_catalog(rows: DataFrame, gestures: Iterable[str] = ()) -> DataFrame:
    """Per session the number of windows, first and last time and the labels seen."""
    return rows.groupBy("session_id").agg(
        F.count("*").alias("num_windows"),
        F.min("start_time").alias("first_time"),
        F.max("end_time").alias("last_time"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("gestures"),
    )
