"""Logs as tables: device states from commands, gaps, sample assembly, quantisation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sinew.constants import ACTIVE_STATES, CHANNELS
from sinew.functions import folds
from sinew.ordered import Scan, chunk_of, running
from sinew.session import settle

IDLE, CONNECTED = "IDLE", "CONNECTED"


def device_state_timeline(commands: DataFrame, order: str = "k", *, size: int = 4096) -> DataFrame:
    """Add ``state`` after each command of a device (``session_id``, ``order``, ``cmd``).

    connect and disconnect set the state outright, stop ends an activity, and after each of these
    only the first start-type command counts. So the state follows from the last such reset and
    the first start after it: one forward and one backward prefix scan.
    """
    cmd = F.col("cmd")
    state_of = F.create_map(*[F.lit(x) for pair in ACTIVE_STATES.items() for x in pair])
    starts = cmd.isin(*ACTIVE_STATES)
    resets = cmd.isin("connect", "stop", "disconnect")
    ahead = running(
        commands, ["session_id"], [order], chunk_of(order, size),
        {"_start": Scan("last", F.when(starts, F.struct(F.col(order).alias("at"), state_of[cmd].alias("state"))), reverse=True)},
    )
    behind = running(
        settle(ahead), ["session_id"], [order], chunk_of(order, size),
        {
            "_link": Scan("last", F.when(cmd.isin("connect", "disconnect"), cmd)),
            "_reset": Scan("last", F.when(resets, F.struct("_start"))),
        },
    )
    began = F.col("_reset._start.at") <= F.col(order)
    state = (
        F.when(F.coalesce("_link", F.lit("disconnect")) == "disconnect", IDLE)
        .when(began, F.col("_reset._start.state"))
        .otherwise(CONNECTED)
    )
    return behind.select(*commands.columns, state.alias("state"))


def gap_report(rows: DataFrame, order: str, limit: float, *, width: float) -> DataFrame:
    """Stretches without a row for longer than ``limit`` (in units of ``order``).

    Times are sparse, so the row before may lie any number of chunks back: a prefix scan.
    """
    done = running(
        rows.select("session_id", order), ["session_id"], [order], F.floor(F.col(order) / F.lit(width)).cast("long"),
        {"_before": Scan("last", F.col(order), exclusive=True)},
    )
    gap = F.col(order) - F.col("_before")
    return done.filter(gap > limit).select(
        "session_id", F.col("_before").alias("gap_start"), F.col(order).alias("gap_end"), gap.alias("gap")
    )


def assemble_scans(readings: DataFrame, channels: int = CHANNELS) -> DataFrame:
    """Regular scan order: every ``channels`` consecutive readings are one sample."""
    value = lambda c: F.max(F.when(F.col("channel") == c, F.col("value"))).alias(f"ch{c}")
    return readings.groupBy("session_id", F.floor(F.col("seq") / channels).alias("i")).agg(
        *[value(c) for c in range(channels)]
    )


def assemble_channels(readings: DataFrame, channels: int = CHANNELS, *, size: int = 16384) -> DataFrame:
    """Any reading order: a sample each time all channels were seen since the last one; the latest values win.

    The state is the set of channels seen and the latest values. Per chunk the map over all sets
    is tabulated, so chunks can be replayed independently. Readings of other channels are left out.
    """
    full = (1 << channels) - 1

    def valid(chunk: folds.Chunk) -> tuple[folds.Chunk, folds.Collected]:
        own = (chunk["channel"] >= 0) & (chunk["channel"] < channels)
        chunk = {name: v[own] for name, v in chunk.items()}
        return chunk, folds.Collected(chunk["channel"], channels)

    def picked(chunk: folds.Chunk, at: np.ndarray, before: np.ndarray) -> np.ndarray:
        """(places, channels) the latest values, those of ``before`` where a channel has none yet."""
        values = np.append(chunk["value"], np.nan)[at]
        return np.where(at.T >= 0, values.T, before)

    def summarise(chunks: list[folds.Chunk]) -> list[np.ndarray]:
        out = []
        for chunk, collected in map(valid, chunks):
            last = collected.latest(np.array([collected.n]))
            out.append(np.concatenate([collected.exits(), picked(chunk, last, np.full(channels, np.nan))[0]]))
        return out

    def advance(step: np.ndarray, state: np.ndarray) -> np.ndarray:
        latest = step[full:]
        return np.concatenate([[step[int(state[0])]], np.where(np.isnan(latest), state[1:], latest)])

    def replay(chunks: list[folds.Chunk], states: list[np.ndarray]) -> list[dict[str, np.ndarray]]:
        out = []
        for (chunk, collected), state in zip(map(valid, chunks), states):
            ends = collected.ends(int(state[0]))
            values = picked(chunk, collected.latest(ends), state[1:])
            out.append({"seq": chunk["seq"][ends].astype(np.int64), **{f"ch{c}": values[:, c] for c in range(channels)}})
        return out

    return folds.chunk_fold(
        readings.select("session_id", "seq", "channel", F.col("value").cast("double").alias("value")),
        "seq", ["channel", "value"], size,
        start=[0.0, *([np.nan] * channels)],
        summarise=summarise,
        advance=advance,
        replay=replay,
        outputs=[T.StructField(f"ch{c}", T.DoubleType()) for c in range(channels)],
    )


def quantise_counts(value: Column) -> Column:
    """Clip to 0..65535 and round half to even."""
    return F.bround(F.least(F.greatest(value, F.lit(0.0)), F.lit(65535.0))).cast("int")
