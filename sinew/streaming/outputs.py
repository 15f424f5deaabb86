"""Output smoothing on live streams: votes and debounce, and the proportional channel down to written angles.

Each session's state is what the recurrences need from earlier rows and nothing else: an average, at most `votes` − 1
winners, a counter; or a level, an angle and the last written one. Rows go on from row to row over absent positions, as the batch
operators do; a row that comes after one of a higher `k` was handled is dropped. So the results do not depend on how a stream
is cut into triggers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sinew.constants import (
    ANGLE_FLEX,
    ANGLE_REST,
    DEBOUNCE,
    EMA_KEEP,
    LEVEL_KEEP,
    REJECT,
    SLEW_DEG,
    VOTES,
    WRITE_DEG,
)
from sinew.functions import folds, recurrences
from sinew.streaming.live import _collect, _stateful

VOTE_STATE = T.StructType([
    T.StructField("next_k", T.LongType()),
    T.StructField("average", T.ArrayType(T.DoubleType())),
    T.StructField("ring", T.ArrayType(T.IntegerType())),
    T.StructField("output", T.IntegerType()),
    T.StructField("pending", T.IntegerType()),
    T.StructField("count", T.LongType()),
])
VOTED = [
    T.StructField("raw", T.IntegerType()),
    T.StructField("winner", T.IntegerType()),
    T.StructField("conf", T.DoubleType()),
    T.StructField("rejected", T.BooleanType()),
    T.StructField("majority", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("output", T.IntegerType()),
]


def stream_vote_debounce(
    proba: DataFrame, keep: float = EMA_KEEP, reject: float = REJECT, votes: int = VOTES, debounce: int = DEBOUNCE, *, on_change: bool = False,
) -> DataFrame:
    """``smooth_vote_debounce`` on a stream of probability vectors (session_id, k, p).

    Rows below ``reject`` neither vote nor count; the output stays. ``majority`` is null on them. With ``on_change`` only rows at which
    the output differs from the one before.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        next_k, average, ring, output, pending, count = state.get if state.exists else (None, [], [], -1, -1, 0)
        rows = _collect(frames, ["p"], "k")
        if next_k is not None:
            rows = rows[rows["k"] >= next_k]
        if not len(rows):
            return
        p = np.stack(rows["p"].to_numpy())
        smooth = recurrences.averages(p, np.array(average) if average else np.full(p.shape[1], 1.0 / p.shape[1]), keep)
        winner, conf = smooth.argmax(axis=1), smooth.max(axis=1)
        accepted = np.flatnonzero(conf >= reject)
        majority, share, ring = recurrences.majorities(winner[accepted], np.array(ring, dtype=np.int64), votes)
        decided, pending, count = recurrences.debounced(majority, output, pending, count, debounce)
        at = np.searchsorted(accepted, np.arange(len(p)), "right") - 1
        outputs = np.where(at >= 0, decided[np.maximum(at, 0)] if len(decided) else output, output)
        votes_, confidence = np.full(len(p), -1), conf.copy()
        votes_[accepted], confidence[accepted] = majority, share
        out = pd.DataFrame({
            "session_id": key[0], "k": rows["k"].to_numpy(), "raw": p.argmax(axis=1), "winner": winner, "conf": conf, "rejected": conf < reject,
            "majority": pd.array(votes_, dtype="Int32"), "confidence": confidence, "output": outputs,
        })
        out.loc[out["rejected"], "majority"] = pd.NA
        if on_change:
            out = out[(outputs != -1) & (outputs != np.concatenate([[output], outputs[:-1]]))]
        yield out
        state.update((int(rows["k"].iloc[-1]) + 1, smooth[-1].tolist(), ring.tolist(), int(outputs[-1]), pending, count))

    return _stateful(proba, step, [proba.schema["k"], *VOTED], state=VOTE_STATE)


LEVEL_STATE = T.StructType([
    T.StructField("next_k", T.LongType()),
    T.StructField("level", T.DoubleType()),
    T.StructField("angle", T.DoubleType()),
    T.StructField("written", T.DoubleType()),
])


def stream_write_filter(levels: DataFrame, value: str = "level", keep: float = LEVEL_KEEP, limit: float = SLEW_DEG, threshold: float = WRITE_DEG) -> DataFrame:
    """Activation levels (session_id, k, level) to the angles that are written: average, rate limit and write threshold in one state.

    Gives ``session_id, k, angle`` for rows whose angle moved at least ``threshold`` since the last one written, as ``level_ema``,
    ``slew_limit`` and ``write_filter`` do one after the other.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        next_k, level, angle, written = state.get if state.exists else (None, 0.0, ANGLE_REST, -1.0)
        rows = _collect(frames, [value], "k")
        if next_k is not None:
            rows = rows[rows["k"] >= next_k]
        if not len(rows):
            return
        smooth = recurrences.averages(rows[[value]].to_numpy(dtype=float), np.array([level]), keep)[:, 0]
        angles = folds.follow(ANGLE_REST + (ANGLE_FLEX - ANGLE_REST) * smooth, float(angle), limit, ANGLE_REST, ANGLE_FLEX)
        sent = folds.emissions(angles, float(written), threshold)
        if sent.any():
            written = angles[sent][-1]
            yield pd.DataFrame({"session_id": key[0], "k": rows["k"].to_numpy()[sent], "angle": angles[sent]})
        state.update((int(rows["k"].iloc[-1]) + 1, float(smooth[-1]), float(angles[-1]), float(written)))

    return _stateful(levels, step, [levels.schema["k"], T.StructField("angle", T.DoubleType())], state=LEVEL_STATE)
