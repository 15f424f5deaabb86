"""The operators on live streams, with results equal to the batch ones.

State is kept per session: the raw samples the next window and the filter still need, the running
average and the last output. Rows of a trigger are put in order of ``i``; rows that come later
than their successors are dropped, and a hole in ``i`` restarts windows and filter, exactly as the
batch operators treat it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from sinew.constants import EMA_KEEP, ENTER, HAND_CHANNELS, HOLD, HOP, WINDOW
from sinew.functions import signal
from sinew.operators.features import FeatureOptions

STATE = T.StructType([
    T.StructField("next_i", T.LongType()),
    T.StructField("from_i", T.LongType()),
    T.StructField("origin", T.LongType()),
    T.StructField("times", T.ArrayType(T.DoubleType())),
    T.StructField("values", T.ArrayType(T.DoubleType())),
    T.StructField("average", T.ArrayType(T.DoubleType())),
    T.StructField("output", T.IntegerType()),
    T.StructField("clip", T.ArrayType(T.DoubleType())),
    T.StructField("windows", T.LongType()),
])


@dataclass
class Track:
    """A session's state as arrays."""

    channels: int
    next_i: int = 0
    from_i: int = 0
    origin: int = 0
    times: np.ndarray = field(default_factory=lambda: np.empty(0))
    values: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    average: np.ndarray = field(default_factory=lambda: np.empty(0))
    output: int = -1
    clip: np.ndarray = field(default_factory=lambda: np.empty(0))
    windows: int = 0

    @classmethod
    def load(cls, state, channels: int) -> "Track":
        if not state.exists:
            return cls(channels, values=np.empty((0, channels)))
        next_i, from_i, origin, times, values, average, output, clip, windows = state.get
        return cls(
            channels, next_i, from_i, origin, np.array(times, dtype=float),
            np.array(values, dtype=float).reshape(-1, channels), np.array(average, dtype=float), output,
            np.array(clip, dtype=float), windows,
        )

    def save(self, state) -> None:
        state.update((
            int(self.next_i), int(self.from_i), int(self.origin), self.times.tolist(), self.values.ravel().tolist(),
            self.average.tolist(), int(self.output), self.clip.tolist(), int(self.windows),
        ))


@dataclass(frozen=True)
class Cutter:
    """Cuts arriving samples into windows; keeps what the next window and the filter need."""

    size: int = WINDOW
    hop: int = HOP
    first: int = 0
    continuous: bool = False

    def feed(self, track: Track, i: np.ndarray, ts: np.ndarray, x: np.ndarray):
        """Yield (k, times, windows) per stretch; ``track`` is advanced."""
        fresh = i >= track.next_i
        i, ts, x = i[fresh], ts[fresh], x[fresh]
        cuts = [0, *(np.flatnonzero(np.diff(i) != 1) + 1).tolist(), len(i)]
        for begin, end in zip(cuts[:-1], cuts[1:]):
            if begin < end:
                yield from self._stretch(track, i[begin:end], ts[begin:end], x[begin:end])

    def _stretch(self, track: Track, i, ts, x):
        if i[0] != track.next_i or not len(track.times):
            track.from_i = track.origin = int(i[0])
            track.times, track.values = np.empty(0), np.empty((0, track.channels))
        times = np.concatenate([track.times, ts])
        raw = np.concatenate([track.values, x])
        start = track.from_i
        track.next_i = int(i[-1]) + 1
        # Windows that end before this trigger's first sample were emitted already.
        k0 = max(0, -(-(max(track.origin, int(i[0]) - self.size + 1) - self.first) // self.hop))
        offset = self.first + k0 * self.hop - start
        signal_ = signal.convolve_causal(raw, signal.impulse_response(*signal.BANDPASS, signal.BANDPASS_TAPS)) if self.continuous else raw
        if offset >= 0:
            stack = signal.sliding(signal_[offset:], self.size, self.hop)
            if len(stack):
                ks = np.arange(k0, k0 + len(stack))
                at = offset + np.arange(len(stack)) * self.hop
                yield ks, times[at], times[at + self.size - 1], stack
        memory = self.size - 1 + (signal.BANDPASS_TAPS if self.continuous else 0)
        keep = min(len(times), memory)
        track.from_i = track.next_i - keep
        track.times, track.values = times[len(times) - keep :], raw[len(raw) - keep :]


def _collect(frames: Iterator[pd.DataFrame], columns: Sequence[str], order: str = "i") -> pd.DataFrame:
    frame = pd.concat(list(frames))[[order, *columns]]
    return frame.drop_duplicates(order).sort_values(order)


def _stateful(samples: DataFrame, fn, fields: Sequence[T.StructField], timeout=GroupStateTimeout.NoTimeout, state: T.StructType = STATE) -> DataFrame:
    schema = T.StructType([samples.schema["session_id"], *fields])
    return samples.groupBy("session_id").applyInPandasWithState(fn, schema, state, "append", timeout)


K = T.StructField("k", T.IntegerType())
START = T.StructField("start_time", T.DoubleType())
END = T.StructField("end_time", T.DoubleType())


def _over_windows(samples: DataFrame, cutter: Cutter, channels: Sequence[int], kernel: Callable, fields) -> DataFrame:
    """``kernel(track, ks, stack)`` gives extra columns per window."""
    columns = [f"ch{c}" for c in channels]

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        track = Track.load(state, len(columns))
        rows = _collect(frames, ["ts", *columns])
        for ks, starts, ends, stack in cutter.feed(track, rows["i"].to_numpy(), rows["ts"].to_numpy(), rows[columns].to_numpy(dtype=float)):
            extra = kernel(track, ks, stack)
            if extra is not None:
                out = pd.DataFrame({"session_id": key[0], "k": ks, "start_time": starts, "end_time": ends, **extra})
                keep = extra.get("_keep")
                yield out[[ "session_id", "k", "start_time", "end_time", *[f.name for f in fields]]] if keep is None else out[out["_keep"]].drop(columns="_keep")
        track.save(state)

    return _stateful(samples, step, [K, START, END, *fields])


def stream_windows(samples: DataFrame, channels: Sequence[int] = (0, 1, 2, 3), *, size: int = WINDOW, hop: int = HOP, first: int = 0) -> DataFrame:
    """Sliding windows of a sample stream: at most ``size − 1`` samples of state per session."""
    field_ = T.StructField("x", T.ArrayType(T.ArrayType(T.DoubleType())))
    kernel = lambda track, ks, stack: {"x": [w.T.tolist() for w in stack]}
    return _over_windows(samples, Cutter(size, hop, first), channels, kernel, [field_])


VECTOR = T.StructField("f", T.ArrayType(T.DoubleType()))


def stream_features(samples: DataFrame, options: FeatureOptions = FeatureOptions(), *, first: int = 0, continuous: bool = False) -> DataFrame:
    """Feature vectors of a sample stream; ``continuous`` filters across triggers."""
    switches = options.switches()
    if continuous:
        switches["bandpass"] = False
    kernel = lambda track, ks, stack: {"f": list(signal.window_features(stack, **switches))}
    return _over_windows(samples, Cutter(first=first, continuous=continuous), options.channels, kernel, [VECTOR])


def _smooth(track: Track, p: np.ndarray, keep: float, enter: float, hold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Average and hysteresis of the vectors ``p`` in order, continuing the track."""
    if not len(track.average):
        track.average = np.full(p.shape[1], 1.0 / p.shape[1])
    winners, confs, outputs = np.empty(len(p), int), np.empty(len(p)), np.empty(len(p), int)
    for n, row in enumerate(p):
        track.average = keep * track.average + (1 - keep) * row
        winners[n], confs[n] = track.average.argmax(), track.average.max()
        if confs[n] >= hold and winners[n] != track.output and (track.output < 0 or confs[n] >= enter):
            track.output = int(winners[n])
        outputs[n] = track.output
    return winners, confs, outputs


SMOOTHED = [
    T.StructField("winner", T.IntegerType()), T.StructField("conf", T.DoubleType()), T.StructField("output", T.IntegerType()),
]


def stream_smooth(proba: DataFrame, keep: float = EMA_KEEP, enter: float = ENTER, hold: float = HOLD, *, on_change: bool = False) -> DataFrame:
    """Average and hysteresis on a stream of probability vectors (session_id, k, p)."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        track = Track.load(state, 1)
        rows = _collect(frames, ["p"], "k")
        rows = rows[rows["k"] >= track.next_i]
        if len(rows):
            before = track.output
            winners, confs, outputs = _smooth(track, np.stack(rows["p"].to_numpy()), keep, enter, hold)
            track.next_i = int(rows["k"].iloc[-1]) + 1
            out = pd.DataFrame({"session_id": key[0], "k": rows["k"].to_numpy(), "winner": winners, "conf": confs, "output": outputs})
            if on_change:
                earlier = np.concatenate([[before], outputs[:-1]])
                out = out[(outputs != -1) & (outputs != earlier)]
            yield out
        track.save(state)

    return _stateful(proba, step, [proba.schema["k"], *SMOOTHED])


def stream_predict(
    samples: DataFrame,
    model,
    *,
    options: FeatureOptions = FeatureOptions(),
    calibration_windows: int = 20,
    sigma_train: Sequence[float] | None = None,
    mean_delta: Sequence[float] | None = None,
    on_change: bool = False,
) -> DataFrame:
    """Samples to smoothed classes in one operator, calibrating on the first windows.

    The first ``calibration_windows`` windows give the rest mean (moved by ``mean_delta``) and, if
    no ``sigma_train`` is given, the deviation with a floor. Later windows are scored with the
    model (same class order as its probabilities) and smoothed.
    """
    switches = {**options.switches(), "bandpass": False}
    delta = 0.0 if mean_delta is None else np.asarray(mean_delta, dtype=float)
    fixed = None if sigma_train is None else np.asarray(sigma_train, dtype=float)

    def kernel(track: Track, ks: np.ndarray, stack: np.ndarray) -> dict | None:
        f = signal.window_features(stack, **switches)
        width = f.shape[1]
        need = max(0, calibration_windows - track.windows)
        clip = track.clip.reshape(-1, width) if track.windows else np.empty((0, width))
        if need:
            # Running count, sum and sum of squares would lose digits; the short clip is kept instead.
            clip = np.concatenate([clip, f[:need]])
        track.windows += len(f)
        if track.windows <= calibration_windows:
            track.clip = clip.ravel()
            return None
        if len(clip) > 2 or need:
            std = clip.std(axis=0)
            scale = np.where(std > 1e-6, std, 1e-6) if fixed is None else np.where(fixed > 1e-6, fixed, std)
            clip = np.stack([clip.mean(axis=0) + delta, scale])
            track.clip = clip.ravel()
        mu, sigma = track.clip.reshape(2, width)
        before = track.output
        winners, confs, outputs = _smooth(track, model.probabilities((f[need:] - mu) / sigma), EMA_KEEP, ENTER, HOLD)
        pad = lambda a: np.concatenate([np.full(need, -1), a])
        keep = np.arange(len(f)) >= need
        if on_change:
            earlier = np.concatenate([[before], outputs[:-1]])
            keep &= pad((outputs != -1) & (outputs != earlier)).astype(bool)
        return {"winner": pad(winners), "conf": pad(confs), "output": pad(outputs), "_keep": keep}

    cutter = Cutter(first=HOP, continuous=True)
    return _over_windows(samples, cutter, options.channels, kernel, SMOOTHED)


# ------------------------------------------------------------------------- built-in aggregations


def time_windows(samples: DataFrame, columns: Sequence[str], size: str = "150 milliseconds", slide: str | None = "25 milliseconds",
                 lateness: str = "1 second") -> DataFrame:
    """RMS per epoch-aligned time window; tumbling without ``slide``. ``samples`` has a timestamp ``at``.

    In append mode a window comes out, and leaves the state, once the watermark has passed its end; `heartbeat` closes the last ones.
    """
    span = F.window("at", size, slide) if slide else F.window("at", size)
    return (
        samples.withWatermark("at", lateness).groupBy("session_id", span.alias("w"))
        .agg(F.count("*").alias("n"), *[F.sqrt(F.avg(F.col(c) * F.col(c))).alias(c) for c in columns])
        .select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", *columns)
    )


def activity_sessions(rows: DataFrame, gap: str = "3 seconds", lateness: str = "1 second") -> DataFrame:
    """Stretches without a pause longer than ``gap``; in append mode each comes out once the watermark has passed its end."""
    return (
        rows.withWatermark("at", lateness).groupBy("session_id", F.session_window("at", gap).alias("w"))
        .agg(F.count("*").alias("n")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def heartbeat(rows: DataFrame, ahead: str = "1 day") -> DataFrame:
    """One row without session, ``ahead`` of all ``rows``: a closing trigger moves the watermark past every open window.

    Its own window has no session and stays open. ``ahead`` must exceed lateness plus window or gap.
    """
    newest = rows.agg((F.max("at") + F.expr(f"INTERVAL {ahead}")).alias("at"))
    return newest.select(*[F.col("at") if f.name == "at" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])


def silence_alarms(rows: DataFrame, limit_ms: int = 3000, lateness: str = "0 seconds") -> DataFrame:
    """A row per session each time nothing came for more than ``limit_ms`` of event time: ``session_id, silent_from``.

    A pause between two rows of one trigger counts like one that the watermark finds, so alarms do not depend on the triggers, as
    long as no row comes behind the watermark. The last row of a session raises one once the watermark has passed it by the limit.
    """
    state = T.StructType([T.StructField("last_ms", T.LongType())])
    schema = T.StructType([rows.schema["session_id"], T.StructField("silent_from", T.LongType())])

    def step(key, frames: Iterator[pd.DataFrame], group) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            (last,) = group.get
            group.remove()
            yield pd.DataFrame({"session_id": [key[0]], "silent_from": [last]})
            return
        times = np.sort(np.concatenate([f["_ms"].to_numpy() for f in frames]))
        if group.exists:
            times = np.sort(np.append(times, group.get[0]))
        silent = times[:-1][np.diff(times) > limit_ms]
        if len(silent):
            yield pd.DataFrame({"session_id": key[0], "silent_from": silent})
        newest = int(times[-1])
        group.update((newest,))
        group.setTimeoutTimestamp(max(newest + limit_ms, group.getCurrentWatermarkMs() + 1))

    timed = rows.withColumn("_ms", F.unix_millis("at")).withWatermark("at", lateness).select("session_id", "at", "_ms")
    return timed.groupBy("session_id").applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.EventTimeTimeout)


ARRIVAL_STATE = T.StructType([T.StructField("next_i", T.LongType())])
ARRIVALS = [T.StructField(name, T.LongType()) for name in ("from_i", "late", "lost", "repeated")]


def stream_late_rows(samples: DataFrame) -> DataFrame:
    """What the stateful operators leave out, per session and trigger: ``session_id, from_i, late, lost, repeated``.

    ``late`` rows came after a row of higher ``i`` had been handled, ``repeated`` ones twice in one trigger; both are dropped. ``lost`` is the
    number of positions that were passed over, where windows and filters start anew; a row that comes late stays lost. ``from_i`` is the
    first position the trigger handled (null if all rows were late). Triggers with nothing to report give no row; sums over them are
    the totals, whatever the triggers.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        i = np.sort(np.concatenate([f["i"].to_numpy() for f in frames]))
        next_i = state.get[0] if state.exists else None
        fresh = i if next_i is None else i[i >= next_i]
        own = np.unique(fresh)
        late, repeated, lost = len(i) - len(fresh), len(fresh) - len(own), 0
        if len(own):
            lost = int(own[-1] - (own[0] if next_i is None else next_i) + 1 - len(own))
            state.update((int(own[-1]) + 1,))
        if late or lost or repeated:
            first = pd.array([own[0] if len(own) else None], dtype="Int64")
            yield pd.DataFrame({"session_id": [key[0]], "from_i": first, "late": [late], "lost": [lost], "repeated": [repeated]})

    return _stateful(samples.select("session_id", "i"), step, ARRIVALS, state=ARRIVAL_STATE)


def observed(lines: DataFrame, name: str = "quality") -> DataFrame:
    """Count good and rejected lines of a stream as metrics of each trigger."""
    from sinew.sources.lines import is_sample

    return lines.observe(name, F.count_if(is_sample()).alias("parsed"), F.count_if(~is_sample()).alias("rejected"))
