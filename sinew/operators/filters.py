"""Signal filters over whole sessions, cut into chunks.

The filters forget: beyond a few hundred samples their response is below double precision, so a
chunk with that much halo gives the same numbers as one pass over the session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sinew.constants import BICEP_CHANNEL, BICEP_SAMPLES, HOP, WINDOW
from sinew.functions import arrow, signal
from sinew.functions.columns import centred
from sinew.operators.windows import CHANNEL_COLUMNS, pack
from sinew.ordered import CHUNK, OWN, stretches, with_halo

CHUNK_SAMPLES = 16384
HALO = 1000


def _per_chunk(
    samples: DataFrame,
    columns: Sequence[str],
    fn: Callable[[np.ndarray, bool, bool], np.ndarray],
    outputs: Sequence[str],
    *,
    size: int,
    before: int,
    after: int,
) -> DataFrame:
    """Apply ``fn(x, at_start, at_end)`` to each unbroken stretch of a chunk with halo and keep the chunk's own rows.

    A hole in ``i`` ends one stretch and starts the next, like the ends of a session. A stretch that
    does not reach the edge of the halo has its end there; where an end falls on the last halo
    sample it is too far from the chunk's own rows to matter. So no session length is needed.
    """
    packed = pack(samples, ["ts", *columns], size=size, before=before, after=after)
    fields = [T.StructField("i", T.LongType()), T.StructField("ts", T.DoubleType())]
    schema = T.StructType(
        [samples.schema["session_id"], *fields, *[T.StructField(c, T.DoubleType()) for c in outputs]]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ts = arrow.ragged(batch.column("i")), arrow.ragged(batch.column("ts"))
            tracks = [arrow.ragged(batch.column(c)) for c in columns]
            homes = batch.column(CHUNK).to_numpy()
            for row, positions in enumerate(at):
                own = positions // size == homes[row]
                if not own.any():
                    continue
                x = np.stack([t[row] for t in tracks], axis=1)
                low, high = homes[row] * size - before, (homes[row] + 1) * size - 1 + after
                parts = [
                    fn(x[a:b], positions[a] == 0 or positions[a] > low, positions[b - 1] < high)
                    for a, b in stretches(positions)
                ]
                y = np.concatenate(parts)[own]
                keys = batch.column("session_id").take(pa.array(np.full(len(y), row)))
                values = {name: pa.array(np.ascontiguousarray(y[:, n])) for n, name in enumerate(outputs)}
                yield arrow.batch(
                    {"session_id": keys, "i": pa.array(positions[own]), "ts": pa.array(ts[row][own]), **values}
                )

    return packed.mapInArrow(run, schema)


def bandpass_windows(windows: DataFrame) -> DataFrame:
    """Band-pass each window, restarted at its first sample; ``x`` stays channel-major."""
    from sinew.operators.features import _over_windows

    keep = [c for c in windows.columns if c != "x"]
    kernel = lambda stack: {"x": arrow.nested_column(signal.bandpass_windows(stack))}
    return _over_windows(windows, keep, kernel, [windows.schema["x"]])


def bandpass_stream(
    samples: DataFrame, columns: Sequence[str] = CHANNEL_COLUMNS, *, size: int = CHUNK_SAMPLES
) -> DataFrame:
    """20-450 Hz over every unbroken stretch of the session from rest."""
    response = signal.impulse_response(*signal.BANDPASS, signal.BANDPASS_TAPS)
    return _per_chunk(
        samples, columns, lambda x, *_: signal.convolve_causal(x, response), columns,
        size=max(size, signal.BANDPASS_TAPS), before=signal.BANDPASS_TAPS, after=0,
    )


def zero_phase(
    samples: DataFrame, kind: str = "high", columns: Sequence[str] = CHANNEL_COLUMNS, *, size: int = CHUNK_SAMPLES
) -> DataFrame:
    """Forward-backward filter: ``high`` (20 Hz), ``low`` (10 Hz) or ``band`` (20-450 Hz, 4th order)."""
    design, pad = {
        "high": (signal.HIGHPASS_20, 9), "low": (signal.LOWPASS_10, 9), "band": (signal.BANDPASS_4, 27)
    }[kind]
    fn = lambda x, s, e: signal.zero_phase(x, design, HALO, pad, s, e)
    return _per_chunk(samples, columns, fn, columns, size=max(size, HALO), before=HALO, after=HALO)


def activity_envelope(
    samples: DataFrame, columns: Sequence[str] = CHANNEL_COLUMNS, *, size: int = CHUNK_SAMPLES
) -> DataFrame:
    """High-pass, RMS over channels, low-pass: ``session_id, i, ts, env``.

    Both zero-phase passes run on one chunk, whose halo covers the reach of the two together.
    """
    reach = 2 * HALO

    def fn(x: np.ndarray, at_start: bool, at_end: bool) -> np.ndarray:
        high = signal.zero_phase(x, signal.HIGHPASS_20, HALO, 9, at_start, at_end)
        level = np.sqrt((high**2).mean(axis=1, keepdims=True))
        return signal.zero_phase(level, signal.LOWPASS_10, HALO, 9, at_start, at_end)

    return _per_chunk(samples, columns, fn, ["env"], size=max(size, reach), before=reach, after=reach)


def remove_dc(channel: Column) -> Column:
    return centred(channel)


def tone_map(channel: Column) -> Column:
    return F.transform(channel, lambda v: 64.0 * v / (32.0 + F.abs(v)))


def rms_across_channels(columns: Sequence[str] = CHANNEL_COLUMNS) -> Column:
    total = sum((F.col(c) * F.col(c) for c in columns[1:]), F.col(columns[0]) * F.col(columns[0]))
    return F.sqrt(total / len(columns))


def moving_rms(samples: DataFrame, columns: Sequence[str] = CHANNEL_COLUMNS, n: int = WINDOW, *, size: int = CHUNK_SAMPLES) -> DataFrame:
    """Centred moving RMS with zeros beyond the ends and in holes: positions −n/2 … n/2 − 1 over n."""
    half = n // 2
    frame = Window.partitionBy("session_id", CHUNK).orderBy("i").rangeBetween(-half, n - half - 1)
    placed = with_halo(samples.select("session_id", "i", *columns), "i", max(size, n), before=half, after=n)
    rms = [F.sqrt(F.sum(F.col(c) * F.col(c)).over(frame) / n).alias(c) for c in columns]
    return placed.select("session_id", "i", OWN, *rms).filter(OWN).drop(OWN)


def recent_rms(filtered: DataFrame, n: int = BICEP_SAMPLES, column: str = f"ch{BICEP_CHANNEL}", warmup: int = WINDOW,
               *, size: int = CHUNK_SAMPLES) -> DataFrame:
    """RMS of the filtered samples at the last ``n`` positions, 0 before position ``warmup`` − 1."""
    frame = Window.partitionBy("session_id", CHUNK).orderBy("i").rangeBetween(-(n - 1), 0)
    placed = with_halo(filtered.select("session_id", "i", column), "i", max(size, n), before=n)
    rms = F.sqrt(F.avg(F.col(column) * F.col(column)).over(frame))
    return placed.select(
        "session_id", "i", OWN, F.when(F.col("i") >= warmup - 1, rms).otherwise(0.0).alias("rms")
    ).filter(OWN).drop(OWN)


def hop_levels(samples: DataFrame, hop: int = HOP, n: int = BICEP_SAMPLES, column: str = f"ch{BICEP_CHANNEL}") -> DataFrame:
    """Recent RMS at every device hop: ``session_id, k, i, rms``."""
    levels = recent_rms(bandpass_stream(samples, [column]), n, column)
    first = WINDOW + hop - 1
    at = F.col("i") - first
    return levels.filter((at >= 0) & (at % hop == 0)).select("session_id", (at / hop).cast("int").alias("k"), "i", "rms")
