"""Feature extraction.

The signal crosses into Python once, as packed chunks of many windows (``extract_features``), and
every step there works on the whole stack of windows. Tables that already hold windows use
``features_of_windows``. Results are ``session_id, k, f``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sinew.constants import (
    BASIC_FEATURES,
    CHANNEL_FEATURES,
    HAND_CHANNELS,
    HOP,
    PAIR_FEATURES,
    SSC_SHARE,
    WINDOW,
    ZC_SHARE,
)
from sinew.functions import arrow, signal
from sinew.functions.columns import centred, let, sum_squares, total
from sinew.operators.windows import CHUNK_SAMPLES, pack
from sinew.ordered import CHUNK, stretches


@dataclass(frozen=True)
class FeatureOptions:
    """Switches of the feature vector; the defaults give the 69 values of the deployed model."""

    channels: tuple[int, ...] = HAND_CHANNELS
    bandpass: bool = True
    reinhard: bool = True
    expanded: bool = True
    normalize: bool = True
    cross_channel: bool = True

    @classmethod
    def td4(cls, channels: tuple[int, ...] = HAND_CHANNELS) -> "FeatureOptions":
        """The four time-domain values per channel of the earliest models."""
        return cls(channels, bandpass=False, reinhard=False, expanded=False, normalize=False, cross_channel=False)

    def names(self) -> list[str]:
        keys = CHANNEL_FEATURES if self.expanded else BASIC_FEATURES
        names = [f"ch{c}_{key}" for c in self.channels for key in keys]
        if self.expanded and self.cross_channel and len(self.channels) >= 2:
            pairs = [(a, b) for n, a in enumerate(self.channels) for b in self.channels[n + 1 :]]
            names += [f"cc_{a}{b}_{key}" for a, b in pairs for key in PAIR_FEATURES]
        return names

    def switches(self) -> dict[str, bool]:
        return {k: v for k, v in asdict(self).items() if k != "channels"}


def _schema(df: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([df.schema["session_id"], T.StructField("k", T.IntegerType()), *fields])


VECTOR = T.StructField("f", T.ArrayType(T.DoubleType()))


def chunk_windows(
    samples: DataFrame,
    kernel: Callable[[np.ndarray], dict[str, pa.Array]],
    fields: Sequence[T.StructField],
    *,
    channels: Sequence[int],
    size: int = WINDOW,
    hop: int = HOP,
    first: int = 0,
    continuous: bool = False,
    chunk: int = CHUNK_SAMPLES,
) -> DataFrame:
    """Apply ``kernel`` to the windows (n, size, channels) of every packed chunk.

    ``continuous`` runs the band-pass over the session instead of inside each window: chunks then
    also carry the samples before them that the filter still remembers.
    """
    columns = [f"ch{c}" for c in channels]
    memory = signal.BANDPASS_TAPS if continuous else 0
    chunk = max(chunk, size, memory)
    packed = pack(samples, columns, size=chunk, before=memory, after=size - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        response = signal.impulse_response(*signal.BANDPASS, signal.BANDPASS_TAPS)
        for batch in batches:
            positions = arrow.ragged(batch.column("i"))
            tracks = [arrow.ragged(batch.column(c)) for c in columns]
            homes = batch.column(CHUNK).to_numpy()
            for row, at in enumerate(positions):
                x = np.stack([t[row] for t in tracks], axis=1)
                low, high = homes[row] * chunk, (homes[row] + 1) * chunk
                for begin, end in stretches(at):
                    part, start = x[begin:end], int(at[begin])
                    if continuous:
                        part = signal.convolve_causal(part, response)
                    # First window that opens inside this chunk and this stretch.
                    k0 = max(0, -(-(max(low, start) - first) // hop))
                    offset = first + k0 * hop - start
                    stop = min(end - begin, high - start + size - 1)
                    if offset < 0 or offset + size > stop:
                        continue
                    stack = signal.sliding(part[offset:stop], size, hop)
                    result = kernel(stack)
                    keys = batch.column("session_id").take(pa.array(np.full(len(stack), row)))
                    ks = pa.array(np.arange(k0, k0 + len(stack), dtype=np.int32))
                    yield arrow.batch({"session_id": keys, "k": ks, **result})

    return packed.mapInArrow(run, _schema(samples, *fields))


def extract_features(
    samples: DataFrame,
    options: FeatureOptions = FeatureOptions(),
    *,
    size: int = WINDOW,
    hop: int = HOP,
    first: int = 0,
    continuous: bool = False,
    chunk: int = CHUNK_SAMPLES,
) -> DataFrame:
    """Feature vector of every sliding window, straight from samples.

    ``continuous=True, first=hop`` is the device's way (session-long filter, first window
    skipped); the default is the training way (filter restarted in each window).
    """
    switches = options.switches()
    if continuous:
        switches["bandpass"] = False

    def kernel(stack: np.ndarray) -> dict[str, pa.Array]:
        return {"f": arrow.list_column(signal.window_features(stack, **switches))}

    return chunk_windows(
        samples, kernel, [VECTOR], channels=options.channels, size=size, hop=hop, first=first,
        continuous=continuous, chunk=chunk,
    )


def _over_windows(windows: DataFrame, keep: Sequence[str], kernel, fields) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kept = {c: batch.column(c) for c in keep}
                yield arrow.batch({**kept, **kernel(arrow.cube(batch.column("x")))})

    schema = T.StructType([*[windows.schema[c] for c in keep], *fields])
    return windows.select(*keep, "x").mapInArrow(run, schema)


def features_of_windows(
    windows: DataFrame, options: FeatureOptions = FeatureOptions(), keep: Sequence[str] = ("session_id", "k")
) -> DataFrame:
    """Feature vectors of a table that already holds windows; no shuffle."""
    switches, channels = options.switches(), list(options.channels)

    def kernel(stack: np.ndarray) -> dict[str, pa.Array]:
        return {"f": arrow.list_column(signal.window_features(stack[:, :, channels], **switches))}

    return _over_windows(windows, keep, kernel, [VECTOR])


def cross_spectrum(samples: DataFrame, channels: Sequence[int] = HAND_CHANNELS, **options) -> DataFrame:
    """36 band-wise cross-spectral values of each raw window."""

    def kernel(stack: np.ndarray) -> dict[str, pa.Array]:
        return {"f": arrow.list_column(signal.cross_spectrum_features(stack))}

    return chunk_windows(samples, kernel, [VECTOR], channels=channels, **options)


def power_spectrum(samples: DataFrame, channels: Sequence[int] = HAND_CHANNELS, **options) -> DataFrame:
    """129 power values per window and channel of the prepared signal: ``session_id, k, channel, p``."""

    def kernel(stack: np.ndarray) -> dict[str, pa.Array]:
        x = signal.tone_map(signal.remove_dc(signal.bandpass_windows(stack)))
        spec = np.moveaxis(signal.power_spectrum(x), 2, 1)
        n, c, bins = spec.shape
        nested = pa.ListArray.from_arrays(
            pa.array(np.arange(n + 1, dtype=np.int32) * c), arrow.list_column(spec.reshape(n * c, bins))
        )
        return {"p": nested}

    field = T.StructField("p", T.ArrayType(T.ArrayType(T.DoubleType())))
    spectra = chunk_windows(samples, kernel, [field], channels=channels, **options)
    names = F.array(*[F.lit(c) for c in channels])
    return spectra.select(
        "session_id", "k", F.explode(F.arrays_zip(names.alias("channel"), F.col("p"))).alias("s")
    ).select("session_id", "k", F.col("s.channel").alias("channel"), F.col("s.p").alias("p"))


def by_name(features: DataFrame, options: FeatureOptions, wanted: Sequence[str] | None = None) -> DataFrame:
    """One column per feature name."""
    names = options.names()
    wanted = list(wanted or names)
    keep = [c for c in features.columns if c != "f"]
    return features.select(*keep, *[F.get("f", F.lit(names.index(n))).alias(n) for n in wanted])


def long_form(features: DataFrame, options: FeatureOptions | None = None) -> DataFrame:
    """One row per feature: position, value and, given options, name."""
    keep = [c for c in features.columns if c != "f"]
    rows = features.select(*keep, F.posexplode("f").alias("pos", "value"))
    if options is None:
        return rows
    names = F.array(*[F.lit(n) for n in options.names()])
    return rows.withColumn("name", F.get(names, F.col("pos")))


def td4_tumbling(filtered: DataFrame, n: int, columns: Sequence[str], zc: float = 0.7, ssc: float = 0.6) -> DataFrame:
    """rms, wl, zc, ssc on windows without overlap, thresholds from the RMS of the whole session.

    ``filtered`` is the session-wide filtered signal. The thresholds are one aggregate per
    session; windows then only need their own samples.
    """
    from sinew.operators.windows import tumbling_windows

    limits = filtered.groupBy("session_id").agg(
        F.array(*[F.sqrt(F.avg(F.col(c) * F.col(c))) for c in columns]).alias("_rms")
    )
    windows = tumbling_windows(filtered, n, columns).join(limits, "session_id")
    keep = ["session_id", "k"]
    names = [f"{c}_{key}" for c in columns for key in BASIC_FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, rms = arrow.cube(batch.column("x")), arrow.matrix(batch.column("_rms"))
            values = signal.basic_features(x, zc * rms, (ssc * rms) ** 2)
            stacked = np.stack([values[key] for key in BASIC_FEATURES], axis=-1).reshape(len(x), -1)
            yield arrow.batch({**{c: batch.column(c) for c in keep}, "f": arrow.list_column(stacked)})

    schema = T.StructType([*[windows.schema[c] for c in keep], VECTOR])
    vectors = windows.select(*keep, "x", "_rms").mapInArrow(run, schema)
    return vectors.select(*keep, *[F.get("f", F.lit(n)).alias(name) for n, name in enumerate(names)])


def td4_native(samples: DataFrame, channels: Sequence[int] = HAND_CHANNELS, size: int = WINDOW, hop: int = HOP,
               chunk: int = CHUNK_SAMPLES) -> DataFrame:
    """rms, wl, zc, ssc of DC-free windows with JVM expressions only, one row per channel.

    A second way to the same numbers as the Arrow kernel; the tests hold them against each other.
    """
    from sinew.operators.windows import sliding_windows

    columns = [f"ch{c}" for c in channels]
    windows = sliding_windows(samples, size, hop, columns=columns, chunk=chunk)
    rows = windows.select(
        "session_id", "k",
        F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in channels]).alias("channel"), F.col("x"))).alias("w"),
    ).select("session_id", "k", F.col("w.channel").alias("channel"), F.col("w.x").alias("x"))
    count = lambda flags: F.size(F.filter(flags, lambda v: v)).cast("double")

    def measures(x: Column) -> Column:
        return let(F.sqrt(sum_squares(x) / size), lambda rms: let(steps(x), lambda d: measured(x, rms, d)))

    def steps(x: Column) -> Column:
        return F.zip_with(F.slice(x, 1, size - 1), F.slice(x, 2, size - 1), lambda a, b: b - a)

    def measured(x: Column, rms: Column, d: Column) -> Column:
        zc_limit, ssc_limit = ZC_SHARE * rms, (SSC_SHARE * rms) * (SSC_SHARE * rms)
        crossing = F.zip_with(
            F.slice(x, 1, size - 1), F.slice(x, 2, size - 1), lambda a, b: (a * b < 0) & (F.abs(b - a) > zc_limit)
        )
        turning = F.zip_with(F.slice(d, 1, size - 2), F.slice(d, 2, size - 2), lambda left, right: -left * right > ssc_limit)
        return F.struct(
            rms.alias("rms"), total(F.transform(d, F.abs)).alias("wl"), count(crossing).alias("zc"), count(turning).alias("ssc")
        )

    return rows.select("session_id", "k", "channel", let(centred(F.col("x")), measures).alias("_m")).select(
        "session_id", "k", "channel", "_m.*"
    )
