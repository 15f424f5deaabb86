"""Cutting sample tables into windows and putting windows back together.

``samples`` has ``session_id, i, ts, ch0..`` with a dense ``i`` per session. Samples are packed
once into (session, chunk) groups that carry the few samples their last window reaches into, so a
long session is cut by many tasks and no sample row is copied per overlapping window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinew.constants import HOP, RATE_HZ, WINDOW
from sinew.functions.columns import centred, sum_squares, total
from sinew.ordered import CHUNK, chunk_of, with_halo, with_neighbours

CHUNK_SAMPLES = 6400
CHANNEL_COLUMNS = ("ch0", "ch1", "ch2", "ch3")


def pack(
    samples: DataFrame,
    columns: Sequence[str],
    *,
    size: int = CHUNK_SAMPLES,
    before: int = 0,
    after: int = 0,
    order: str = "i",
) -> DataFrame:
    """One row per (session, chunk): its positions and columns as arrays in order."""
    placed = with_halo(samples.select("session_id", order, *columns), order, size, before=before, after=after)
    rows = F.sort_array(F.collect_list(F.struct(order, *columns)))
    return (
        placed.groupBy("session_id", CHUNK)
        .agg(rows.alias("_rows"))
        .select("session_id", CHUNK, *[F.col(f"_rows.{c}").alias(c) for c in (order, *columns)])
    )


def sliding_windows(
    samples: DataFrame,
    size: int = WINDOW,
    hop: int = HOP,
    *,
    first: int = 0,
    columns: Sequence[str] = CHANNEL_COLUMNS,
    chunk: int = CHUNK_SAMPLES,
) -> DataFrame:
    """Complete windows; window k holds samples first + hop·k … + size − 1.

    A window that would span a hole in ``i`` is not complete and is left out. Result:
    ``session_id, k, start_time, end_time, x`` with ``x`` channel-major.
    """
    chunk = max(chunk, size)
    packed = pack(samples, ("ts", *columns), size=chunk, after=size - 1)
    lowest = F.greatest(F.ceil((F.col(CHUNK) * chunk - first) / hop), F.lit(0)).cast("long")
    highest = F.floor((F.least((F.col(CHUNK) + 1) * chunk - 1, F.element_at("i", -1) - size + 1) - first) / hop)
    at = F.array_position("i", F.col("k") * hop + first).cast("int")
    cut = packed.withColumn(
        "k", F.explode(F.when(highest >= lowest, F.sequence(lowest, highest.cast("long"))))
    ).withColumn("_at", F.col("k") * hop + first - F.col("i")[0] + 1)
    # Dense chunks are addressed by arithmetic; only a chunk with a hole searches its position.
    dense = F.element_at("i", -1) - F.col("i")[0] + 1 == F.size("i")
    cut = cut.withColumn("_at", F.when(dense, F.col("_at").cast("int")).otherwise(at)).filter(F.col("_at") > 0)
    last = F.col("_at") + size - 1
    whole = (last <= F.size("i")) & (
        F.get("i", last - 1) - F.get("i", F.col("_at") - 1) == size - 1
    )
    return cut.filter(whole).select(
        "session_id",
        F.col("k").cast("int").alias("k"),
        F.get("ts", F.col("_at") - 1).alias("start_time"),
        F.get("ts", last - 1).alias("end_time"),
        F.array(*[F.slice(c, F.col("_at"), size) for c in columns]).alias("x"),
    )


def device_windows(samples: DataFrame, size: int = WINDOW, hop: int = HOP, **options) -> DataFrame:
    """The device's phase: the first window is dropped, so window k ends at size + hop·(k+1) − 1."""
    return sliding_windows(samples, size, hop, first=hop, **options)


def ring_windows(samples: DataFrame, size: int = WINDOW, hop: int = HOP, **options) -> DataFrame:
    """Ring-buffer phase: fires when at least ``size`` samples came and their count divides by ``hop``."""
    return sliding_windows(samples, size, hop, first=-size % hop, **options)


def tumbling_windows(samples: DataFrame, n: int, columns: Sequence[str] = CHANNEL_COLUMNS) -> DataFrame:
    """floor(N/n) windows without overlap; an incomplete tail is dropped."""
    rows = F.sort_array(F.collect_list(F.struct("i", "ts", *columns)))
    return (
        samples.groupBy("session_id", F.floor(F.col("i") / n).cast("int").alias("k"))
        .agg(rows.alias("_rows"), F.count("*").alias("_n"))
        .filter(F.col("_n") == n)
        .select(
            "session_id",
            "k",
            F.col("_rows.ts")[0].alias("start_time"),
            F.element_at("_rows.ts", -1).alias("end_time"),
            F.array(*[F.col(f"_rows.{c}") for c in columns]).alias("x"),
        )
    )


def session_lengths(samples: DataFrame) -> DataFrame:
    return samples.groupBy("session_id").agg((F.max("i") + 1).alias("n"))


def flush_partial(
    samples: DataFrame, size: int = WINDOW, hop: int = HOP, columns: Sequence[str] = CHANNEL_COLUMNS
) -> DataFrame:
    """What is left in the buffer at the end: fewer than ``size`` samples, overlap included."""
    done = F.when(F.col("n") >= size, F.floor((F.col("n") - size) / hop) + 1).otherwise(0)
    tails = session_lengths(samples).select("session_id", done.cast("int").alias("k"))
    rows = F.sort_array(F.collect_list(F.struct("i", "ts", *columns)))
    return (
        samples.join(tails, "session_id")
        .filter(F.col("i") >= F.col("k") * hop)
        .groupBy("session_id", "k")
        .agg(rows.alias("_rows"))
        .select(
            "session_id",
            "k",
            F.size("_rows").alias("n"),
            F.col("_rows.ts")[0].alias("start_time"),
            F.element_at("_rows.ts", -1).alias("end_time"),
            F.array(*[F.col(f"_rows.{c}") for c in columns]).alias("x"),
        )
    )


def window_index(
    samples: DataFrame, size: int = WINDOW, hop: int = HOP, *, carry: Sequence[str] = ()
) -> DataFrame:
    """Window keys and times without their samples: ``session_id, k, start_time, end_time``.

    Reads only the rows that open or close a window and pairs them by aggregation, in one pass.
    ``carry`` takes columns of the opening row.
    """
    i = F.col("i")
    opens = i % hop == 0
    closes = (i >= size - 1) & ((i - (size - 1)) % hop == 0)
    role = lambda at, opening: F.struct(at.cast("int").alias("k"), F.lit(opening).alias("opening"))
    roles = F.array_compact(
        F.array(F.when(opens, role(i / hop, True)), F.when(closes, role((i - (size - 1)) / hop, False)))
    )
    marks = samples.filter(opens | closes).select("session_id", "ts", *carry, F.explode(roles).alias("_w"))
    start = F.max(F.when(F.col("_w.opening"), F.struct("ts", *carry)))
    end = F.max(F.when(~F.col("_w.opening"), F.col("ts")))
    paired = marks.groupBy("session_id", F.col("_w.k").alias("k")).agg(start.alias("_start"), end.alias("end_time"))
    return paired.filter(F.col("_start").isNotNull() & F.col("end_time").isNotNull()).select(
        "session_id", "k", F.col("_start.ts").alias("start_time"), "end_time", *[F.col(f"_start.{c}").alias(c) for c in carry]
    )


def reconstruct_signal(
    windows: DataFrame, hop: int = HOP, columns: Sequence[str] = CHANNEL_COLUMNS
) -> DataFrame:
    """Overlapping windows back to one row per sample; where windows overlap the later one wins.

    Each window owns its samples up to the start of the next window there is, the last one all of
    them, so nothing is exploded that an overlap would discard again. A ``label`` column, if present,
    follows the owner.
    """
    labels = [c for c in ("label",) if c in windows.columns]
    keys = with_neighbours(windows.select("session_id", "k"), ["session_id"], "k", ["k"], chunk_of("k", 4096), before=False, after=True)
    owned = F.when(F.col("next_k").isNull(), F.col("x")).otherwise(
        F.transform("x", lambda ch: F.slice(ch, F.lit(1), ((F.col("next_k") - F.col("k")) * hop).cast("int")))
    )
    zipped = F.arrays_zip(*[F.get("_x", F.lit(c)).alias(name) for c, name in enumerate(columns)])
    return (
        windows.join(keys, ["session_id", "k"])
        .withColumn("_x", owned)
        .select("session_id", "k", *labels, F.posexplode(zipped).alias("_j", "_v"))
        .select(
            "session_id",
            (F.col("k") * F.lit(hop).cast("long") + F.col("_j")).alias("i"),
            *[F.col("_v")[name].alias(name) for name in columns],
            *labels,
        )
    )


def flatten_windows(windows: DataFrame, columns: Sequence[str] = CHANNEL_COLUMNS, rate: float = RATE_HZ) -> DataFrame:
    """Windows laid end to end, overlap repeated; time is position over rate."""
    size = F.size(F.get("x", F.lit(0)))
    zipped = F.arrays_zip(*[F.get("x", F.lit(c)).alias(name) for c, name in enumerate(columns)])
    return (
        windows.select("session_id", "k", size.alias("_n"), F.posexplode(zipped).alias("_j", "_v"))
        .withColumn("pos", F.col("k").cast("long") * F.col("_n") + F.col("_j"))
        .select(
            "session_id",
            "pos",
            (F.col("pos") / rate).alias("t"),
            *[F.col("_v")[name].alias(name) for name in columns],
        )
    )


def center_global(samples: DataFrame, columns: Sequence[str] = CHANNEL_COLUMNS) -> DataFrame:
    """Each channel minus its session mean; the mean is an aggregate joined back, not a window."""
    means = samples.groupBy("session_id").agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    keep = [c for c in samples.columns if c not in columns]
    return samples.join(means, "session_id").select(
        *keep, *[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in columns]
    )


def slice_time(samples: DataFrame, start: float, length: float) -> DataFrame:
    return samples.filter((F.col("ts") >= start) & (F.col("ts") < start + length))


def drop_initial(samples: DataFrame, seconds: float = 0.5, rate: int = RATE_HZ) -> DataFrame:
    """Without the first ``seconds``; positions start again at 0."""
    n = int(seconds * rate)
    return samples.filter(F.col("i") >= n).withColumn("i", F.col("i") - n)


def window_rms(x: Column | str = "x") -> Column:
    """RMS over all samples and channels after removing each channel's mean."""
    x = F.col(x) if isinstance(x, str) else x

    squares = total(F.transform(x, lambda channel: sum_squares(centred(channel))))
    return F.sqrt(squares / (F.size(x) * F.size(F.get(x, F.lit(0)))))
