"""Turning per-window probability vectors into stable outputs.

``rows`` has ``session_id, k, p``; ``k`` may have holes, as windows over lost samples are absent. Every
step goes from row to row, so averages and votes count rows, not positions, as a stream does. Averages
with bounded memory run over chunks with a halo, fill-forward steps as prefix scans, so a session of any
length is cut by many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sinew.constants import DEBOUNCE, EMA_KEEP, ENTER, HOLD, REJECT, VOTES
from sinew.ordered import CHUNK, OWN, Scan, chunk_of, dense_index, running, with_halo, with_neighbours

CHUNK_ROWS = 4096


def _reach(keep: float) -> int:
    """Rows after which an average has forgotten a value below double precision."""
    return max(1, math.ceil(math.log(1e-17) / math.log(keep)))


def averaged(rows: DataFrame, values: Sequence[Column], keep: float, start: float, names: Sequence[str],
             *, order: str = "k", size: int | None = None) -> DataFrame:
    """Exponential averages s_t = keep·s_(t−1) + (1−keep)·v_t of non-negative values, t the row's rank by ``order``.

    Inside a chunk the recurrence is a running sum of v_t·keep^−t scaled back by keep^t: one window
    sum per value, no fold. All terms have one sign, so nothing cancels; the chunk length keeps
    the powers far from overflow.
    """
    if keep <= 0:
        return rows.select("*", *[v.alias(n) for v, n in zip(values, names)])
    kept, rank = rows.columns, "_rank"
    rows, order = dense_index(rows, ["session_id"], [order], chunk_of(order, size or 1024), rank), rank
    halo = _reach(keep)
    limit = int(600 / -math.log(keep)) - halo
    size = max(halo, min(size or 1024, limit))
    placed = with_halo(rows, order, size, before=halo)
    base = F.greatest(F.col(CHUNK) * size - halo, F.lit(0))
    step = (F.col(order) - base).cast("double")
    frame = Window.partitionBy("session_id", CHUNK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    weight = F.pow(F.lit(1.0 / keep), step)
    shrink = F.pow(F.lit(keep), step)
    memory = F.lit(start) * F.pow(F.lit(keep), (F.col(order) + 1).cast("double"))
    sums = placed.select(
        "*", *[((1 - keep) * F.sum(v * weight).over(frame)).alias(f"_s_{n}") for v, n in zip(values, names)]
    )
    return sums.filter(OWN).select(*kept, *[(F.col(f"_s_{n}") * shrink + memory).alias(n) for n in names])


def ema(rows: DataFrame, classes: int, keep: float = EMA_KEEP, *, size: int | None = None) -> DataFrame:
    """Add ``s``, the smoothed probability vector, starting from the uniform one."""
    names = [f"_e{c}" for c in range(classes)]
    out = averaged(rows, [F.get("p", F.lit(c)) for c in range(classes)], keep, 1.0 / classes, names, size=size)
    return out.select(*rows.columns, F.array(*names).alias("s"))


def winner(p: str | Column = "p") -> Column:
    """Position of the first maximum."""
    p = F.col(p) if isinstance(p, str) else p
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def smoothed(rows: DataFrame, classes: int, keep: float = EMA_KEEP, *, size: int | None = None) -> DataFrame:
    """``session_id, k, raw, winner, conf`` of the averaged vectors."""
    averaged_rows = ema(rows.select("session_id", "k", "p"), classes, keep, size=size)
    return averaged_rows.select(
        "session_id", "k", winner("p").alias("raw"), winner("s").alias("winner"), F.array_max("s").alias("conf")
    )


def smooth_hysteresis(
    rows: DataFrame, classes: int, keep: float = EMA_KEEP, enter: float = ENTER, hold: float = HOLD,
    *, size: int = CHUNK_ROWS,
) -> DataFrame:
    """Hard to adopt a class, easy to keep it. Adds ``output`` (−1 before the first) to ``smoothed``.

    With enter ≥ hold the state is the latest winner that reached ``enter``, or, before any did,
    the first winner that reached ``hold``.
    """
    if enter < hold:
        raise ValueError("enter must not be below hold")
    base = smoothed(rows, classes, keep, size=size)
    scans = {
        "_adopted": Scan("last", F.when(F.col("conf") >= enter, F.col("winner"))),
        "_opening": Scan("first", F.when(F.col("conf") >= hold, F.col("winner"))),
    }
    done = running(base, ["session_id"], ["k"], chunk_of("k", size), scans)
    return done.select(*base.columns, F.coalesce("_adopted", "_opening", F.lit(-1)).alias("output"))


def _majority(history: Column) -> Column:
    """(winner, count) of the most frequent value, ties to the one seen first in the history."""
    counted = F.transform(
        F.array_distinct(history), lambda v: F.struct(v.alias("v"), F.size(F.filter(history, lambda h: h == v)).alias("n"))
    )
    return F.aggregate(
        counted, F.struct(F.lit(-1).alias("v"), F.lit(0).alias("n")),
        lambda best, c: F.when(c["n"] > best["n"], c).otherwise(best),
    )


def smooth_vote_debounce(
    rows: DataFrame, classes: int, keep: float = EMA_KEEP, reject: float = REJECT, votes: int = VOTES,
    debounce: int = DEBOUNCE, *, size: int = CHUNK_ROWS,
) -> DataFrame:
    """Average, reject weak rows, vote over the last accepted rows, switch after equal votes in a row.

    Adds ``rejected, majority, confidence, output`` to ``smoothed``. Votes and debounce only see
    accepted rows: every row carries the number of accepted rows up to it, and the frames run over the accepted rows of a chunk
    of such numbers and the few before it. Rejected rows go along beside them, so nothing is joined back; the output is
    filled forward over all rows. A run of D equal votes reaches back D − 1 accepted rows, and a change needs at least two.
    """
    base = smoothed(rows, classes, keep, size=size)
    accepted = F.col("conf") >= reject
    numbered = running(base, ["session_id"], ["k"], chunk_of("k", size), {"_a": Scan("sum", accepted.cast("long"))})
    length = max(2, debounce)
    # Rejected rows stand at the number of the accepted row before them; only accepted rows are copied as a halo.
    width = max(size, votes + length)
    at, accepted = F.col("_a") - 1, F.col("conf") >= reject
    home = F.floor(at / width)
    halo = F.when(accepted & (at - home * width >= width - votes - length), home + 1)
    placed = numbered.withColumn(CHUNK, F.explode(F.array_compact(F.array(home, halo)))).withColumn(OWN, F.col(CHUNK) == home)
    frame = Window.partitionBy("session_id", CHUNK, accepted).orderBy("_a", "k")
    vote = _majority(F.collect_list(F.when(accepted, F.col("winner"))).over(frame.rowsBetween(-(votes - 1), 0)))
    voted = placed.withColumn("_m", F.when(accepted, vote))
    recent = F.collect_list("_m.v").over(frame.rowsBetween(-(length - 1), 0))
    steady = accepted & (F.size(F.array_distinct(recent)) == 1) & (F.size(recent) == length)
    decided = voted.withColumn("_switch", F.when(steady, F.col("_m.v"))).filter(OWN).select(
        *base.columns, F.col("_m.v").alias("majority"), (F.col("_m.n") / F.least(F.lit(votes), F.col("_a"))).alias("_share"), "_switch",
    )
    done = running(
        decided, ["session_id"], ["k"], chunk_of("k", size),
        {"_latest": Scan("last", F.col("_switch")), "_opening": Scan("first", F.col("majority"))},
    )
    return done.select(
        *base.columns,
        F.col("majority").isNull().alias("rejected"),
        "majority",
        F.coalesce("_share", "conf").alias("confidence"),
        F.coalesce("_latest", "_opening", F.lit(-1)).alias("output"),
    )


def with_changes(outputs: DataFrame, column: str = "output", *, size: int = CHUNK_ROWS) -> DataFrame:
    """Add ``changed``: the output differs from the one before; a first output counts as no change."""
    placed = with_neighbours(outputs, ["session_id"], "k", [column], chunk_of("k", size))
    before = F.col(f"prev_{column}")
    return placed.withColumn("changed", F.coalesce((before != F.col(column)) & (before != -1), F.lit(False))).drop(f"prev_{column}")


def stability_stats(outputs: DataFrame, *, size: int = CHUNK_ROWS) -> DataFrame:
    """Predictions, output changes and 1 − changes/predictions per session."""
    flagged = with_changes(outputs, size=size)
    return flagged.groupBy("session_id").agg(
        F.count("*").alias("predictions"),
        F.sum(F.col("changed").cast("long")).alias("changes"),
    ).withColumn("stability", 1 - F.col("changes") / F.greatest(F.lit(1), F.col("predictions")))


def raw_vs_smoothed(outputs: DataFrame) -> DataFrame:
    """What is shown (raw until a first output) and whether it differs from the raw class."""
    shown = F.when(F.col("output") == -1, F.col("raw")).otherwise(F.col("output"))
    return outputs.select("session_id", "k", "raw", shown.alias("shown"), (shown != F.col("raw")).alias("differs"))


def prediction_events(outputs: DataFrame, column: str = "output", *, none=-1, size: int = CHUNK_ROWS) -> DataFrame:
    """Only rows at which there is an output (not ``none``) and it is not the one before."""
    flagged = with_neighbours(outputs, ["session_id"], "k", [column], chunk_of("k", size))
    before = F.col(f"prev_{column}")
    fresh = (F.col(column) != none) & (before.isNull() | (before != F.col(column)))
    return flagged.filter(fresh).drop(f"prev_{column}")


def reject_rate_by_run(outputs: DataFrame, *, size: int = CHUNK_ROWS) -> DataFrame:
    """Share of rejected rows between one output change and the next."""
    placed = with_neighbours(outputs.select("session_id", "k", "output", "rejected"), ["session_id"], "k", ["output"], chunk_of("k", size))
    moved = placed.withColumn("_moved", (F.coalesce("prev_output", F.lit(-1)) != F.col("output")).cast("long"))
    runs = running(moved, ["session_id"], ["k"], chunk_of("k", size), {"run": Scan("sum", F.col("_moved"))})
    return runs.groupBy("session_id", "run").agg(
        F.min("k").alias("from_k"),
        F.max("output").alias("output"),
        F.count("*").alias("predictions"),
        F.avg(F.col("rejected").cast("double")).alias("reject_rate"),
    )
