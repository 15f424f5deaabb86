"""Ordered work inside one key without putting the key into one task.

A session can hold a large share of all rows, so nothing here partitions by the session alone
except tables that have one row per chunk. Two building blocks cover every ordered operator:

* ``with_halo``: rows are spread over (key, chunk) groups; each chunk also receives the few
  neighbouring rows its frames reach into. For frames and filters of bounded reach.
* ``running``: an exact prefix scan. Running values are computed inside each chunk, one summary
  row per chunk is scanned per key, and the value at the chunk's entrance is joined back. For
  unbounded reach (fill forward, run boundaries, running counts).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
OWN = "_own"


def chunk_of(order: str, size: int) -> Column:
    return F.floor(F.col(order) / F.lit(size)).cast("long")


def with_halo(df: DataFrame, order: str, size: int, *, before: int = 0, after: int = 0) -> DataFrame:
    """Assign rows to chunks of ``size`` consecutive ``order`` values plus their halo.

    ``before``/``after`` is how many order units a chunk needs from its predecessor/successor.
    Adds ``_chunk`` and ``_own`` (false on halo copies).
    """
    if before > size or after > size:
        raise ValueError("halo must not be longer than a chunk")
    home = chunk_of(order, size)
    offset = F.col(order) - home * F.lit(size)
    copies = [home]
    if before:
        copies.append(F.when(offset >= size - before, home + 1))
    if after:
        copies.append(F.when((offset < after) & (home > 0), home - 1))
    placed = df.withColumn(CHUNK, F.explode(F.array_compact(F.array(*copies))))
    return placed.withColumn(OWN, F.col(CHUNK) == home)


def stretches(at: np.ndarray) -> list[tuple[int, int]]:
    """Runs without a hole, as (begin, end) positions."""
    cuts = np.flatnonzero(np.diff(at) != 1) + 1
    edges = [0, *cuts.tolist(), len(at)]
    return list(zip(edges[:-1], edges[1:]))


@dataclass(frozen=True)
class Scan:
    """One running value: ``kind`` is sum, max, min, last or first (the last two skip nulls)."""

    kind: str
    value: Column
    reverse: bool = False
    exclusive: bool = False


def _fold(kind: str, value: Column) -> Column:
    if kind == "sum":
        return F.sum(value)
    if kind == "max":
        return F.max(value)
    if kind == "min":
        return F.min(value)
    if kind == "last":
        return F.last(value, ignorenulls=True)
    if kind == "first":
        return F.first(value, ignorenulls=True)
    raise ValueError(f"unknown scan kind {kind!r}")


def _summary(scan: Scan, position: Column) -> Column:
    if scan.kind in ("sum", "max", "min"):
        return _fold(scan.kind, scan.value)
    latest = (scan.kind == "last") != scan.reverse
    pick = F.max_by if latest else F.min_by
    return pick(scan.value, F.when(scan.value.isNotNull(), position))


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried + local, carried, local)
    if kind == "max":
        return F.greatest(carried, local)
    if kind == "min":
        return F.least(carried, local)
    return F.coalesce(local, carried) if kind == "last" else F.coalesce(carried, local)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    scans: Mapping[str, Scan],
) -> DataFrame:
    """Add running values over each key in ``order``; exact for any key size.

    ``chunk`` must not decrease along ``order``. Rows of one (key, chunk) form one window group;
    the scan over chunk summaries is the only step that partitions by key alone.
    """
    keys, order = list(keys), list(order)
    placed = df.withColumn(CHUNK, chunk)
    position = F.struct(*order)

    def frames(by: Sequence[str], sort: Sequence[str], reverse: bool, last: int):
        columns = [F.col(c).desc() if reverse else F.col(c).asc() for c in sort]
        return Window.partitionBy(*by).orderBy(*columns).rowsBetween(Window.unboundedPreceding, last)

    by_chunk = [*keys, CHUNK]
    local = placed.select(
        "*",
        *[
            _fold(s.kind, s.value)
            .over(frames(by_chunk, order, s.reverse, -1 if s.exclusive else 0))
            .alias(f"_local_{name}")
            for name, s in scans.items()
        ],
    )
    totals = placed.groupBy(*by_chunk).agg(*[_summary(s, position).alias(f"_sum_{n}") for n, s in scans.items()])
    carried = totals.select(
        *by_chunk,
        *[
            _fold(s.kind, F.col(f"_sum_{n}")).over(frames(keys, [CHUNK], s.reverse, -1)).alias(f"_carry_{n}")
            for n, s in scans.items()
        ],
    )
    joined = local.join(carried, by_chunk, "left")
    return joined.select(
        *df.columns,
        *[_combine(s.kind, F.col(f"_carry_{n}"), F.col(f"_local_{n}")).alias(n) for n, s in scans.items()],
    )


def with_neighbours(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], chunk: Column, *, before: bool = True, after: bool = False
) -> DataFrame:
    """Add ``prev_*`` and/or ``next_*``: values of the row before and after, however far away it is.

    Positions may have holes, so the neighbour comes from a prefix scan and not from a halo.
    """
    value = F.struct(*columns)
    scans = {}
    if before:
        scans["_prev"] = Scan("last", value, exclusive=True)
    if after:
        scans["_next"] = Scan("last", value, reverse=True, exclusive=True)
    done = running(df, keys, [order], chunk, scans)
    return done.select(
        *df.columns,
        *[F.col(f"_prev.{c}").alias(f"prev_{c}") for c in columns if before],
        *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns if after],
    )


def dense_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str = "i"
) -> DataFrame:
    """Consecutive numbers 0, 1, … per key in ``order`` (which must be unique)."""
    counted = running(df, keys, order, chunk, {name: Scan("sum", F.lit(1).cast("long"))})
    return counted.withColumn(name, F.col(name) - 1)


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    *,
    tie: str | None = None,
    width: float,
) -> DataFrame:
    """Latest ``right`` row at or before each ``left`` row; ``tie`` orders equal right times.

    A union and one running scan over time chunks of ``width``: no pairs are formed, so the work
    is linear in both inputs.
    """
    return _asof(left, right, keys, left_time, right_time, values, tie, width, forward=False)


def asof_nearest(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
    values: Sequence[str], *, width: float,
) -> DataFrame:
    """Nearest ``right`` row in time, ties to the earlier one; adds ``distance``."""
    both = _asof(left, right, keys, left_time, right_time, values, None, width, forward=True)
    back = F.col(left_time) - F.col("_before.t")
    ahead = F.col("_after.t") - F.col(left_time)
    use_back = F.col("_after").isNull() | (back <= ahead)
    keep = [c for c in both.columns if c not in ("_before", "_after")]
    return both.select(
        *keep,
        *[F.when(use_back, F.col(f"_before.{v}")).otherwise(F.col(f"_after.{v}")).alias(v) for v in values],
        F.when(use_back, back).otherwise(ahead).alias("distance"),
    )


def _asof(left, right, keys, left_time, right_time, values, tie, width, forward):
    keys = list(keys)
    payload = F.struct(F.col(right_time).alias("t"), *[F.col(v) for v in values])
    marks = right.select(
        *keys,
        F.col(right_time).cast("double").alias("_t"),
        F.lit(0).alias("_side"),
        (F.col(tie) if tie else F.lit(0)).cast("long").alias("_tie"),
        payload.alias("_mark"),
    )
    rows = left.select(
        *keys,
        F.col(left_time).cast("double").alias("_t"),
        F.lit(1).alias("_side"),
        F.lit(0).cast("long").alias("_tie"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_row"),
    )
    merged = marks.unionByName(rows, allowMissingColumns=True)
    scans = {"_before": Scan("last", F.col("_mark"))}
    if forward:
        scans["_after"] = Scan("last", F.col("_mark"), reverse=True)
    scanned = running(
        merged, keys, ["_t", "_side", "_tie"], F.floor(F.col("_t") / F.lit(width)).cast("long"), scans
    ).filter(F.col("_side") == 1)
    if forward:
        return scanned.select("_row.*", "_before", "_after")
    return scanned.select("_row.*", *[F.col(f"_before.{v}").alias(v) for v in values])


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    at: Column,
    start: str,
    end: str,
    values: Sequence[str],
    *,
    width: float,
) -> DataFrame:
    """Left join of points to the half-open interval [start, end) that holds them.

    Intervals are cut along a grid of ``width`` so the join is an equi join on (key, cell): a
    large key spreads over its cells and a point only meets intervals of its own cell.
    """
    keys = list(keys)
    cell = "_cell"
    grid = intervals.select(
        *keys,
        F.col(start).alias("_from"),
        F.col(end).alias("_to"),
        *values,
        F.explode(
            F.sequence(
                F.floor(F.col(start) / F.lit(width)).cast("long"),
                F.floor(F.col(end) / F.lit(width)).cast("long"),
            )
        ).alias(cell),
    )
    located = points.withColumn("_at", at).withColumn(cell, F.floor(F.col("_at") / F.lit(width)).cast("long"))
    p, g = located.alias("p"), grid.alias("g")
    match = [F.col(f"p.{k}") == F.col(f"g.{k}") for k in [*keys, cell]]
    inside = (F.col("p._at") >= F.col("g._from")) & (F.col("p._at") < F.col("g._to"))
    condition = inside
    for m in match:
        condition = condition & m
    return p.join(g, condition, "left").select(
        *[F.col(f"p.{c}") for c in points.columns], *[F.col(f"g.{v}") for v in values]
    )
