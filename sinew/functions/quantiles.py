"""Exact order statistics of any group size.

``percentile`` keeps a group's values in one buffer. Here values are counted in equal cells
between a group's extremes, only the cells that hold a wanted rank are kept, and these are cut once
more. What is left, a part in millions of a group's range, is ranked by a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sinew.session import settle

CELLS = 4096
ROUNDS = 2


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str],
                    *, cells: int = CELLS) -> DataFrame:
    """Linear-interpolated quantiles per group, one column per probability."""
    by = list(by)
    # Read once per step below, so the counted values are settled first.
    rows = settle(df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n")))
    totals = rows.groupBy(*by).agg(F.sum("_n").alias("_total"))
    wanted = totals.select(
        *by,
        F.explode(
            F.array(*[
                F.struct(F.lit(t).alias("t"), (F.lit(float(q)) * (F.col("_total") - 1)).alias("at"))
                for t, q in enumerate(probs)
            ])
        ).alias("_q"),
    )
    low, high = F.floor("_q.at"), F.ceil("_q.at")
    targets = wanted.select(
        *by, F.col("_q.t").alias("_t"), F.explode(F.array_distinct(F.array(low, high))).alias("_rank"),
        (F.col("_q.at") - low).alias("_part"), low.alias("_low"),
    ).withColumn("_upper", F.col("_rank") > F.col("_low")).drop("_low")
    found = _select(rows, by, targets, cells)
    pairs = found.groupBy(*by, "_t", "_part").agg(
        F.max(F.when(~F.col("_upper"), F.col("_v"))).alias("_a"), F.max(F.when(F.col("_upper"), F.col("_v"))).alias("_b")
    )
    out = F.col("_a") + F.when(F.col("_b").isNull(), 0.0).otherwise((F.col("_b") - F.col("_a")) * F.col("_part"))
    return pairs.groupBy(*by).agg(*[F.max(F.when(F.col("_t") == t, out)).alias(n) for t, n in enumerate(names)])


def _select(rows: DataFrame, by: list[str], targets: DataFrame, cells: int, depth: int = 0) -> DataFrame:
    """Value at each target's 0-based rank within its group."""
    cell = f"_cell{depth}"
    bounds = rows.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    place = F.when(span > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / span * cells), F.lit(cells - 1))).otherwise(0)
    placed = rows.join(bounds, by).select(*by, "_v", "_n", place.cast("long").alias(cell))
    histogram = placed.groupBy(*by, cell).agg(F.sum("_n").alias("_in"))
    before = Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    histogram = histogram.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    t, h = targets.alias("t"), histogram.alias("h")
    on = (F.col("t._rank") >= F.col("h._before")) & (F.col("t._rank") < F.col("h._before") + F.col("h._in"))
    for b in by:
        on = on & (F.col(f"t.{b}") == F.col(f"h.{b}"))
    hit = t.join(h, on).select(
        *[F.col(f"t.{c}") for c in targets.columns if c != "_rank"],
        F.col(f"h.{cell}"), (F.col("t._rank") - F.col("h._before")).alias("_rank"),
    )
    kept = placed.join(hit.select(*by, cell).distinct(), [*by, cell], "left_semi")
    inner = [*by, cell]
    if depth + 1 < ROUNDS:
        return _select(kept, inner, hit, cells, depth + 1).drop(cell)
    running = Window.partitionBy(*inner).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    numbered = kept.withColumn("_upto", F.sum("_n").over(running))
    n = numbered.alias("n")
    g = hit.alias("g")
    on = (F.col("g._rank") < F.col("n._upto")) & (F.col("g._rank") >= F.col("n._upto") - F.col("n._n"))
    for b in inner:
        on = on & (F.col(f"g.{b}") == F.col(f"n.{b}"))
    return g.join(n, on).select(*[F.col(f"g.{c}") for c in hit.columns if c not in (cell, "_rank")], F.col("n._v"))
