"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r(size) = cap / (1 + (cap - 1) exp(-lambda x)), x its size over its source's typical
size: the rates nearest to 1 in (bounded) entropy whose words sum to the source's target. The multipliers solve
a convex dual problem, one equation per source, by Newton steps, kept inside a bracket. All steps work on a table of
(source, size, number of documents), which holds the problem without loss. Rates are rounded into copies from the largest
size down, each size making up for the words that the sizes before gave too many or too few.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sinew.llm.frames import field, fresh_name, stored

WORDS = r"[^\x20\x09-\x0D]+"
CAP = 3.0
ROUNDS = 60  # at most; Newton needs about ten
FILES = 8  # of tables with a row per source
CLOSE = 1e-6  # of a source's target
CHUNK = 1000  # documents of one size that are ranked together


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = CAP) -> DataFrame:
    """(source, source_size, target) of a table with a row per source: shares by weight of all words, at most `cap` times the source's.

    Sources are ordered by code point, null last, and take the weights in turn. What the cap cuts off is shared again by
    weight: a source is capped if cap * size / weight is below the common level, which sorting by that ratio finds.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    ratio = F.col("source_size") * cap / F.col("weight")
    ordered = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    levels = weighted.withColumn("ratio", ratio).select(
        "source", "source_size", "weight", "ratio",
        # The common level if exactly the sources before this one are capped.
        ((F.sum("source_size").over(whole) - (F.sum("source_size").over(upto) - F.col("source_size")) * cap) / F.sum("weight").over(onward)).alias("level"),
    )
    # Sources are capped up to the first that the level does not exceed.
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(whole)
    level = F.coalesce(first["level"], F.lit(float("inf")))
    return levels.withColumn("share", level).select(
        "source", "source_size", F.least(F.col("source_size") * cap, F.col("weight") * F.col("share")).alias("target")
    )


def rate(multiplier: Column, x: Column, cap: float = CAP) -> Column:
    return F.lit(cap) / (F.lit(1.0) + F.lit(cap - 1) * F.exp(-multiplier * x))


def balanced(cells: DataFrame, wanted: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, scale, multiplier, full) of every source: Newton steps on the dual until no source moves.

    Sums are decimal, so they do not depend on the order of rows and reruns agree. `full` marks sources whose target is
    all they can give, which no finite multiplier reaches.
    """
    exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
    size, n = F.col("size").cast("double"), F.col("n").cast("double")
    scale = cells.where("size > 0").groupBy("source").agg((exact(n * size * size) / exact(n * size)).alias("scale"))
    full = F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)
    scale = scale.withColumnRenamed("source", "of")
    # The start is the solution for documents of typical size only.
    mean = F.when(~full, F.greatest(F.col("target") / F.col("source_size"), F.lit(1e-9)))
    start = F.coalesce(F.log(mean * (cap - 1) / (cap - mean)), F.lit(0.0))
    state = wanted.where("source_size > 0").join(scale, F.col("source").eqNullSafe(F.col("of"))).select(
        "source", "scale", "target", full.alias("full"), start.alias("multiplier"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high")
    )
    state = stored(state.withColumn("open", ~F.col("full")), "multipliers", files=FILES)
    for _ in range(ROUNDS):
        if state.where("open").isEmpty():
            break
        cell = cells.where("size > 0").withColumnRenamed("source", "of")
        r, x = F.col("r"), F.col("size") / F.col("scale")
        sums = (
            cell.join(state.where("open"), F.col("of").eqNullSafe(F.col("source"))).withColumn("r", rate(F.col("multiplier"), x, cap))
            .groupBy("of").agg(exact(n * size * r).alias("words"), exact(n * size * x * r * (1 - r / cap)).alias("slope"))
        )
        gap = F.col("target") - F.col("words")
        low, high = F.when(gap > 0, F.col("multiplier")).otherwise(F.col("low")), F.when(gap > 0, F.col("high")).otherwise(F.col("multiplier"))
        # A step at most doubles the multiplier, as far out the slope says little.
        reach = F.greatest(F.abs("multiplier"), F.lit(2.0))
        held = F.greatest(F.least(F.coalesce(F.try_divide(gap, F.col("slope")), F.signum(gap) * reach), reach), -reach)
        moved = state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").select(
            "source", "scale", "target", "full", "open", "multiplier", low.alias("low"), high.alias("high"), gap.alias("gap"), (F.col("multiplier") + held).alias("newton")
        )
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        done = ~F.col("open") | (F.abs("gap") <= F.col("target") * CLOSE)
        following = F.when(done, F.col("multiplier")).when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        state = stored(moved.select(
            "source", "scale", "target", "full", following.alias("multiplier"), F.when(done, 0.0).otherwise(F.col("low")).alias("low"), F.when(done, 0.0).otherwise(F.col("high")).alias("high"), (~done).alias("open"),
        ), "multipliers", files=FILES)
    return state.select("source", "scale", "multiplier", "full")


def _rounded(table: pa.Table, cap: float) -> pa.Table:
    """Copies for each size of a source; its table has a row per size."""
    table = table.sort_by([("size", "descending")])
    copies, owed = [], 0.0  # words
    for size, n, r in zip(table["size"].to_pylist(), table["n"].to_pylist(), table["rate"].to_pylist(), strict=True):
        taken = min(int(cap * n), max(0, int(n * r + owed / max(size, 1) + 0.5)))
        owed += (n * r - taken) * size
        copies.append(taken)
    return table.append_column("copies", pa.array(copies, pa.int64()))


def mixture(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = CAP) -> DataFrame:
    """Rows of `docs` (key, source, size, tie) with source_size, target, rate and copies.

    Documents of one source and size have one rate. Their copies go by rank of a hash of the key; the ranking is cut into
    chunks, so that no group grows with the input.
    """
    cells = stored(docs.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    sources = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    wanted = stored(targets(sources, weights, cap), "targets", files=FILES)
    multipliers = balanced(cells, wanted, cap)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    joined = cells.join(wanted, same(cells, wanted)).drop(wanted["source"]).join(multipliers, same(cells, multipliers), "left").drop(multipliers["source"])
    solved = F.when(F.col("full"), F.lit(cap)).otherwise(rate(F.col("multiplier"), F.col("size") / F.col("scale"), cap))
    rated = joined.withColumn("rate", F.coalesce(F.when(F.col("size") > 0, solved), F.lit(1.0)))
    columns = rated.select("source", "size", "n", "rate", "source_size", "target", F.ceil(F.col("n") / CHUNK).alias("chunks"))
    schema = T.StructType([*columns.schema.fields, field("copies", T.LongType())])
    plan = columns.groupBy("source").applyInArrow(lambda table: _rounded(table, cap), schema)
    placed = docs.join(plan.withColumnRenamed("source", "of").withColumnRenamed("size", "of_size"), F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size"))).drop("of", "of_size")
    placed = stored(placed.withColumn("chunk", F.pmod(F.xxhash64("key", "tie", F.lit("chunk")), F.col("chunks"))), "placed")
    # A chunk's share of its cell's copies: what the running share gains over it.
    chunk = placed.groupBy("source", "size", "chunk").agg(F.count("*").alias("m"), F.first("n").alias("n"), F.first("copies").alias("copies"))
    by = Window.partitionBy("source", "size").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chunk = chunk.withColumn("s", F.sum("m").over(by))
    share = lambda s: F.expr(f"CAST(CAST(copies AS DECIMAL(38,0)) * ({s}) DIV n AS LONG)")
    chunk = chunk.select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), F.col("chunk").alias("c_chunk"), "m", (share("s") - share("s - m")).alias("own"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "chunk").orderBy(F.xxhash64("key", "tie", F.lit("rank")), "key", "tie")) - 1
    ranked = placed.withColumn("place", rank).join(chunk, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")) & (F.col("chunk") == F.col("c_chunk")))
    # Copies per document of the chunk: the even part for all, one more for the first few; never above the cap.
    copies = F.least(F.floor(F.col("own") / F.col("m")) + F.when(F.col("place") < F.expr("own % m"), 1).otherwise(0), F.lit(int(cap)))
    return ranked.withColumn("times", F.when(F.col("size") > 0, copies).otherwise(1)).select("key", "source", "size", "tie", "source_size", "target", "rate", "times")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = CAP) -> DataFrame:
    """(key, size, source_size, target, taken, copies, rate) for every row.

    Size is the number of words, 0 for a null text; a source of size 0 has target 0 and takes nothing. The null source is
    one of the sources. Repeated rows are rows of their own (they may get different copies). Other columns are not read.
    """
    sizes = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("tie"))
    out = mixture(stored(sizes, "sizes"), weights, cap)
    return out.select(F.col("key").alias(key), "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("times")).cast("long").alias("taken"), F.col("times").cast("long").alias("copies"), "rate")


def resampled(docs: DataFrame, text: str = "text", source: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = CAP) -> DataFrame:
    """The mix itself: every row as often as it is taken, with all its columns. Rows without words stay once."""
    own = fresh_name(docs.columns, "row_hash")
    marked = docs.withColumn(own, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    sizes = marked.select(F.col(own).alias("key"), F.col(source).alias("source"), n_words(text).alias("size"), F.lit(0).alias("tie"))
    times = mixture(stored(sizes, "sizes"), weights, cap)
    # Rows that agree in everything share a hash, and their copies are dealt out evenly among them.
    h, n, rows, place = (fresh_name([*docs.columns, own], c) for c in ("h", "times", "rows", "place"))
    per_row = times.groupBy(F.col("key").alias(h)).agg(F.sum("times").alias(n), F.count("*").alias(rows)).where(F.col(n) > 0)
    kept = marked.join(per_row, F.col(own) == F.col(h)).withColumn(place, F.row_number().over(Window.partitionBy(own).orderBy(own)))
    dealt = F.floor(F.col(n) / F.col(rows)) + F.when(F.col(place) <= F.col(n) % F.col(rows), 1).otherwise(0)
    copies = F.explode(F.array_repeat(F.lit(0), dealt.cast("int")))
    return kept.withColumn(place, copies).select(*[F.col(f"`{c}`") for c in docs.columns])
