"""One session with most of the rows must not end up in one group."""

from pyspark.sql import functions as F

from helpers import samples
from sinew.operators import windows as W
from sinew.operators import smooth as SM
from sinew.ordered import CHUNK, with_halo


def test_hot_session_is_spread(spark):
    rows = spark.range(200_000).select(F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id") % 7 + 1).alias("session_id"), F.col("id").alias("i"))
    placed = with_halo(rows, "i", 6400, after=149)
    largest = placed.groupBy("session_id", CHUNK).count().agg(F.max("count")).first()[0]
    assert largest <= 6400 + 149


def test_packed_rows_are_bounded(spark):
    df, _ = samples(spark, 20_000, 300)
    sizes = W.pack(df, ["ch0"], size=1000, after=149).select(F.max(F.size("i"))).first()[0]
    assert sizes <= 1149


def test_outputs_do_not_change_with_the_chunk(spark):
    rows = spark.range(3000).select(
        F.lit(0).cast("long").alias("session_id"), F.col("id").alias("k"),
        F.array(*[(F.abs(F.sin(F.col("id") / 40 + c)) + 0.05) for c in range(3)]).alias("p"),
    )
    a = {r.k: r.output for r in SM.smooth_hysteresis(rows, 3, size=64).collect()}
    b = {r.k: r.output for r in SM.smooth_hysteresis(rows, 3).collect()}
    assert a == b
