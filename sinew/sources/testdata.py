"""Sample, prediction, log and feature tables derived from the relational test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sinew.ordered import dense_index
from sinew.session import checkpoint_folder, prepare, written

# Session numbering of the long recordings: suppliers per session.
SUPPLIERS_PER_SESSION = 10
# Years in order stand for prompts: label per year.
YEAR_LABELS = {
    1995: "rest", 1996: "open", 1997: "rest", 1998: "fist", 1999: "rest", 2000: "hook_em", 2001: "thumbs_up",
}
ORDER_KEYS_PER_CHUNK = 1 << 28
DAY_US = 86_400_000_000
DAYS_PER_CHUNK = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _samples(spark: SparkSession, sf_dir: str, session: Column) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        session.cast("long").alias("session_id"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey",
        F.col("l_quantity").alias("ch0"),
        (F.col("l_extendedprice") / 1000).alias("ch1"),
        (F.col("l_discount") * 1000).alias("ch2"),
        (F.col("l_tax") * 1000).alias("ch3"),
        F.year("l_shipdate").alias("y"),
    )
    # Chunks grow along the sort order: months, so that a session has far fewer chunks than rows. Numbers of rows without
    # session start anew in every chunk: those of a day, split by order keys.
    apart = F.col("session_id").isNull()
    chunk = F.struct(
        (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("month"),
        F.when(apart, F.to_date("l_shipdate")).alias("day"),
        F.when(apart, F.floor(F.col("l_orderkey") / ORDER_KEYS_PER_CHUNK)).alias("block"),
    )
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey"]
    indexed = dense_index(lines, ["session_id"], order, chunk)
    return indexed.select(
        "session_id", "i", (F.col("i") / 1000).alias("ts"), "ch0", "ch1", "ch2", "ch3", "y"
    )


def short_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per supplier, about 600 samples each."""
    return _samples(spark, sf_dir, F.col("l_suppkey"))


def long_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten suppliers per session, about 6000 samples each; years form contiguous runs."""
    return _samples(spark, sf_dir, F.floor(F.col("l_suppkey") / SUPPLIERS_PER_SESSION))


def numbered_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``long_sessions`` as a written table, for queries that read the samples more than once."""
    return written(long_sessions(spark, sf_dir), f"{checkpoint_folder(spark).rstrip('/')}/numbered-{uuid.uuid4().hex}")


def year_label(year: Column) -> Column:
    expr = F.lit(None).cast("string")
    for y, name in YEAR_LABELS.items():
        expr = F.when(year == y, name).otherwise(expr)
    return expr


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as per-user sequences: ``session_id, k, ts_us, event_type, value``."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), micros.alias("ts_us"), "event_type", "value"
    )
    # Numbers of rows without session start anew every day.
    days = F.when(F.col("session_id").isNull(), 1).otherwise(DAYS_PER_CHUNK)
    return dense_index(events, ["session_id"], ["ts_us"], F.floor(F.col("ts_us") / (days * DAY_US)), "k")


CLASSES = ("click", "error", "purchase", "signup", "view")


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A five-class probability vector per event: ``session_id, k, event_type, value, p``."""
    rows = event_rows(spark, sf_dir)
    block = F.floor(F.col("k") / 8)
    leaders = (
        rows.groupBy("session_id", block.alias("b"))
        .agg(F.min_by("event_type", "k").alias("blk"))
    )
    flat = (F.col("k") < 3) | (F.col("k") % 40 >= 28)
    p = F.array(
        *[
            F.when(flat, F.lit(0.2)).otherwise(
                F.lit(0.02)
                + 0.54 * (F.col("blk") == c).cast("double")
                + 0.36 * (F.col("event_type") == c).cast("double")
            )
            for c in CLASSES
        ]
    )
    return (
        rows.withColumn("b", block).join(leaders, ["session_id", "b"])
        .select("session_id", "k", "event_type", "value", p.alias("p"))
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled feature vectors: ``session_id, k, label, trial_id, f``."""
    return table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 5).alias("session_id"),
        F.col("vec_id").alias("k"),
        F.concat(F.lit("c"), F.col("label")).alias("label"),
        F.floor(F.col("vec_id") / 10).cast("long").alias("trial_id"),
        F.col("embedding").cast("array<double>").alias("f"),
    )


def labelled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window keys of the long sessions with the label of their year: ``…, y, label``."""
    return labelled(long_sessions(spark, sf_dir))


def labelled(samples: DataFrame) -> DataFrame:
    """Window keys of samples with the label of their year."""
    from sinew.operators.windows import window_index

    return window_index(samples, carry=["y"]).withColumn("label", year_label(F.col("y")))
