"""Comparing labels, features and scores; summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinew.constants import HOP
from sinew.functions.quantiles import exact_quantiles
from sinew.operators.smooth import with_changes


def accuracy(rows: DataFrame, truth: str = "label", guess: str = "predicted") -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("accuracy"))


def classification_report(rows: DataFrame, truth: str = "label", guess: str = "predicted") -> DataFrame:
    """precision, recall, f1, support per class plus macro and weighted means.

    Rows reduce to (true, predicted) counts first; everything after works on classes.
    """
    pairs = rows.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    sides = pairs.select(
        F.explode(F.array(
            F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed"),
                     F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("hit")),
            F.struct(F.col("g").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("claimed"),
                     F.lit(0).cast("long").alias("hit")),
        )).alias("s")
    ).select("s.*").groupBy("label").agg(F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    scored = sides.withColumn("precision", ratio("hit", "claimed")).withColumn("recall", ratio("hit", "support"))
    both = F.col("precision") + F.col("recall")
    scored = scored.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))
    columns = ["precision", "recall", "f1"]
    macro = scored.agg(*[F.avg(c).alias(c) for c in columns], F.sum("support").alias("support")).withColumn("label", F.lit("macro avg"))
    weighted = scored.agg(
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in columns], F.sum("support").alias("support")
    ).withColumn("label", F.lit("weighted avg"))
    wanted = ["label", *columns, "support"]
    return scored.select(*wanted).unionByName(macro.select(*wanted)).unionByName(weighted.select(*wanted))


def confusion_matrix(rows: DataFrame, classes: Sequence[str], truth: str = "label", guess: str = "predicted") -> DataFrame:
    """One row per true class, one column per predicted class."""
    return (
        rows.groupBy(F.col(truth).alias("label")).pivot(guess, list(classes)).count().na.fill(0, list(classes))
    )


def feature_drift(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("session_id", "k")) -> DataFrame:
    """``pos, drift``: mean |a − b| in units of b's deviation (over rows present in both)."""
    joined = a.select(*keys, F.col("f").alias("_a")).join(b.select(*keys, F.col("f").alias("_b")), list(keys))
    pairs = joined.select(F.posexplode(F.arrays_zip("_a", "_b")).alias("pos", "v"))
    return pairs.groupBy("pos").agg(
        (F.avg(F.abs(F.col("v._a") - F.col("v._b"))) / (F.stddev_pop("v._b") + 1e-12)).alias("drift"),
        (F.avg("v._a") - F.avg("v._b")).alias("shift"),
    )


def drift_summary(drift: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """median, max and number of features above the tolerance; a table of vector length."""
    middle = exact_quantiles(drift.withColumn("_g", F.lit(0)), ["_g"], "drift", [0.5], ["median"])
    top = drift.agg(
        F.max("drift").alias("max"), F.max_by("pos", "drift").alias("worst_pos"),
        F.count_if(F.col("drift") > tolerance).alias("above"),
    ).withColumn("_g", F.lit(0))
    return middle.join(top, "_g").drop("_g")


def worst_features(drift: DataFrame, n: int = 12) -> DataFrame:
    return drift.orderBy(F.desc("drift"), "pos").limit(n)


def _first_max(p: str) -> Column:
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def score_drift(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("session_id", "k")) -> DataFrame:
    """Largest difference, agreement of the winner and mean confidences of two score tables."""
    joined = a.select(*keys, F.col("p").alias("_a")).join(b.select(*keys, F.col("p").alias("_b")), list(keys))
    worst = F.array_max(F.zip_with("_a", "_b", lambda x, y: F.abs(x - y)))
    return joined.agg(
        F.count("*").alias("n"), F.max(worst).alias("max_diff"),
        F.avg((_first_max("_a") == _first_max("_b")).cast("double")).alias("agreement"),
        F.avg(F.array_max("_a")).alias("conf_a"), F.avg(F.array_max("_b")).alias("conf_b"),
    )


def winner_counts(scores: DataFrame) -> DataFrame:
    return scores.groupBy(_first_max("p").alias("class_id")).agg(F.count("*").alias("n"))


def scale_check(calibration: DataFrame, training: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Largest relative difference of σ to σ_train per session (``pos, sigma`` / ``pos, sigma_train``)."""
    relative = F.abs(F.col("sigma") - F.col("sigma_train")) / (F.abs("sigma_train") + 1e-9)
    return (
        calibration.join(training.select("pos", "sigma_train"), "pos").groupBy("session_id")
        .agg(F.max(relative).alias("max_rel")).withColumn("ok", F.col("max_rel") < tolerance)
    )


def label_counts(labels: DataFrame, by: Sequence[str] = ("session_id", "label")) -> DataFrame:
    return labels.groupBy(*by).agg(F.count("*").alias("windows"))


def feature_summary(values: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    return values.groupBy(name).agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )


def label_channel_std(windows: DataFrame, channel: int = 0) -> DataFrame:
    """Deviation of a channel over all windows of a label, overlap counted as often as it occurs."""
    values = windows.select("session_id", "label", F.explode(F.get("x", F.lit(channel))).alias("v"))
    return values.groupBy("session_id", "label").agg(F.stddev_pop("v").alias("std"))


def histogram(rows: DataFrame, value: str, bins: int, by: Sequence[str]) -> DataFrame:
    """Equal-width counts between the overall extremes, the top edge in the last bin."""
    ends = rows.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    width = F.when(span > 0, span / bins).otherwise(1.0)
    place = F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    # The extremes are one row.
    joined = rows.withColumn("_one", F.lit(1)).join(F.broadcast(ends.withColumn("_one", F.lit(1))), "_one")
    return joined.groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"))


def switch_ratio(outputs: DataFrame, truth: str = "label", output: str = "output", *, none=-1) -> DataFrame:
    """Output switches against true changes, and accuracy away from them, per session.

    Steady rows are those whose truth equals the row before.
    """
    flagged = with_changes(outputs, output).withColumnRenamed("changed", "_switched")
    from sinew.operators.labels import neighbours

    moved = neighbours(flagged, [truth])
    changed = F.coalesce(F.col(f"prev_{truth}") != F.col(truth), F.lit(False))
    steady = ~changed & (F.col(output) != none)
    return moved.groupBy("session_id").agg(
        F.sum(changed.cast("long")).alias("true_changes"),
        F.sum(F.col("_switched").cast("long")).alias("switches"),
        F.avg(F.when(steady, (F.col(truth) == F.col(output)).cast("double"))).alias("steady_accuracy"),
    ).withColumn("ratio", F.col("switches") / F.when(F.col("true_changes") > 0, F.col("true_changes")))


def value_range(samples: DataFrame, columns: Sequence[str], margin: float = 0.05) -> DataFrame:
    """Extremes over channels and samples, widened by a share of their distance."""
    low, high = F.min(F.least(*columns)), F.max(F.greatest(*columns))
    ends = samples.groupBy("session_id").agg(low.alias("low"), high.alias("high"))
    pad = (F.col("high") - F.col("low")) * margin
    return ends.select("session_id", "low", "high", (F.col("low") - pad).alias("axis_low"), (F.col("high") + pad).alias("axis_high"))
