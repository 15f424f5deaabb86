"""Splits that keep whole trials together."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinew.ordered import Scan, running

HASH_RANGE = 1 << 32
HASH_MULTIPLIER = 2654435761
TRIALS_PER_CHUNK = 1 << 16


def _picks(levels: np.ndarray, loads: np.ndarray, size: int) -> np.ndarray:
    """Trials of ``size`` each fold takes at a load below each level; (levels, folds)."""
    return np.maximum(0, -(-(levels[:, None] - loads[None, :]) // size))


def _level(count: np.ndarray, loads: np.ndarray, size: int) -> np.ndarray:
    """Highest level L such that at most ``count`` trials are placed at a load below L."""
    low = np.full(len(count), loads.min(), dtype=np.int64)
    high = loads.max() + size * (count.astype(np.int64) + 1)
    while (low < high).any():
        middle = (low + high + 1) // 2
        fits = _picks(middle, loads, size).sum(axis=1) <= count
        low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
    return low


def fold_of(position: np.ndarray, loads: np.ndarray, size: int) -> np.ndarray:
    """Fold of the n-th trial of one size when each goes to the lightest fold, lowest number first.

    A fold with load l takes its r-th trial of this size at load l + r·size, and the order of
    placements is the order of these loads. So the n-th one follows from counting.
    """
    level = _level(position, loads, size)
    taken = _picks(level, loads, size)
    at_level = loads[None, :] + taken * size == level[:, None]
    within = position - taken.sum(axis=1)
    return (np.cumsum(at_level, axis=1) > within[:, None]).argmax(axis=1)


def loads_after(count: int, loads: np.ndarray, size: int) -> np.ndarray:
    level = _level(np.array([count]), loads, size)
    taken = _picks(level, loads, size)[0]
    rest = count - taken.sum()
    at_level = np.flatnonzero(loads + taken * size == level[0])[:rest]
    taken[at_level] += 1
    return loads + taken * size


def group_kfold(rows: DataFrame, trial: Sequence[str] = ("trial_id",), folds: int = 5) -> DataFrame:
    """``trial…, n, fold``: trials by falling size (then key), each to the lightest fold.

    Only the histogram of trial sizes reaches the driver; with N rows it has at most √(2N) lines.
    A trial's fold is computed from its rank among the trials of its size.
    """
    trial = list(trial)
    sizes = rows.groupBy(*trial).agg(F.count("*").alias("n"))
    histogram = sizes.groupBy("n").agg(F.count("*").alias("trials")).orderBy(F.desc("n")).collect()
    total = sum(r["trials"] for r in histogram)
    folds = min(folds, total)
    loads = np.zeros(folds, dtype=np.int64)
    before: dict[int, np.ndarray] = {}
    for r in histogram:
        before[r["n"]] = loads
        loads = loads_after(r["trials"], loads, r["n"])
    last = F.floor(F.col(trial[-1]) / TRIALS_PER_CHUNK)
    chunk = F.struct(*[F.col(c) for c in trial[:-1]], last.alias("cell"))
    ranked = running(sizes, ["n"], trial, chunk, {"_rank": Scan("sum", F.lit(1).cast("long"), reverse=True)})

    @F.pandas_udf("int")
    def assign(size: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(size), dtype=np.int32)
        for value in np.unique(size):
            here = (size == value).to_numpy()
            out[here] = fold_of(rank.to_numpy()[here] - 1, before[int(value)], int(value))
        return pd.Series(out)

    return ranked.select(*trial, "n", assign("n", "_rank").alias("fold"))


def trial_hash(trial: Column, seed: int = 0) -> Column:
    return F.pmod((trial.cast("long") + seed) * F.lit(HASH_MULTIPLIER), F.lit(HASH_RANGE))


def group_shuffle_split(rows: DataFrame, trial: str = "trial_id", share: float = 0.2, seed: int = 0) -> DataFrame:
    """``trial, split``: the trials with the lowest hashes, ``share`` of them rounded up, are test."""
    trials = rows.select(trial).distinct().withColumn("_h", trial_hash(F.col(trial), seed))
    total = trials.count()
    n_test = int(np.ceil(share * total))
    ranked = running(
        trials.withColumn("_one", F.lit(1)), ["_one"], ["_h", trial], F.shiftright("_h", 20),
        {"_rank": Scan("sum", F.lit(1).cast("long"))},
    )
    return ranked.select(trial, F.when(F.col("_rank") <= n_test, "test").otherwise("train").alias("split"))


def check_disjoint(split: DataFrame, trial: str = "trial_id") -> None:
    """Error if a trial is on both sides."""
    both = split.groupBy(trial).agg(F.count_distinct("split").alias("sides")).filter("sides > 1")
    if not both.isEmpty():
        raise ValueError("a trial is in train and test")


def split_class_counts(rows: DataFrame, split: DataFrame, trial: str = "trial_id") -> DataFrame:
    return (
        rows.join(split, trial).groupBy("label").pivot("split", ["train", "test"]).count()
        .select("label", F.coalesce("train", F.lit(0)).alias("train"), F.coalesce("test", F.lit(0)).alias("test"))
    )


def shuffle_holdout(rows: DataFrame, keys: Sequence[str] = ("session_id", "k"), share: float = 0.1, seed: int = 0) -> DataFrame:
    """Add ``holdout``: the last ``share`` of the rows in the order of a hash of their (integer) key, n − ⌊n·(1 − share)⌋ rows.

    The rank is a prefix scan over hash ranges, so rows are never ordered in one task.
    """
    mixed = sum((F.pmod(F.col(c).cast("long") + seed, F.lit(1 << 20)) * (31**n) for n, c in enumerate(keys)), F.lit(0).cast("long"))
    keyed = rows.select(*keys).withColumns({"_h": trial_hash(mixed), "_one": F.lit(1)})
    ranked = running(keyed, ["_one"], ["_h", *keys], F.shiftright("_h", 20), {"_rank": Scan("sum", F.lit(1).cast("long"))})
    total = rows.agg(F.count("*").alias("_n")).withColumn("_one", F.lit(1))
    held = ranked.join(F.broadcast(total), "_one").select(*keys, (F.col("_rank") > F.floor(F.col("_n") * (1 - share))).alias("holdout"))
    return rows.join(held, list(keys))


def leave_one_session_out(rows: DataFrame) -> DataFrame:
    """Add ``fold``: one per session."""
    return rows.withColumn("fold", F.col("session_id"))
