"""Bounded samples of labelled documents for fitting, and what both classifiers share."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key's decimal digits, modulo; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus)).cast("int")


def held_out(key: str, modulus: int, rest: int) -> Column:
    return F.coalesce(remainder(key, modulus) == rest, F.lit(False))


def known_labels(labels: DataFrame, key: str, label: str, learnable: Column) -> DataFrame:
    """(key, label) of all keys to learn from; a key with both labels counts as the larger."""
    wanted = labels.where(learnable & F.col(label).isNotNull() & F.col(key).isNotNull())
    return wanted.groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))


def chosen_labels(labels: DataFrame, key: str, label: str, learnable: Column, bounds: dict[int, int]) -> DataFrame:
    """(key, label) of at most `bounds[label]` keys of each label, by a hash of the key; a key with both labels counts as the larger.

    Only this table of bounded size meets the documents, so no text is shuffled.
    """
    known = known_labels(labels, key, label, learnable)
    parts = [known.where(F.col("label") == v).orderBy(F.xxhash64("key"), "key").limit(n) for v, n in bounds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def matched(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Documents of the chosen keys with their labels; the chosen table is bounded, so it is sent to every task."""
    return docs.join(F.broadcast(chosen), "key")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def best_cut(score: np.ndarray, label: np.ndarray, *, balanced: bool = False) -> float:
    """The cut between two scores with the best F1 of label 1, or with the best mean of both labels' recall; 0 without both labels."""
    if not len(label) or label.min() == label.max():
        return 0.0
    order = np.argsort(-score, kind="stable")
    s, y = score[order], label[order]
    hit, false = np.cumsum(y), np.cumsum(1 - y)
    value = hit / y.sum() - false / (1 - y).sum() if balanced else 2 * hit / (hit + false + y.sum())
    value[:-1][s[:-1] == s[1:]] = -1
    best = np.flatnonzero(value >= value.max() - 1e-12)
    k = int(best[len(best) // 2])
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k]) - 1e-6


def best_cut_counted(found: pd.DataFrame) -> float:
    """`best_cut` (F1) over (score, label, count) rows: the middle of the best cuts between two scores."""
    table = found.pivot_table(index="score", columns="label", values="count", aggfunc="sum", fill_value=0).reindex(columns=[0, 1], fill_value=0).sort_index(ascending=False)
    if not len(table) or not table[0].sum() or not table[1].sum():
        return 0.0
    s, hit, false = table.index.to_numpy(), table[1].cumsum().to_numpy(), table[0].cumsum().to_numpy()
    value = 2 * hit / (hit + false + hit[-1])
    best = np.flatnonzero(value >= value.max() - 1e-12)
    k = int(best[len(best) // 2])
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k]) - 1e-6


def part_of(keys: np.ndarray, modulus: int) -> np.ndarray:
    """A share of sampled keys for calibration, by another hash than the one that holds rows out."""
    return np.array([zlib.crc32(f"calibrate {k}".encode()) % modulus == 0 for k in keys.tolist()], bool)
