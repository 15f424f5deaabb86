"""Augmented copies of raw windows, independent of partitioning.

Random numbers are counted, not drawn: number j of a copy is a 32-bit mix of the copy's two start words and j. Whole batches are
made at once, any number can be repeated alone, and a lost task or another partitioning gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinew.functions import arrow

GAIN = (0.8, 1.2)
NOISE_SHARE = 0.05
DC_JITTER = 20.0
MAX_SHIFT = 5
#: Numbers of the gain, the shift, the first channel's offset and the first cell's noise.
_GAIN, _SHIFT, _OFFSET, _NOISE = 0, 1, 2, 64
_LOW = np.uint64(0xFFFFFFFF)
#: Multipliers and shifts of the mix.
MIX = ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None))


def tile_groups(rows: DataFrame, multiplier: int = 3) -> DataFrame:
    """Each row ``multiplier`` times: ``copy`` 0 is the original (``is_real``), all other columns stay."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(multiplier - 1)))).withColumn(
        "is_real", F.col("copy") == 0
    )


def _word(digest: str, n: int) -> Column:
    return F.conv(F.substring(digest, 8 * n + 1, 8), 16, 10).cast("long")


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in MIX:
        x = x ^ (x >> np.uint64(shift))
        if factor is not None:
            x = x * np.uint64(factor) & _LOW
    return x


def uniforms(a: np.ndarray, b: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """(copies, numbers) values strictly between 0 and 1 from the copies' start words."""
    counter = b[:, None] + numbers.astype(np.uint64) & _LOW
    return (_mix(a[:, None] ^ _mix(counter)) + 0.5) / 2.0**32


def augment(windows: DataFrame, multiplier: int = 3, seed: int = 42) -> DataFrame:
    """Originals plus copies with random gain, noise, offset and circular shift.

    The start words are the first 16 hex digits of the MD5 of ``session:k:copy:seed``.
    """
    digest = F.md5(F.concat_ws(":", F.col("session_id").cast("string"), F.col("k").cast("string"), F.col("copy").cast("string"), F.lit(str(seed))).cast("binary"))
    tiled = tile_groups(windows, multiplier).withColumn("_digest", digest)
    tiled = tiled.withColumn("_a", _word("_digest", 0)).withColumn("_b", _word("_digest", 1)).drop("_digest")
    keep = [c for c in tiled.columns if c not in ("x", "_a", "_b")]
    schema = tiled.select(*keep, "x").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = arrow.cube(batch.column("x"))
            a, b = (batch.column(c).to_numpy().astype(np.uint64) for c in ("_a", "_b"))
            real = batch.column("is_real").to_numpy(zero_copy_only=False)
            x[~real] = vary(x[~real], a[~real], b[~real])
            yield arrow.batch({**{c: batch.column(c) for c in keep}, "x": arrow.nested_column(x)})

    return tiled.mapInArrow(run, schema)


def vary(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One copy each of (windows, samples, channels), from their start words."""
    n, samples, channels = x.shape
    cells = np.arange(samples * channels)
    few = uniforms(a, b, np.concatenate([[_GAIN, _SHIFT], _OFFSET + np.arange(channels)]))
    out = x * (GAIN[0] + (GAIN[1] - GAIN[0]) * few[:, 0])[:, None, None]
    level = np.sqrt((out**2).mean(axis=(1, 2))) + 1e-8
    # Pairs of uniform numbers to normal ones.
    radius = np.sqrt(-2.0 * np.log(uniforms(a, b, _NOISE + 2 * cells)))
    noise = (radius * np.cos(2 * np.pi * uniforms(a, b, _NOISE + 2 * cells + 1))).reshape(n, samples, channels)
    out = out + noise * (NOISE_SHARE * level)[:, None, None]
    out = out + (DC_JITTER * (2 * few[:, 2:] - 1))[:, None, :]
    shift = np.floor(few[:, 1] * (2 * MAX_SHIFT + 1)).astype(np.int64) - MAX_SHIFT
    at = (np.arange(samples) - shift[:, None]) % samples
    return np.take_along_axis(out, at[:, :, None], axis=1)
