"""Conversions between Arrow list columns and NumPy stacks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array) -> np.ndarray:
    """list<double> column with equal lengths as (rows, length)."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 0))


def cube(column: pa.Array) -> np.ndarray:
    """list<list<double>> column (channel-major windows) as (rows, samples, channels)."""
    n = len(column)
    channels = len(column[0])
    flat = column.flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.moveaxis(flat.reshape(n, channels, -1), 1, 2)


def ragged(column: pa.Array) -> list[np.ndarray]:
    """list<double> column with any lengths as one array per row."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.split(flat, np.cumsum(lengths)[:-1]) if len(lengths) else []


def list_column(values: np.ndarray) -> pa.Array:
    """(rows, length) as a list<double> column."""
    rows, length = values.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * length
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values, dtype=np.float64).ravel()))


def nested_column(values: np.ndarray) -> pa.Array:
    """(rows, samples, channels) as a channel-major list<list<double>> column."""
    rows, samples, channels = values.shape
    inner = list_column(np.moveaxis(values, 2, 1).reshape(rows * channels, samples))
    offsets = np.arange(rows + 1, dtype=np.int32) * channels
    return pa.ListArray.from_arrays(pa.array(offsets), inner)


def batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
