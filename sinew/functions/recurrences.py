"""Running averages, votes and debounced outputs over the next rows of a sequence, from the state its earlier rows left."""

from __future__ import annotations

import numpy as np

BLOCK = 64


def averages(values: np.ndarray, state: np.ndarray, keep: float) -> np.ndarray:
    """s_t = keep·s_(t−1) + (1−keep)·v_t for rows of `values` (rows, columns), a block of rows per matrix product."""
    out = np.empty(values.shape)
    age = np.arange(BLOCK)
    weights = np.where(age[:, None] >= age, (1 - keep) * keep ** np.maximum(age[:, None] - age, 0.0), 0.0)
    fade = keep ** (age + 1.0)
    for a in range(0, len(values), BLOCK):
        some = values[a : a + BLOCK]
        n = len(some)
        out[a : a + n] = weights[:n, :n] @ some + fade[:n, None] * state
        state = out[a + n - 1]
    return out


def majorities(winners: np.ndarray, ring: np.ndarray, votes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent of the last `votes` winners at each row (ties to the one seen first) and its share; the ring for the next rows.

    `ring` holds up to votes − 1 winners before the rows, oldest first.
    """
    if not len(winners):
        return np.zeros(0, np.int64), np.zeros(0), ring
    line = np.concatenate([ring, winners]).astype(np.int64)
    padded = np.concatenate([np.full(votes - 1, -1), line])
    seen = np.lib.stride_tricks.sliding_window_view(padded, votes)[len(ring) :]
    count = (seen[:, :, None] == seen[:, None, :]).sum(axis=2) * (seen >= 0)
    best = count.argmax(axis=1)
    rows = np.arange(len(seen))
    size = np.minimum(votes, len(ring) + rows + 1)
    return seen[rows, best], count[rows, best] / size, line[max(0, len(line) - votes + 1) :]


def debounced(labels: np.ndarray, output: int, pending: int, count: int, length: int) -> tuple[np.ndarray, int, int]:
    """Outputs that follow `labels` once one has come `length` times in a row (twice at least); the first label is taken at once.

    `pending` and `count` say which label came last and how often in a row. Gives the outputs, and both for the next rows.
    """
    if not len(labels):
        return labels, pending, count
    opens = np.concatenate([[labels[0] != pending], labels[1:] != labels[:-1]])
    begin = np.maximum.accumulate(np.where(opens, np.arange(len(labels)), -count))
    run = np.arange(len(labels)) - begin + 1
    switch = np.flatnonzero(run >= max(2, length))
    at = np.searchsorted(switch, np.arange(len(labels)), "right") - 1
    start = output if output >= 0 else labels[0]
    outputs = np.where(at >= 0, labels[switch[np.maximum(at, 0)]] if len(switch) else start, start)
    return outputs, int(labels[-1]), int(run[-1])
