"""Small seeded recordings and literal step-by-step versions to compare with."""

from __future__ import annotations

import numpy as np
import pandas as pd


def recording(n: int, session: int = 0, seed: int = 0, channels: int = 4) -> pd.DataFrame:
    rng = np.random.default_rng(seed + 97 * session)
    t = np.arange(n) / 1000.0
    data = {"session_id": session, "i": np.arange(n), "ts": t}
    for c in range(channels):
        waves = sum(rng.uniform(5, 30) * np.sin(2 * np.pi * rng.uniform(30, 400) * t + rng.uniform(0, 6)) for _ in range(6))
        data[f"ch{c}"] = 2300 + waves * (1 + 0.5 * np.sin(2 * np.pi * t / 3 + c)) + rng.normal(0, 3, n)
    return pd.DataFrame(data)


def samples(spark, *lengths: int, seed: int = 0):
    frame = pd.concat([recording(n, s, seed) for s, n in enumerate(lengths)])
    return spark.createDataFrame(frame), frame


def cascade(x: np.ndarray, poly: list[tuple[np.ndarray, np.ndarray]], state=None) -> np.ndarray:
    """Sample-by-sample transposed direct form of one section per entry."""
    y = np.asarray(x, dtype=float)
    for b, a in poly:
        z1 = z2 = 0.0
        out = np.empty(len(y))
        for n, v in enumerate(y):
            o = b[0] * v + z1
            z1 = b[1] * v - a[1] * o + z2
            z2 = b[2] * v - a[2] * o
            out[n] = o
        y = out
    return y


def vote_debounce(p: np.ndarray, keep=0.7, reject=0.4, votes=5, debounce=3):
    s = np.full(p.shape[1], 1 / p.shape[1])
    history, current, pending, count, out = [], None, None, 0, []
    for row in p:
        s = keep * s + (1 - keep) * row
        if s.max() < reject:
            out.append(-1 if current is None else current)
            continue
        history = [*history, int(s.argmax())][-votes:]
        tally = {}
        for h in history:
            tally[h] = tally.get(h, 0) + 1
        label = max(tally, key=tally.get)
        if current is None:
            current, pending, count = label, label, 1
        elif label == current:
            pending, count = label, 1
        elif label == pending:
            count += 1
            if count >= debounce:
                current = label
        else:
            pending, count = label, 1
        out.append(current)
    return out


def hysteresis(p: np.ndarray, keep=0.7, enter=0.7, hold=0.25):
    s = np.full(p.shape[1], 1 / p.shape[1])
    current, out = -1, []
    for row in p:
        s = keep * s + (1 - keep) * row
        top, conf = int(s.argmax()), s.max()
        if conf >= hold and top != current and (current < 0 or conf >= enter):
            current = top
        out.append(current)
    return out


def probabilities(n: int, seed: int, classes: int = 4) -> np.ndarray:
    rng = np.random.default_rng(seed)
    block = np.repeat(rng.integers(0, classes, n // 6 + 1), 6)[:n]
    p = rng.dirichlet(np.full(classes, 0.5), n)
    p[np.arange(n), block] += rng.uniform(0, 3, n)
    quiet = rng.random(n) < 0.25
    p[quiet] = 1.0
    return p / p.sum(axis=1, keepdims=True)


def proba_frame(spark, tracks: dict[int, np.ndarray]):
    rows = [(s, k, row.tolist()) for s, p in tracks.items() for k, row in enumerate(p)]
    return spark.createDataFrame(rows, "session_id long, k long, p array<double>")
