"""Recurrences without a closed form, run in parallel over chunks.

A chunk is packed into one row and summarised as a small map from entry state to exit state. The
maps of one session are chained over its chunks, which yields every chunk's entry state, and the
chunks are then replayed independently. The exact result does not depend on the chunk length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sinew.ordered import CHUNK, chunk_of
from sinew.session import settle

Chunk = dict[str, np.ndarray]


def chunk_fold(
    df: DataFrame,
    order: str,
    columns: Sequence[str],
    size: int,
    *,
    start: Sequence[float],
    summarise: Callable[[list[Chunk]], list[np.ndarray]],
    advance: Callable[[np.ndarray, np.ndarray], np.ndarray],
    replay: Callable[[list[Chunk], list[np.ndarray]], list[dict[str, np.ndarray]]],
    outputs: Sequence[T.StructField],
) -> DataFrame:
    """Fold ``columns`` in ``order`` per session; adds ``outputs`` for the rows ``replay`` returns.

    ``summarise(chunks)`` gives the chunks' state maps as numbers, ``advance(map, state)`` applies
    one, ``replay(chunks, states)`` gives arrays including ``order``; both take a batch of chunks at once. The packed
    chunks are written once and read for the maps and for the replay.
    """
    rows = F.sort_array(F.collect_list(F.struct(order, *columns)))
    packed = (
        df.groupBy("session_id", chunk_of(order, size).alias(CHUNK)).agg(rows.alias("_rows"))
        .select("session_id", CHUNK, *[F.col(f"_rows.{c}").alias(c) for c in (order, *columns)])
    )
    packed = settle(packed)
    session = df.schema["session_id"]
    chunk_field = T.StructField(CHUNK, T.LongType())
    numbers = T.ArrayType(T.DoubleType())
    names = [order, *columns]

    def chunks(frame: pd.DataFrame) -> list[Chunk]:
        return [{c: np.asarray(v) for c, v in zip(names, values)} for values in zip(*[frame[c] for c in names])]

    def maps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame[["session_id", CHUNK]].copy()
            out["_map"] = [m.tolist() for m in summarise(chunks(frame))]
            yield out

    def chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Entry states along each session; rows arrive sorted, so one pass serves many sessions."""
        current, state = None, None
        for frame in frames:
            entries = []
            for sid, step in zip(frame["session_id"], frame["_map"]):
                if sid != current:
                    current, state = sid, np.asarray(start, dtype=float)
                entries.append(state.tolist())
                state = advance(np.asarray(step, dtype=float), state)
            yield frame[["session_id", CHUNK]].assign(_entry=entries)

    def replays(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            results = replay(chunks(frame), [np.asarray(e, dtype=float) for e in frame["_entry"]])
            parts = [pd.DataFrame(r).assign(session_id=sid) for sid, r in zip(frame["session_id"], results)]
            if parts:
                yield pd.concat(parts)[["session_id", order, *[f.name for f in outputs]]]

    summaries = packed.mapInPandas(maps, T.StructType([session, chunk_field, T.StructField("_map", numbers)]))
    entries = summaries.repartition("session_id").sortWithinPartitions("session_id", CHUNK).mapInPandas(
        chain, T.StructType([session, chunk_field, T.StructField("_entry", numbers)])
    )
    entered = packed.join(entries, ["session_id", CHUNK]).select("session_id", "_entry", *names)
    return entered.mapInPandas(replays, T.StructType([session, df.schema[order], *outputs]))


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences side by side, and their lengths."""
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    out = np.zeros((len(rows), int(sizes.max(initial=0))))
    for held, row in zip(out, rows):
        held[: len(row)] = row
    return out, sizes


# ------------------------------------------------------------------------ rate-limited following


def follow_many(targets: list[np.ndarray], states: np.ndarray, limit: float, low: float, high: float) -> list[np.ndarray]:
    """Values that move towards their target by at most ``limit`` a row and stay within low and high; all sequences a row at a time."""
    lines, sizes = padded(targets)
    out = np.empty(lines.shape)
    for j, target in enumerate(lines.T):
        states = np.clip(np.maximum(states - limit, np.minimum(states + limit, target)), low, high)
        out[:, j] = states
    return [o[:n] for o, n in zip(out, sizes)]


def follow(targets: np.ndarray, state: float, limit: float, low: float, high: float) -> np.ndarray:
    """The same for one sequence."""
    out = np.empty(len(targets))
    for n, target in enumerate(targets.tolist()):
        out[n] = state = min(max(max(state - limit, min(state + limit, target)), low), high)
    return out


def follow_maps(targets: list[np.ndarray], limit: float, low: float, high: float) -> list[np.ndarray]:
    """Exit states as piecewise linear functions of the entry state: knots x then values y.

    One step never decreases and never widens distances. Where both extremes meet, which is the usual case, the map is constant.
    """
    bottom, top = (follow_many(targets, np.full(len(targets), edge), limit, low, high) for edge in (low, high))
    return [
        np.array([low, high, a[-1], b[-1]]) if a[-1] == b[-1] else _follow_map(t, limit, low, high)
        for t, a, b in zip(targets, bottom, top)
    ]


def _follow_map(targets: np.ndarray, limit: float, low: float, high: float) -> np.ndarray:
    xs, ys = np.array([low, high]), np.array([low, high])
    for target in targets.tolist():
        for level in (target - limit, target + limit, low - limit, high + limit):
            for n in np.flatnonzero((ys[:-1] < level) & (ys[1:] > level))[::-1]:
                xs = np.insert(xs, n + 1, xs[n] + (level - ys[n]))
                ys = np.insert(ys, n + 1, level)
        ys = np.clip(np.where(np.abs(target - ys) <= limit, target, ys + np.sign(target - ys) * limit), low, high)
        if len(xs) > 2:
            # Slopes are 0 or 1 up to rounding.
            slope = np.diff(ys) > 0.5 * np.diff(xs)
            bends = np.flatnonzero(slope[1:] != slope[:-1]) + 1
            keep = np.concatenate([[0], bends, [len(xs) - 1]])
            xs, ys = xs[keep], ys[keep]
    return np.concatenate([xs, ys])


def follow_advance(step: np.ndarray, state: np.ndarray) -> np.ndarray:
    half = len(step) // 2
    return np.array([np.interp(state[0], step[:half], step[half:])])


# --------------------------------------------------------------------------- threshold emission


def emissions_many(values: list[np.ndarray], last: np.ndarray, threshold: float) -> list[np.ndarray]:
    """Flags of values that differ from the last emitted one by at least ``threshold``; all sequences a row at a time."""
    lines, sizes = padded(values)
    flags, last = np.zeros(lines.shape, dtype=bool), last.copy()
    for j, v in enumerate(lines.T):
        flags[:, j] = np.abs(v - last) >= threshold
        last = np.where(flags[:, j], v, last)
    return [f[:n] for f, n in zip(flags, sizes)]


def emissions(values: np.ndarray, last: float, threshold: float) -> np.ndarray:
    """The same for one sequence."""
    flags = np.zeros(len(values), dtype=bool)
    for n, v in enumerate(values.tolist()):
        if abs(v - last) >= threshold:
            flags[n], last = True, v
    return flags


def emission_maps(values: list[np.ndarray], threshold: float) -> list[np.ndarray]:
    """(value, exit) for each value an unknown entry may first be emitted at.

    The first value too far from the entry is always a new maximum or minimum of the chunk, and
    from there on the chain of emissions no longer depends on the entry. Once the extremes are
    two thresholds apart no entry can still be silent. The chains of all candidates of all chunks run side by side.
    """
    lines, sizes = padded(values)
    owner, start = [], []
    for n, v in enumerate(values):
        high, low = np.maximum.accumulate(v), np.minimum.accumulate(v)
        fresh = np.concatenate([[True], (v[1:] > high[:-1]) | (v[1:] < low[:-1])])
        apart = np.flatnonzero(high - low >= 2 * threshold)
        at = np.flatnonzero(fresh[: apart[0] + 1] if len(apart) else fresh)
        owner.append(np.full(len(at), n))
        start.append(at)
    owner, start = np.concatenate(owner), np.concatenate(start)
    last = lines[owner, start]
    first = last.copy()
    for j in range(1, lines.shape[1]):
        v = lines[owner, j]
        moved = (start < j) & (j < sizes[owner]) & (np.abs(v - last) >= threshold)
        last = np.where(moved, v, last)
    pieces = np.stack([first, last], axis=1)
    return [pieces[owner == n].ravel() for n in range(len(values))]


def emission_advance(threshold: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def advance(step: np.ndarray, state: np.ndarray) -> np.ndarray:
        pieces = step.reshape(-1, 2)
        hit = np.flatnonzero(np.abs(pieces[:, 0] - state[0]) >= threshold)
        return np.array([pieces[hit[0], 1]]) if len(hit) else state

    return advance


# ----------------------------------------------------------------------------------- collecting


class Collected:
    """Where a sequence of kinds 0 … kinds − 1 has shown every kind since the last such place, by jump pointers.

    From any place the next full set ends at the largest of the kinds' next places, so full sets form chains, and doubling jumps
    follow all of them at once.
    """

    def __init__(self, kind: np.ndarray, kinds: int):
        self.n, self.kinds = len(kind), kinds
        self.places = [np.flatnonzero(kind == c) for c in range(kinds)]
        after = np.arange(-1, self.n)
        self.next = np.stack([np.append(p, self.n)[np.searchsorted(p, after, "right")] for p in self.places])
        # The place n stands for "not in this chunk".
        self.jump = np.append(self.next.max(axis=0)[1:], self.n)

    def first(self, mask: int) -> int:
        """The first full set when the kinds of ``mask`` were seen before the chunk."""
        return max(int(self.next[c, 0]) for c in range(self.kinds) if not mask >> c & 1)

    def exits(self) -> list[int]:
        """The kinds seen since the last full set, by the kinds seen before the chunk."""
        last = np.array([p[-1] if len(p) else -1 for p in self.places])
        bits = 1 << np.arange(self.kinds)
        end = np.where(self.jump == self.n, np.arange(self.n + 1), self.jump)
        for _ in range(self.n.bit_length()):
            end = end[end]
        out = []
        for mask in range((1 << self.kinds) - 1):
            q = self.first(mask)
            out.append(mask | int(bits[last >= 0].sum()) if q == self.n else int(bits[last > end[q]].sum()))
        return out

    def ends(self, mask: int) -> np.ndarray:
        """Places of all full sets after ``mask``."""
        reached = np.zeros(self.n + 1, dtype=bool)
        reached[self.first(mask)] = True
        jump = self.jump
        for _ in range(self.n.bit_length() + 1):
            reached[jump[np.flatnonzero(reached)]] = True
            jump = jump[jump]
        return np.flatnonzero(reached[: self.n])

    def latest(self, at: np.ndarray) -> np.ndarray:
        """(kinds, places) the last place of each kind up to ``at``, −1 if there is none."""
        return np.stack([np.append(-1, p)[np.searchsorted(p, at, "right")] for p in self.places])
