"""SimHash near-duplicates: fingerprints of word shingles, linked by a generalised pigeonhole search.

The 64 bits are divided into parts of correlated bits. If two fingerprints differ in at most T bits, then for
any thresholds t_i >= -1 with sum(t_i) = T - parts + 1 some part differs in at most t_i bits. A dynamic
programme picks the number of parts and their thresholds with the least estimated work, every fingerprint
is put under the keys its parts give with any t_i bits blanked, and fingerprints under one key are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, inf

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sinew.llm.components import components
from sinew.llm.frames import field, fresh_name, map_texts, stored
from sinew.llm.text import SPACED_WORD, Texts

BITS = 64
PIECE = 1 << 18  # shingles counted at once
SMALL = 32  # keys with up to so many fingerprints are compared by shifts of the whole batch
WIDE = 1 << 14  # keys with more are divided by the bits they do not share


def fingerprints(texts: Texts, width: int = 4, seed: int = 42) -> np.ndarray:
    """One 64-bit majority fingerprint per text; 0 for a text without words."""
    low = texts.lowered()
    starts, ends, first = low.words(SPACED_WORD)
    length = ends - starts
    at = np.cumsum(length + 1) - length - 1
    plain = np.full(int(length.sum()) + len(length), 32, np.uint8)
    plain[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = low.data[SPACED_WORD[low.data]]
    words = np.diff(first)
    shingles = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    begin = np.concatenate([[0], np.cumsum(shingles)])
    owner = np.repeat(np.arange(len(texts)), shingles)
    word = np.arange(begin[-1]) - begin[owner] + first[owner]
    last = np.minimum(word + width, first[owner + 1]) - 1
    buffer, digest = plain.tobytes(), xxhash.xxh64_intdigest
    counts = np.zeros((len(texts), BITS), np.int64)
    for a in range(0, len(word), PIECE):
        w, z, own = word[a : a + PIECE], last[a : a + PIECE], owner[a : a + PIECE]
        spans = zip(at[w].tolist(), (at[z] + length[z]).tolist(), strict=True)
        h = np.fromiter((digest(buffer[x:y], seed) for x, y in spans), np.uint64, len(w))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.flatnonzero(np.diff(own, prepend=-1))
        counts[own[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    major = (2 * counts > shingles[:, None]).astype(np.uint8)
    return np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()


def with_fingerprint(docs: DataFrame, text: str, name: str, *, keep: list[str] | None = None, width: int = 4, seed: int = 42) -> DataFrame:
    """Rows with a long column of the fingerprint's bits; a null text is an empty one."""
    return map_texts(docs, text, lambda t, _: [fingerprints(t, width, seed).view(np.int64)], [field(name, T.LongType())], keep=keep)


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bits i and j set: 64 x 64 sums, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = np.frombuffer(batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), np.uint8).reshape(-1, 8)
            bits = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        cell = np.arange(BITS * BITS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(np.append(total.ravel(), n).astype(np.int64))], names=["cell", "n"])

    rows = nodes.select("fingerprint").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS + 1)
    for row in rows:
        out[row["cell"]] = row["n"]
    return int(out[-1]), out[:-1].reshape(BITS, BITS)


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of nearly equal size, each bit with those it is most correlated with."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    correlation = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(correlation, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, groups))) // (parts - k)
        group = [max(free, key=lambda b: (correlation[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda b: (correlation[b, group].sum(), -b)))
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def part_cost(n: int, agree: np.ndarray, threshold: int, row_cost: float) -> float:
    """Estimated work of a part: its keys, and the pairs that meet under them if bits agree independently."""
    if threshold < 0:
        return 0.0
    whole = float(np.prod(agree))
    # Elementary symmetric sum of 1/agree: the pairs that agree on all but `threshold` blanked bits.
    sums = np.zeros(threshold + 1)
    sums[0] = 1.0
    for x in 1 / agree:
        sums[1:] += sums[:-1] * x
    return n * comb(len(agree), threshold) * row_cost + n * n / 2 * whole * sums[threshold]


def allocate(n: int, both: np.ndarray, most: int, row_cost: float = 300.0) -> list[tuple[list[int], int]]:
    """Parts with thresholds of least estimated work for finding all pairs that differ in at most `most` bits.

    Any allocation finds the same pairs. `row_cost` is the cost of a key row in comparisons.
    """
    p = np.diag(both) / max(n, 1)
    agree = np.clip(p * p + (1 - p) * (1 - p), 0.5, 1.0)
    best: tuple[float, list[tuple[list[int], int]]] = (inf, [])
    for parts in range(1, most + 2):
        groups, budget = grouped_bits(n, both, parts), most - parts + 1
        # least[s]: cost and thresholds of the parts so far whose thresholds sum to s.
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            reached: dict[int, tuple[float, list[int]]] = {}
            for s, (cost, chosen) in least.items():
                for t in range(-1, most + 1):
                    c = cost + part_cost(n, agree[group], t, row_cost)
                    if c < reached.get(s + t, (inf,))[0]:
                        reached[s + t] = (c, [*chosen, t])
            least = reached
        if budget in least and least[budget][0] < best[0]:
            best = (least[budget][0], list(zip(groups, least[budget][1], strict=True)))
    return [(g, t) for g, t in best[1] if t >= 0]


def masks(plan: list[tuple[list[int], int]]) -> list[int]:
    """One mask of compared bits for each part and choice of blanked bits."""
    return [sum(1 << b for b in set(group) - set(blank)) for group, t in plan for blank in combinations(group, t)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def forest(fps: np.ndarray, most: int, free: int = (1 << 64) - 1) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join all of `fps` that are connected by steps of at most `most` bits; at most one link per fingerprint and division.

    A large set is divided by most + 1 groups of the `free` bits (those it need not share): two fingerprints
    that differ in at most `most` bits agree on one group.
    """
    left, right = [], []
    bits = [b for b in range(BITS) if free >> b & 1]
    if len(fps) > WIDE and len(bits) > most:
        for k in range(most + 1):
            own = sum(1 << b for b in bits[k :: most + 1])
            value = fps & np.uint64(own)
            order = np.argsort(value, kind="stable")
            cuts = np.flatnonzero(np.diff(value[order])) + 1
            for part in np.split(order, cuts):
                if len(part) > 1:
                    a, b = forest(fps[part], most, free & ~own)
                    left += a
                    right += b
        return left, right
    todo = fps
    while len(todo) > 1:
        frontier, todo = [todo[0]], todo[1:]
        while frontier and len(todo):
            at = frontier.pop()
            near = np.bitwise_count(todo ^ at) <= most
            if near.any():
                hits = todo[near]
                left.append(np.full(len(hits), at))
                right.append(hits)
                frontier.extend(hits)
                todo = todo[~near]
    return left, right


def key_links(key: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints of equal keys; rows come ordered by key."""
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(heads, len(key)))
    left, right = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    for lag in range(1, min(SMALL, len(key))):
        near = (key[lag:] == key[:-lag]) & small[lag:] & (np.bitwise_count(fps[lag:] ^ fps[:-lag]) <= most)
        at = np.flatnonzero(near)
        left.append(fps[at])
        right.append(fps[at + lag])
    for h, size in zip(heads[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        a, b = forest(fps[h : h + size], most)
        left += a
        right += b
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def links(nodes: DataFrame, most: int = 4) -> DataFrame:
    """Verified links (a, b) between fingerprints of at most `most` differing bits, enough to connect all that are.

    `nodes` has distinct fingerprints. Keys shared by many give a spanning forest, not all pairs.
    """
    count, both = bit_counts(nodes)
    chosen = masks(allocate(max(count, 1), both, most))
    keys = nodes.select("fingerprint", F.posexplode(F.array(*[F.lit(_signed(m)) for m in chosen])).alias("m", "mask"))
    keys = keys.select("m", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("v"), "fingerprint")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartition(parts, "m", "v").sortWithinPartitions("m", "v", "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((3, 0), np.int64)
        for batch in batches:
            rows = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])], axis=1)
            if not rows.shape[1]:
                continue
            # The last key may go on in the next batch.
            others = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
            whole = int(others[-1]) + 1 if len(others) else 0
            yield from _found(rows[:, :whole], most)
            rest = rows[:, whole:]
        yield from _found(rest, most)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _found(rows: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    if rows.shape[1] < 2:
        return
    change = np.concatenate([[True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])
    a, b = key_links(np.cumsum(change), rows[2].view(np.uint64), most)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a.view(np.int64), b.view(np.int64))), pa.array(np.maximum(a.view(np.int64), b.view(np.int64)))], names=["a", "b"])


def classes(prints: DataFrame, least: Column, most: int = 4) -> DataFrame:
    """(fingerprint, least) for every fingerprint of `prints`: the smallest value of `least` in its component."""
    nodes = stored(prints.groupBy("fingerprint").agg(F.min(least).alias("least")), "fingerprints")
    roots = components(links(nodes, most))
    rooted = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    rooted = stored(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("least"))
    return rooted.select("fingerprint", "root").join(smallest, "root").select("fingerprint", "least")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", *, most: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """(key, fingerprint, component_id) for every row: 16 hex digits, and the smallest key reachable over links.

    Null texts count as empty ones, whose fingerprint is zero; rows with a null key link like others but give
    no component number unless all keys of a component are null. Repeated rows stay repeated. Other columns
    are not read, whatever their names.
    """
    prints = stored(with_fingerprint(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", "fingerprint", keep=["key"], width=width, seed=seed), "prints")
    found = classes(prints, F.col("key"), most)
    return prints.join(found, "fingerprint").select(
        F.col("key").alias(key), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id")
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", *, most: int = 4, width: int = 4) -> DataFrame:
    """One row of every group of near-duplicates: that of the smallest key (null last), with all its columns.

    Of rows with equal keys one is kept, by a hash of the row; rows that agree in everything count once.
    """
    mark, own = fresh_name(docs.columns, "fingerprint"), fresh_name(docs.columns, "row_hash")
    marked = docs.withColumn(own, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    prints = with_fingerprint(marked.select(F.col(key).alias("key"), F.col(own).alias("h"), F.col(text).alias("text")), "text", "fingerprint", keep=["key", "h"], width=width)
    prints = stored(prints, "prints")
    order = F.struct(F.col("key").isNull().alias("last"), F.col("key").alias("key"), F.col("h").alias("h"))
    chosen = classes(prints, order, most).select("least.key", "least.h").distinct()
    kept = marked.join(chosen, marked[own].eqNullSafe(chosen["h"]) & marked[key].eqNullSafe(chosen["key"]), "left_semi")
    return kept.dropDuplicates([own, key]).drop(own, mark)
