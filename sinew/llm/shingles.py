"""Near-duplicates by Jaccard similarity of word shingles: candidates from SimHash and from bands of least hashes, then an exact check.

Texts whose SimHash fingerprints are linked, by the search of `simhash`, are candidates of each other. At 4 of 64 bits that misses most
pairs of similarity 0.8, so bands add candidates. Every text is the set of the hashes of its shingles. A band joins the least values of `ROWS` hash functions over the set;
texts of similarity s share one of `BANDS` bands with probability 1 - (1 - s^ROWS)^BANDS, all but 3 of a million at 0.8.
Candidates count only if their whole sets are as similar as asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sinew.llm import simhash
from sinew.llm.components import components
from sinew.llm.frames import field, fresh_name, map_texts, released, stored
from sinew.llm.text import SPACED_WORD, Hasher, Texts, joined, mixed, owners

WIDTH = 5
SIMILAR = 0.8
BANDS, ROWS = 32, 5
SKETCH = 16  # longs of a set's sketch
_HASH = Hasher(8)
_FACTORS = np.random.default_rng(8).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: Texts, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of every text's shingles, ascending, and each text's first, n + 1.

    A text of fewer words has one shingle of all of them, a text without words none.
    """
    low = texts.lowered()
    starts, ends, first = low.words(SPACED_WORD)
    words, hashes = np.diff(first), _HASH.ranges(low.data, starts, ends)
    count = np.maximum(words - width + 1, 0)
    owner = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]
    short = np.flatnonzero((words > 0) & (words < width))
    rest = [joined(hashes[first[i] : first[i + 1]], int(words[i])) for i in short]
    flat = np.concatenate([joined(hashes, width)[at], *rest])
    owner = np.concatenate([owner, short])
    order = np.lexsort((flat, owner))
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    return flat[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def numbered(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number of each set, equal for equal sets; 0 for the empty one."""
    size = np.diff(first)
    full = np.flatnonzero(size)
    node = np.zeros(len(size), np.uint64)
    if len(full):
        node[full] = mixed(np.add.reduceat(mixed(flat ^ _STEP), first[full]) + size[full].astype(np.uint64))
    return node.view(np.int64)


def band_keys(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The keys by band of each set that is not empty."""
    full = np.flatnonzero(np.diff(first))
    heads = first[full]
    keys = np.zeros((len(full), BANDS), np.uint64)
    if len(full):
        for band in range(BANDS):
            key = np.full(len(full), band, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                key = key * _STEP + np.minimum.reduceat(flat * _FACTORS[k], heads)
            keys[:, band] = mixed(key)
    return keys.view(np.int64)


def sketches(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """`SKETCH` longs of each set, whose bits tell whether an odd number of its hashes belongs to them.

    A hash in one of two sets turns one bit, so two sketches differ in at most as many bits as hashes are in one set only.
    """
    bits = 64 * SKETCH
    place = (flat >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64) + bits * owners(first)
    odd = np.bincount(place, minlength=bits * (len(first) - 1)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, SKETCH)


def similar(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose sets (x, y: ascending hashes) have at least that similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = both >= least * (len(x) + len(y) - both) - 1e-9
            yield batch.select([0, 1]).filter(pa.array(keep))
        released()

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def by_fingerprint(prints: DataFrame) -> DataFrame:
    """(key, node, size): texts with words of `prints` (node, size, fingerprint), under a key for each class of linked fingerprints."""
    full = stored(prints.where("size > 0").select("fingerprint", "node", "size").distinct(), "fingerprints")
    roots = components(simhash.links(full.select("fingerprint").distinct())).toDF("fingerprint", "root")
    key = F.xxhash64(F.coalesce("root", "fingerprint"), F.lit(BANDS))
    return full.join(roots, "fingerprint", "left").select(key.alias("key"), "node", "size")


def distinct_keys(members: DataFrame) -> DataFrame:
    """`members` (key, node, …) without keys that have the very nodes of a smaller key: alike texts share many keys, and one says it all."""
    hashes = F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("x")
    alike = members.groupBy("key").agg(F.count("*").alias("n"), *hashes).groupBy("n", "s", "x").agg(F.min("key").alias("key"))
    return members.join(alike.select("key"), "key", "left_semi")


def links(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(node, root) over the verified links of `members` (band key, node, size); `sets` has each node's set and sketch.

    In every round the members of a key are compared with a few of them, its pivots, which then leave it, until a key's
    members are all of one component. Keys that stay open get more pivots from round to round. All pairs under a key are
    so compared or already joined, and a large group of copies costs a comparison a member and no square. Sizes and sketches
    rule out nearly all unlike pairs inside the join; only pairs that may be similar become rows and meet their sets.
    """
    signs = [f"s{i}" for i in range(SKETCH)]
    signed = sets.select("node", *[F.col("sketch")[i].alias(s) for i, s in enumerate(signs)])
    open_ = stored(members.join(signed, "node").withColumn("root", F.col("node")), "open")
    roots, pivots = members.sparkSession.createDataFrame([], "node long, root long"), 1
    while open_.take(1):
        slot = F.pmod(F.xxhash64("node", F.lit(pivots)), F.lit(pivots))
        chosen = open_.groupBy("key", slot.alias("slot")).agg(F.min(F.struct("node", "size", "root", *signs)).alias("p")).select("key", "p.*")
        chosen = stored(chosen.toDF("key", "p", "p_size", "p_root", *[f"p_{s}" for s in signs]), "pivots")
        differ = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(f"p_{s}"))) for s in signs[1:]), F.bit_count(F.col(signs[0]).bitwiseXOR(F.col(f"p_{signs[0]}"))))
        fits = (F.least("size", "p_size") >= least * F.greatest("size", "p_size") - 1e-9) & (F.col("root") != F.col("p_root"))
        fits &= differ <= (1 - least) / (1 + least) * (F.col("size") + F.col("p_size")) + 1e-9
        ends = F.struct("node", "root"), F.struct(F.col("p").alias("node"), F.col("p_root").alias("root"))
        pairs = open_.join(chosen, "key").where(fits).select(F.least(*ends).alias("l"), F.greatest(*ends).alias("g")).distinct()
        pairs = stored(pairs.selectExpr("l.node AS l", "g.node AS g", "l.root AS a", "g.root AS b"), "pairs")
        shingles = sets.select("node", "shingles")
        new = components(similar(pairs.join(shingles.toDF("l", "x"), "l").join(shingles.toDF("g", "y"), "g"), least))
        roots = roots.join(new.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")).unionByName(new)
        rest = open_.join(chosen.select("key", F.col("p").alias("node")), ["key", "node"], "left_anti").join(new.toDF("root", "to"), "root", "left")
        rest = stored(rest.withColumn("root", F.coalesce("to", "root")).drop("to"), "rest")
        more = rest.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        open_ = stored(rest.join(more, "key", "left_semi"), "open")
        pivots *= 8
    return stored(roots, "roots")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", *, width: int = WIDTH, least: float = SIMILAR) -> DataFrame:
    """One row of every group of texts linked by similarities of at least `least`: that of the smallest key (null last), with all its columns.

    Words are lower-cased runs without white space. Null texts count as empty ones; texts without words are one group. Of rows
    with equal keys one is kept, by a hash of the row; rows that agree in everything count once.
    """
    own = fresh_name(docs.columns, "row_hash")
    marked = docs.withColumn(own, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    plain = marked.select(F.col(key).alias("key"), F.col(own).alias("h"), F.col(text).alias("text"))

    def sign(texts: Texts, _) -> list:
        flat, first = shingle_sets(texts, width)
        size = np.diff(first)
        at = np.concatenate([[0], np.cumsum(size > 0)]) * BANDS
        bands = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(band_keys(flat, first).ravel()))
        return [numbered(flat, first), size.astype(np.int32), bands, simhash.fingerprints(texts, width).view(np.int64)]

    fields = [field("node", T.LongType()), field("size", T.IntegerType()), field("bands", T.ArrayType(T.LongType())), field("fingerprint", T.LongType())]
    prints = stored(map_texts(plain, "text", sign, fields, keep=["key", "h"]), "prints")
    order = F.struct(F.col("key").isNull().alias("last"), F.col("key").alias("key"), F.col("h").alias("h"))
    nodes = stored(prints.groupBy("node").agg(F.min(order).alias("least")), "nodes")
    keyed = prints.select(F.explode("bands").alias("key"), "node", "size").unionByName(by_fingerprint(prints)).distinct()
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    members = stored(distinct_keys(stored(keyed.join(shared, "key"), "keyed")), "members")

    def whole(texts: Texts, _) -> list:
        flat, first = shingle_sets(texts, width)
        each = [flat[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        return [numbered(flat, first), each, list(sketches(flat, first))]

    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select(F.col("least.h").alias("h"))
    rows = plain.join(wanted, "h", "left_semi").dropDuplicates(["key", "h"])
    fields = [field("node", T.LongType()), field("shingles", T.BinaryType()), field("sketch", T.ArrayType(T.LongType()))]
    sets = map_texts(rows, "text", whole, fields, keep=[])
    roots = links(members, stored(sets.dropDuplicates(["node"]), "sets"), least)
    rooted = nodes.join(roots, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    chosen = rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.key", "least.h")
    kept = marked.join(chosen, marked[own].eqNullSafe(chosen["h"]) & marked[key].eqNullSafe(chosen["key"]), "left_semi")
    return kept.dropDuplicates([own, key]).drop(own)
