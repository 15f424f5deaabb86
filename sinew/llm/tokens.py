"""Token-id files: shards of raw ids in key order, each with a minimal perfect hash index over its keys.

A folder of token files holds

* `shards`, Parquet, a row per shard: its place (`part`, `seq`), smallest and largest key, number of texts and
  ids, `ids` (the raw payload: unsigned little-endian ids of `width` bytes, each text's ids followed by the end
  id) and `index` (the packed hash index, see `Index`);
* `starts`, Parquet, a row per shard: the number of ids in all shards before it.

Both are written by Spark's committed writers, so lost tasks leave nothing behind. A key is found in constant
time: its shard by the key ranges, its slot by the hash, its place by the slot's offset.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sinew.llm.frames import released
from sinew.llm.text import Hasher, Texts, mixed, owners

SHARD_BYTES = 2 << 20  # text bytes encoded into one shard; a longer text makes a shard of its own
STRETCH = 1 << 18  # text bytes encoded at once, if a single text is not longer
JOINED = 1 << 16  # bytes of new pieces that go through the library together
#: Classes of bytes: 0 part of other characters, 1 letter, 2 digit, 3 other printing ASCII, 4 white space, 5 the space.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[9:14] = 4
_CLASS[32] = 5
_APOSTROPHE = 39
_HASH = Hasher(10)

SHARDS = "part int, seq int, first_key long, last_key long, n_texts long, n_ids long, width int, ids binary, index binary"


def _cuts() -> np.ndarray:
    """By classes of two neighbouring bytes: whether words are split between them whatever stands around."""
    out = np.zeros((6, 6), bool)
    out[1:4, 4:6] = True  # before white space
    for a in (1, 2, 3):
        for b in (1, 2, 3):
            out[a, b] = a != b
    return out


_CUT = _cuts().ravel()


class Pieces:
    """Ids of the pieces a worker has met, by hash: an open table that is emptied when full."""

    def __init__(self, bits: int = 20):
        self.mask, self.most = (1 << bits) - 1, 3 << (bits - 2)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.mask + 1, np.uint64)
        self.place = np.zeros(self.mask + 1, np.int32)
        self.base, self.size, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 where unknown. The key 0 is never stored."""
        out = np.full(len(keys), -1, np.int64)
        slot, open_ = (keys & np.uint64(self.mask)).astype(np.int64), None
        while True:
            there = self.keys[slot]
            same = there == keys
            rest = ~same & (there != 0)
            hit = np.flatnonzero(same)
            if open_ is None:
                out[hit] = self.place[slot[hit]]
                open_ = np.flatnonzero(rest)
            else:
                out[open_[hit]] = self.place[slot[hit]]
                open_ = open_[rest]
            if not len(open_):
                return out
            slot, keys = slot[rest] + 1 & self.mask, keys[rest]

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Store distinct unknown keys with their ids, flat."""
        place = np.arange(len(self.size), len(self.size) + len(keys), dtype=np.int32)
        self.base = np.concatenate([self.base, (len(self.flat) + np.cumsum(sizes) - sizes).astype(np.int32)])
        self.size = np.concatenate([self.size, sizes.astype(np.int32)])
        self.flat = np.concatenate([self.flat, ids])
        slot = (keys & np.uint64(self.mask)).astype(np.int64)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            won = free & (self.keys[slot] == keys)
            self.place[slot[won]] = place[won]
            slot, keys, place = slot[~won] + 1 & self.mask, keys[~won], place[~won]


class Encoder:
    """Encodes many texts by their distinct pieces.

    A byte-level tokenizer splits texts into words before it merges anything. Texts are cut where that split has a
    boundary whatever stands around: between two ASCII classes (letters, digits, others), before white space, after
    a single white space that is not a space, and before the last character of a longer run of white space that a
    word follows. A text's ids are those of its pieces; only pieces a worker has not met go
    through the library, joined into longer texts at such boundaries. Texts with a special token go whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel units
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        #: Bytes of each id's token: byte-level tokens have a character for every byte.
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = Pieces()

    def _cut(self, texts: Texts) -> np.ndarray:
        data, n = texts.data, len(texts.data)
        kind = _CLASS[data]
        cut = np.zeros(n + 1, bool)
        if n > 1:
            pair = kind[:-1] * np.uint8(6) + kind[1:]
            cut[1:n] = _CUT[pair]
            # Contractions start with an apostrophe.
            cut[1:n] &= ~((data[:-1] == _APOSTROPHE) & (kind[1:] == 1))
            # Two-byte characters from U+00C0 on are no white space.
            word = (kind >= 1) & (kind <= 3)
            solid = np.append(word[0], word[1:] | ((data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)))
            cut[2:n] |= (kind[2:] >= 4) & solid[1:-1]
            # A run of one stands alone if it is not a space; the last character of a longer run leaves the run before a word.
            cut[2:n] |= word[2:] & (kind[1:-1] == 4) & solid[:-2]
            head = np.zeros(n + 1, bool)
            head[texts.offsets] = True
            cut[1 : n - 1] |= word[2:] & (kind[1:-1] >= 4) & (kind[:-2] >= 4) & ~head[2:n]
        if self.special:
            raw = data.tobytes()
            for token in self.special:
                at = raw.find(token)
                while at >= 0:
                    d = int(np.searchsorted(texts.offsets, at, "right")) - 1
                    cut[texts.offsets[d] : texts.offsets[d + 1]] = False
                    at = raw.find(token, int(texts.offsets[d + 1]))
        cut[texts.offsets] = True
        return cut

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 offsets of each text's ids."""
        data, n = texts.data, len(texts.data)
        starts = np.flatnonzero(self._cut(texts)[:n])
        ends = np.append(starts[1:], n)
        keys = _HASH.ranges(data, starts, ends) | np.uint64(1)
        place = self.pieces.find(keys)
        new = np.flatnonzero(place < 0)
        if len(new):
            distinct, at = np.unique(keys[new], return_index=True)
            if len(self.pieces.size) + len(distinct) > self.pieces.most:
                self.pieces.clear()
                distinct, at, new = *np.unique(keys, return_index=True), np.arange(len(keys))
            if len(distinct) > self.pieces.most:
                self.pieces = Pieces(int(len(distinct)).bit_length() + 1)
            self._learn(data, distinct, starts[new[at]], ends[new[at]])
            place = self.pieces.find(keys)
        size, base = self.pieces.size[place].astype(np.int64), self.pieces.base[place].astype(np.int64)
        upto = np.cumsum(size)
        ids = self.pieces.flat[np.repeat(base - (upto - size), size) + np.arange(int(size.sum()))]
        return ids, np.concatenate([[0], upto])[np.searchsorted(starts, texts.offsets)]

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw, first, last = data.tobytes(), _CLASS[data[starts]], _CLASS[data[ends - 1]]
        # Pieces from a space to a letter can stand side by side in any number; all others go by themselves.
        letter = (last == 1) | ((data[ends - 1] >= 0x80) & (data[np.maximum(ends - 2, 0)] >= 0xC3) & (data[np.maximum(ends - 2, 0)] <= 0xDF))
        simple = (first == 5) & letter & (ends - starts > 1)
        ids: list[np.ndarray] = []
        sizes = np.zeros(len(keys), np.int64)
        order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
        width = ends - starts
        count = int(simple.sum())
        upto = np.concatenate([[0], np.cumsum(width[order[:count]])])
        a = 0
        while a < count:
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + JOINED, "right")) - 1)
            text = b"".join([raw[starts[i] : ends[i]] for i in order[a:b]])
            got = np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.uint32)
            token_end = np.cumsum(self.bytes[got])
            piece_end = np.searchsorted(token_end, upto[a + 1 : b + 1] - upto[a]) + 1
            sizes[a:b] = np.diff(piece_end, prepend=0)
            ids.append(got)
            a = b
        for a in range(count, len(order), 512):
            some = order[a : a + 512]
            for k, x in enumerate(self.tokenizer.encode_batch_fast([raw[starts[i] : ends[i]].decode() for i in some], add_special_tokens=False)):
                ids.append(np.array(x.ids, np.uint32))
                sizes[a + k] = len(ids[-1])
        self.pieces.add(keys[order], np.concatenate(ids), sizes)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """A worker's encoder, kept from task to task."""
    return Encoder(path)


def ended(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the end id after each text's."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end, np.uint32)
    out[np.arange(len(ids)) + owners(offsets)] = ids
    return out, offsets + np.arange(n + 1)


class Index:
    """Minimal perfect hash over a shard's keys by hashing and displacing.

    Keys are hashed to buckets of four on average; buckets, largest first, get the smallest displacement under
    which all their keys fall on free slots. A slot holds a 32-bit fingerprint of its key, the place of the
    key's first text in the shard and its number of texts; texts' offsets into the ids follow in text order.
    A null key is stored as a key of its own.
    """

    _HEAD = struct.Struct("<qqq")

    def __init__(self, seeds: np.ndarray, marks: np.ndarray, runs: np.ndarray, offsets: np.ndarray, keys: np.ndarray, nulls: int):
        self.seeds, self.marks, self.runs, self.offsets, self.keys, self.nulls = seeds, marks, runs, offsets, keys, nulls

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        return mixed(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))

    @staticmethod
    def _slot(h: np.ndarray, seed, n: int) -> np.ndarray:
        return (mixed(h + np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, nulls: int, offsets: np.ndarray) -> Index:
        """`keys` of the texts in order (equal keys side by side), then `nulls` texts without key."""
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(heads, len(keys)))
        h, n = cls._hash(keys[heads]), len(heads)
        buckets = max(1, (n + 3) // 4)
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        seeds, taken, slot = np.zeros(buckets, np.uint32), np.zeros(n, bool), np.zeros(n, np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.argsort(-np.diff(first), kind="stable"):
            own = order[first[b] : first[b + 1]]
            if not len(own):
                break
            seed, width = 0, 64
            while True:
                tried = cls._slot(h[own][None, :], np.arange(seed, seed + width, dtype=np.uint64)[:, None], n)
                fits = ~taken[tried].any(axis=1)
                if len(own) > 1:
                    ordered = np.sort(tried, axis=1)
                    fits &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if fits.any():
                    seed += int(np.argmax(fits))
                    break
                seed, width = seed + width, min(width * 2, 1 << 14)
            seeds[b] = seed
            slot[own] = cls._slot(h[own], seed, n)
            taken[slot[own]] = True
        marks, runs = np.zeros(n, np.uint32), np.zeros((n, 2), np.int64)
        marks[slot] = (h >> np.uint64(32)).astype(np.uint32)
        runs[slot, 0], runs[slot, 1] = heads, sizes
        return cls(seeds, marks, runs, offsets, keys, nulls)

    def find(self, key: int | None) -> tuple[int, int]:
        """First text of the key and its number of texts; (0, 0) if the shard does not have it."""
        if key is None:
            return len(self.keys), self.nulls
        n = len(self.marks)
        if not n:
            return 0, 0
        h = self._hash(np.array([key]))
        slot = int(self._slot(h, self.seeds[int(h[0] % np.uint64(len(self.seeds)))], n)[0])
        if self.marks[slot] != np.uint32(h[0] >> np.uint64(32)):
            return 0, 0
        first, count = self.runs[slot]
        return (int(first), int(count)) if self.keys[first] == key else (0, 0)

    def pack(self) -> bytes:
        head = self._HEAD.pack(len(self.keys), len(self.marks), self.nulls)
        return head + b"".join(x.tobytes() for x in (self.keys.astype("<i8"), self.offsets.astype("<i8"), self.runs.astype("<i8"), self.marks.astype("<u4"), self.seeds.astype("<u4")))

    @classmethod
    def unpack(cls, raw: bytes) -> Index:
        texts, distinct, nulls = cls._HEAD.unpack_from(raw)
        at, out = cls._HEAD.size, []
        for kind, n in (("<i8", texts), ("<i8", texts + nulls + 1), ("<i8", 2 * distinct), ("<u4", distinct), ("<u4", max(1, (distinct + 3) // 4))):
            out.append(np.frombuffer(raw, kind, n, at))
            at += out[-1].nbytes
        keys, offsets, runs, marks, seeds = out
        return cls(seeds, marks, runs.reshape(-1, 2), offsets, keys, nulls)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", *, end: int = 0, parts: int | None = None) -> None:
    """Write the folder of token files of all texts, in ascending key order.

    A null text is an empty one and has the end id only. Null keys come last. Rows with equal keys all stay, ordered by
    a hash of their texts, and the index gives them as one run. No rows give an empty folder of both tables.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    order = [F.col("key").asc_nulls_last(), F.col("h").asc()]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _shards(batches, encoder(tokenizer), TaskContext.get().partitionId(), end)

    rows.mapInArrow(run, SHARDS).write.option("compression", "none").option("parquet.block.size", 8 << 20).option("parquet.page.size.row.check.min", 1).option("parquet.page.size.row.check.max", 1).parquet(f"{path}/shards")
    shards = spark.read.parquet(f"{path}/shards").select("part", "seq", "n_ids")
    # Parts are as many as partitions were asked for; only their sums meet in one task.
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    shards.select("part", "seq", within.alias("inside")).join(before, "part").select(
        "part", "seq", (F.col("part_start") + F.col("inside")).alias("start")
    ).write.parquet(f"{path}/starts")


class _Shard:
    """The keys, ids and offsets of a shard's texts, as they are encoded."""

    def __init__(self):
        self.keys, self.ids, self.sizes, self.bytes, self.n_ids = [], [], [], 0, 0

    def add(self, by: Encoder, keys: pa.Array, texts: Texts, end: int) -> None:
        for a, b in texts.blocks(STRETCH):
            ids, offsets = ended(*by.encode(texts.part(a, b)), end)
            self.ids.append(ids.astype(f"<u{by.width}"))
            self.sizes.append(np.diff(offsets))
            self.n_ids += len(ids)
        self.keys.append(keys)
        self.bytes += len(texts.data)

    def row(self, by: Encoder, part: int, seq: int) -> pa.RecordBatch:
        keys = pa.concat_arrays(self.keys)
        known = keys.drop_null().to_numpy().astype(np.int64)
        offsets = np.concatenate([[0], *self.sizes]).cumsum()
        index = Index.build(known, keys.null_count, offsets).pack()
        first, last = (int(known[0]), int(known[-1])) if len(known) else (None, None)
        raw = b"".join(x.data for x in self.ids)
        row = {"part": part, "seq": seq, "first_key": first, "last_key": last, "n_texts": len(keys), "n_ids": self.n_ids, "width": by.width, "ids": raw, "index": index}
        types = {"part": pa.int32(), "seq": pa.int32(), "width": pa.int32(), "ids": pa.binary(), "index": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([v], types.get(k, pa.int64())) for k, v in row.items()], names=list(row))


def _shards(batches: Iterator[pa.RecordBatch], by: Encoder, part: int, end: int) -> Iterator[pa.RecordBatch]:
    """Rows of shards; a shard holds its ids, and of its texts only the batch that is being encoded."""
    seq, shard = 0, _Shard()
    for batch in batches:
        texts = Texts.of(batch.column(1))
        for a, b in texts.blocks(STRETCH):
            # The keys are copied, so that they do not hold their batch.
            shard.add(by, pa.array(batch.column(0).slice(a, b - a).to_pylist(), pa.int64()), texts.part(a, b), end)
            if shard.bytes >= SHARD_BYTES:
                yield shard.row(by, part, seq)
                seq, shard = seq + 1, _Shard()
        del texts, batch
        released()
    if shard.keys:
        yield shard.row(by, part, seq)


def read_tokens(spark: SparkSession, path: str, columns: str, of_text: Callable[[int | None, int, np.ndarray], tuple]) -> DataFrame:
    """`of_text(key, start, ids)` of every stored text, ids as 32-bit little-endian numbers; each is found through the index."""
    shards = spark.read.parquet(f"{path}/shards").join(spark.read.parquet(f"{path}/starts"), ["part", "seq"])
    return shards.select("start", "width", "ids", "index").mapInArrow(_reader(columns, of_text), columns)


def _reader(columns: str, of_text: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, width, raw, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                index, rows = Index.unpack(packed), []
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                keys = [*dict.fromkeys(index.keys.tolist()), *([None] if index.nulls else [])]
                for key in keys:
                    first, count = index.find(key)
                    for i in range(first, first + count):
                        a, b = index.offsets[i], index.offsets[i + 1]
                        rows.append(of_text(key, start + int(a), ids[a:b]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[c.split()[0] for c in columns.split(",")])

    return run


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, ids) of every stored text of the given keys; keys that are not stored give no row.

    The shard of a key comes from the shards' key ranges (a small table without payloads), and only shards
    that may hold a key are read.
    """
    shards = spark.read.parquet(f"{path}/shards").join(spark.read.parquet(f"{path}/starts"), ["part", "seq"])
    wanted = keys.select(F.col(key).cast("long").alias("wanted")).where("wanted IS NOT NULL").distinct()
    ranges = shards.select("part", "seq", "first_key", "last_key")
    found = wanted.join(ranges, F.col("wanted").between(F.col("first_key"), F.col("last_key"))).select("part", "seq", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key_, start, width, raw, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                index = Index.unpack(packed)
                first, count = index.find(key_)
                ids = np.frombuffer(raw, f"<u{width}").astype(np.int64)
                spans = [(index.offsets[i], index.offsets[i + 1]) for i in range(first, first + count)]
                if spans:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key_] * count), pa.array([start + int(a) for a, _ in spans]), pa.array([ids[a:b].tolist() for a, b in spans], pa.list_(pa.int64()))],
                        names=[key, "start", "ids"],
                    )

    return found.join(shards, ["part", "seq"]).select("wanted", "start", "width", "ids", "index").mapInArrow(run, f"`{key}` long, start long, ids array<long>")


def token_digest(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every text, read back from the files."""
    columns = f"{key} long, start long, n_tokens long, ids_crc32 long"
    return read_tokens(spark, path, columns, lambda k, start, ids: (k, start, len(ids), zlib.crc32(ids.tobytes())))
