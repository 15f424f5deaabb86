"""BPE encoding through a table of distinct words, decoding through an id-to-piece join.

Texts are split where a byte-level tokenizer always splits (see `tokens.Encoder`), so a text's ids are those of its words, one
after the other. Words go through three steps:

* a pass over the texts, in blocks, sends every block's distinct words to buckets of the word table by hash;
* a bucket merges what the blocks sent and encodes each distinct word once;
* the ids return to the blocks, where they meet the texts of a second pass and are joined back by position.

A word travels once per block that has it, however often the block does, as rows (block, bucket) of word lists: a row per
occurrence would be many times the size of the texts. Blocks are numbered by scan task and place, so `docs` has to give the same rows
in the same order twice, as files and written tables do; sums over the words of each row are compared, and a difference ends the job.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinew.llm.frames import BLOCK, released
from sinew.llm.text import Hasher, Texts
from sinew.llm.tokens import encoder

WORDS_BLOCK = 16 << 20  # text bytes whose words are sent together; a longer text makes a block of its own
BUCKET = 64 << 20  # text bytes per bucket of the word table
_BATCH = 4096
_HASH = Hasher(13)


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Items of the ranges one after the other."""
    upto = np.cumsum(sizes)
    return data[np.repeat(starts - (upto - sizes), sizes) + np.arange(int(upto[-1]) if len(upto) else 0)]


class Block:
    """Texts of one block, and their words in pieces of at most `BLOCK` bytes (or one longer text)."""

    def __init__(self, texts: Texts, path: str):
        self.texts, self.path = texts, path

    def words(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """First and last text, and starts, ends (in the piece's bytes) and hashes of the words of each piece."""
        by = encoder(self.path)
        for a, b in self.texts.blocks(BLOCK):
            part = self.texts.part(a, b)
            n = len(part.data)
            starts = np.flatnonzero(by._cut(part)[:n])
            ends = np.append(starts[1:], n)[: len(starts)]
            yield a, b, starts, ends, _HASH.ranges(part.data, starts, ends)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ascending hashes of the distinct words, and where each stands in the block."""
        hashes, starts, sizes = [], [], []
        for a, _, s, e, h in self.words():
            own, at = np.unique(h, return_index=True)
            hashes.append(own)
            starts.append(s[at] + self.texts.offsets[a])
            sizes.append((e - s)[at])
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        own, at = np.unique(np.concatenate(hashes), return_index=True)
        return own, np.concatenate(starts)[at], np.concatenate(sizes)[at]


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, list, Texts]]:
    """Numbered blocks of rows (key, text)."""
    number = TaskContext.get().partitionId() << 32
    keys, parts, held = [], [], 0

    def joined() -> Texts:
        offsets = np.concatenate([[0], *(np.diff(p.offsets) for p in parts)]).cumsum()
        return Texts(np.concatenate([p.data for p in parts]), offsets)

    for batch in batches:
        texts = Texts.of(batch.column(1))
        for a, b in texts.blocks(size):
            part = texts.part(a, b)
            if held and held + len(part.data) > size:
                yield number, keys, joined()
                number, keys, parts, held = number + 1, [], [], 0
            keys += batch.column(0).slice(a, b - a).to_pylist()
            parts.append(Texts(part.data.copy(), part.offsets.copy()))
            held += len(part.data)
    if keys:
        yield number, keys, joined()


def _bounds(parts: int) -> np.ndarray:
    """Hashes that start the buckets 1, 2, …"""
    return np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)


def _shares(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each bucket's words begin among ascending hashes, parts + 1."""
    return np.concatenate([[0], np.searchsorted(hashes, _bounds(parts)), [len(hashes)]])


WORDS = "bucket int, block long, sizes array<int>, words binary"
IDS = "bucket int, block long, counts array<int>, ids binary, total long"
TEXTS = "block long, keys array<long>, sizes array<long>, bytes long, data binary"


def _send(path: str, parts: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, texts in _blocks(batches, size):
            hashes, starts, sizes = Block(texts, path).distinct()
            cuts = _shares(hashes, parts)
            rows = [(p, a, b) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            if rows:
                yield pa.RecordBatch.from_arrays([
                    pa.array([p for p, _, _ in rows], pa.int32()),
                    pa.array([number] * len(rows), pa.int64()),
                    pa.array([sizes[a:b] for _, a, b in rows], pa.list_(pa.int32())),
                    pa.array([_gathered(texts.data, starts[a:b], sizes[a:b]).tobytes() for _, a, b in rows], pa.binary()),
                ], names=["bucket", "block", "sizes", "words"])
            released()

    return run


def _encode(path: str):
    def run(table: pa.Table) -> pa.Table:
        """Ids of all words of a bucket; each distinct one goes through the library once."""
        by = encoder(path)
        raw = b"".join(table["words"].to_pylist())
        data = np.frombuffer(raw, np.uint8)
        lists = table["sizes"].combine_chunks()
        sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        hashes = _HASH.ranges(data, ends - sizes, ends)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        flat, counts = [], np.zeros(len(first), np.int64)
        for a in range(0, len(first), _BATCH):
            some = first[a : a + _BATCH]
            got = by.tokenizer.encode_batch_fast([raw[ends[i] - sizes[i] : ends[i]].decode() for i in some], add_special_tokens=False)
            ids = [x.ids for x in got]
            counts[a : a + len(ids)] = [len(x) for x in ids]
            flat.append(np.array([i for x in ids for i in x], f"<u{by.width}"))
        flat, begins = np.concatenate(flat), np.cumsum(counts) - counts
        rows = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        mine = [which[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True)]
        return pa.table({
            "bucket": table["bucket"],
            "block": table["block"],
            "counts": pa.array([counts[w] for w in mine], pa.list_(pa.int32())),
            "ids": pa.array([_gathered(flat, begins[w], counts[w]).tobytes() for w in mine], pa.binary()),
            "total": pa.array([int(hashes[a:b].sum().view(np.int64)) for a, b in zip(rows[:-1], rows[1:], strict=True)], pa.int64()),
        })

    return run


def _texts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, keys, texts in _blocks(batches, size):
            raw = texts.data.tobytes()
            yield pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([np.diff(texts.offsets)], pa.list_(pa.int64())),
                pa.array([len(raw)], pa.int64()), pa.array([pa.compress(raw, codec="zstd", asbytes=True)], pa.binary()),
            ], names=["block", "keys", "sizes", "bytes", "data"])
            released()

    return run


def _join(path: str, parts: int, key: str):
    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        """(key, ids) of a block's texts from the ids of its distinct words, in ascending order of their hashes."""
        released()
        (row,) = texts.to_pylist()
        data = np.frombuffer(pa.decompress(row["data"], row["bytes"], codec="zstd", asbytes=True), np.uint8) if row["bytes"] else np.zeros(0, np.uint8)
        block = Block(Texts(data, np.concatenate([[0], np.cumsum(row["sizes"])]).astype(np.int64)), path)
        hashes, _, _ = block.distinct()
        found = found.sort_by("bucket")
        cuts = _shares(hashes, parts)
        buckets = found["bucket"].to_numpy()
        totals = [int(hashes[cuts[p] : cuts[p + 1]].sum().view(np.int64)) for p in buckets]
        counts = found["counts"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) if len(found) else np.zeros(0, np.int64)
        if len(counts) != len(hashes) or totals != found["total"].to_pylist():
            raise RuntimeError("the documents were not the same in both passes: write them to a table first")
        ids = np.frombuffer(b"".join(found["ids"].to_pylist()), f"<u{encoder(path).width}")
        begins = np.cumsum(counts) - counts
        flat, ends = [], [np.zeros(1, np.int64)]
        done = 0
        for a, b, starts, _, own in block.words():
            which = np.searchsorted(hashes, own)
            flat.append(_gathered(ids, begins[which], counts[which]).astype(np.int32))
            upto = np.concatenate([[0], np.cumsum(counts[which])])
            ends.append(done + upto[np.searchsorted(starts, block.texts.offsets[a + 1 : b + 1] - block.texts.offsets[a])])
            done += int(upto[-1])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))
        return pa.table({key: pa.array(row["keys"], pa.int64()), "ids": lists})

    return run


def encoded(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", *, size: int = WORDS_BLOCK, parts: int | None = None) -> DataFrame:
    """(key, ids) of every row: the ids of its whole text, without special tokens around it.

    A null text is an empty one and has no ids; null keys and repeated rows stay rows of their own; other columns are not read. Strings of
    special tokens in a text become their ids, as in the library. No rows give no rows. `parts` is the number of buckets of the word
    table, by default one per 64 MB of text, and no fewer than shuffle partitions.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    if parts is None:
        volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-volume // BUCKET))
    words = rows.mapInArrow(_send(tokenizer, parts, size), WORDS)
    ids = words.groupBy("bucket").applyInArrow(_encode(tokenizer), IDS)
    texts = rows.mapInArrow(_texts(size), TEXTS)
    return texts.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_join(tokenizer, parts, key), f"`{key}` long, ids array<int>")


@lru_cache(maxsize=1)
def pieces(path: str) -> np.ndarray:
    """The bytes of each id's piece, and none after the last id: a byte-level vocabulary writes a byte as one character, printable ones as themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown}
    letters |= {chr(0x100 + n): b for n, b in enumerate(b for b in range(256) if b not in set(shown))}
    vocabulary = encoder(path).tokenizer.get_vocab(with_added_tokens=True)
    out = np.full(max(vocabulary.values()) + 2, b"", object)
    for token, i in vocabulary.items():
        out[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return out


def decoded(rows: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, text): the pieces of each row's ids put together, special tokens too.

    The piece table has one row per id of the vocabulary and is joined inside the tasks. Unknown ids have no piece, as in the library; bytes
    that are no UTF-8 become replacement characters; null ids give a null text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(tokenizer)
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            joined = lambda ids: b"".join(table[np.where((ids >= 0) & (ids < len(table)), ids, len(table) - 1)].tolist())
            upto = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            texts = [joined(flat[a:b]).decode("utf-8", "replace") if known else None for a, b, known in zip(upto[:-1], upto[1:], column.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[key, ids, "text"])
        released()

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(f"`{key}`"), F.col(f"`{ids}`")).mapInArrow(run, f"`{key}` {kind}, `{ids}` array<int>, text string")


def round_trip(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): hashes of the comma-joined ids and of the text decoded from them."""
    both = decoded(encoded(docs, tokenizer, key, text), tokenizer, key)
    return both.select(
        F.col(f"`{key}`"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
