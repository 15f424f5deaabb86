"""Removal of repeated substrings by prefix-free parsing.

Rolling-hash triggers cut texts into phrases, each followed by the bytes its last windows reach into. Equal phrases are
one dictionary entry with the first document that has it: later occurrences are removed whole, so copies cost a few
bytes a phrase. What is left, the dictionary, is put in order only where its phrases can share a window: windows are
grouped by the least rolling hash inside them, groups of one document drop out, and the others' windows are ordered by
content, each with the first document among the dictionary's phrases.

Blocks of texts keep their place in a bucketed table. Each step sends a block's distinct hashes to hash parts as packed
arrays and joins the parts' answers back to the block, without moving texts again.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinew.llm.backoff import _bounds, packed, unpacked
from sinew.llm.frames import released, scratch
from sinew.llm.text import PIECE as CACHED
from sinew.llm.text import Hasher, Texts, mixed, owners

WIDTH = 50
TRIGGER = 16  # bytes that decide on a phrase boundary
SPACING = 128  # mean bytes of a phrase
GRAM = 24  # bytes of the hashes that group windows
BLOCK_BYTES = 4 << 20
PART_BYTES = 12 << 20  # of text for each hash part, at most
GROUP = 1 << 20  # keys that are put in order together, by a block or a hash part
SENT_BYTES = 4 << 20  # of packed keys or answers that leave a worker together
_A, _B, _T, _G = Hasher(51), Hasher(52), Hasher(53), Hasher(54)
_LAST = (1 << 63) - 1

BLOCKS = "block long, keys array<long>, sizes array<long>, data binary"


class Block:
    """The texts of a block with their keys, and what its hashes and windows are computed from."""

    def __init__(self, keys: list[int | None], sizes: list[int], data: bytes, width: int):
        self.keys, self.width = keys, width
        self.data = np.frombuffer(data, np.uint8)
        self.at = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
        self.order = np.array([_LAST if k is None else k for k in keys], np.int64)
        self.owner = owners(self.at, np.int32)

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends of window starts, and texts of phrases that have windows."""
        cut, before = np.zeros(len(self.data), bool), np.zeros(1, np.uint64)
        for a in range(0, len(self.data), CACHED):
            # Rolling hashes in pieces that overlap; the block's last bytes start none and count as hash 0.
            h = _T.windows(self.data[a : a + CACHED + TRIGGER - 1], TRIGGER)[:CACHED]
            h = np.concatenate([h, np.zeros(min(CACHED, len(self.data) - a) - len(h), np.uint64)])
            cut[a : a + len(h)] = (h % np.uint64(SPACING) == 0) & (h != np.concatenate([before, h[:-1]]))
            before = h[-1:]
        cut[self.at[:-1][np.diff(self.at) > 0]] = True
        begin = np.flatnonzero(cut)
        text = self.owner[begin]
        finish = np.minimum(np.append(begin[1:], len(self.data)), self.at[text + 1])
        finish = np.minimum(finish, self.at[text + 1] - self.width + 1)
        some = finish > begin
        return begin[some], finish[some], text[some]

    def phrase_keys(self, begin: np.ndarray, finish: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of hash of each phrase with the bytes its windows reach into."""
        return self._keys(begin, finish + self.width - 1)

    def _keys(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _A.ranges(self.data, begin, end), _B.ranges(self.data, begin, end) >> np.uint64(32)

    def groups(self, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of window starts that are `open_`, in one text and with one least rolling hash inside their windows: begins, ends, hashes.

        A run ends with a piece at the latest, so that nothing but runs is kept of a piece. Least hashes are small numbers, so they
        are mixed once more: hash parts get equal shares.
        """
        reach, runs = self.width - GRAM + 1, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for a in range(0, len(self.data), CACHED):
            low, span = _G.windows(self.data[a : a + CACHED + self.width - 1], GRAM), 1
            while span * 2 <= reach:
                low, span = np.minimum(low[:-span], low[span:]), span * 2
            if reach > span:
                low = np.minimum(low[: span - reach], low[reach - span :])
            place = np.flatnonzero(open_[a : a + CACHED])
            if len(place):
                value, text = low[place], self.owner[a + place]
                new = np.concatenate([[True], (np.diff(place) != 1) | (value[1:] != value[:-1]) | (text[1:] != text[:-1])])
                head = np.flatnonzero(new)
                runs.append((a + place[head], a + place[np.append(head[1:], len(place)) - 1] + 1, mixed(value[head])))
        return tuple(map(np.concatenate, zip(*runs, strict=True)))

    def window_keys(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of hash of the windows at some places."""
        return self._keys(place, place + self.width)


def first_of(key: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """For each key with its second half in rest[:, 0]: the least order (rest[:, 1]) among equal keys."""
    by = np.lexsort((rest[:, 0], key))
    k, r = key[by], rest[by]
    head = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:, 0] != r[:-1, 0])]))
    least = np.minimum.reduceat(r[:, 1].view(np.int64), head)
    out = np.empty(len(key), np.int64)
    out[by] = np.repeat(least, np.diff(np.append(head, len(key))))
    return out


def in_several(key: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """For each key: whether its numbers of documents (rest[:, 0]) add up to two or more."""
    _, which = np.unique(key, return_inverse=True)
    return (np.bincount(which, weights=rest[:, 0]) >= 2)[which].astype(np.int64)


def _sorted(key: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of ascending (key, half), and where new ones begin in it."""
    by = np.lexsort((half, key)).astype(np.int32)
    fresh = np.ones(len(by), bool)
    for a in range(1, len(by), CACHED):
        now, last = by[a : a + CACHED], by[a - 1 : a + CACHED - 1][: len(by[a : a + CACHED])]
        fresh[a : a + len(now)] = (key[now] != key[last]) | (half[now] != half[last])
    return by, fresh


def places(key: np.ndarray, half: np.ndarray) -> np.ndarray:
    """The place of every (key, half) among the distinct ones in ascending order."""
    by, fresh = _sorted(key, half)
    which = np.empty(len(by), np.int32)
    which[by] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    return which


def distinct(key: np.ndarray, half: np.ndarray, order: np.ndarray, *, which: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Ascending distinct (key, half) with the least order of each, as a block sends them, and the place of every given one if asked for."""
    by, fresh = _sorted(key, half)
    head = np.flatnonzero(fresh)
    rest = np.empty((len(head), 2), np.uint64)
    rest[:, 0] = half[by[head]]
    rest[:, 1] = (np.minimum.reduceat(order[by], head) if len(by) else order).view(np.uint64)
    place = None
    if which:
        place = np.empty(len(by), np.int32)
        place[by] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    return key[by[head]], rest, place


class Step:
    """What a block does at each step: the keys it asks about, and a note for later steps. `answers` are those to earlier steps' keys.

    Windows are taken in sections of GROUP, and their keys ascend within a section.
    """

    @staticmethod
    def phrases(block: Block, notes: list, answers: list) -> tuple:
        begin, finish, text = block.phrases()
        keys, rest, which = distinct(*block.phrase_keys(begin, finish), block.order[text])
        return keys, rest, (begin.astype(np.int32), finish.astype(np.int32), which)

    @staticmethod
    def _open(block: Block, note: tuple, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of window starts in phrases that no earlier document has, as `Block.groups` gives them."""
        return block.groups(_covered(len(block.data), note[0][~gone], note[1][~gone]))

    @staticmethod
    def groups(block: Block, notes: list, answers: list) -> tuple:
        begin, _, which = notes[0]
        gone = answers[0][which] < block.order[block.owner[begin]]
        start, _, value = Step._open(block, notes[0], gone)
        own = block.owner[start]
        by = np.argsort(value)
        value, own = value[by], own[by]
        head = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else by
        several = np.minimum.reduceat(own, head) < np.maximum.reduceat(own, head) if len(value) else head
        return value[head], (several.astype(np.uint64) + np.uint64(1))[:, None], (gone,)

    @staticmethod
    def windows(block: Block, notes: list, answers: list) -> tuple:
        start, stop, value = Step._open(block, notes[0], notes[1][0])
        keys = np.unique(value)
        shared = answers[1][np.searchsorted(keys, value)].astype(bool) if len(keys) else np.zeros(0, bool)
        start, stop = start[shared], stop[shared]
        joins = start[1:] == stop[:-1]  # runs that touch are one in the note
        start, stop = start[np.append(True, ~joins)] if len(start) else start, stop[np.append(~joins, True)] if len(stop) else stop
        note = start.astype(np.int32), (stop - start).astype(np.int32)
        chosen = Step._places(*note)
        if len(chosen) <= GROUP:
            keys, rest, _ = distinct(*block.window_keys(chosen), block.order[block.owner[chosen]], which=False)
            return keys, rest, note
        keys, rest, n = np.empty(len(chosen), np.uint64), np.empty((len(chosen), 2), np.uint64), 0
        for own in Step._sections(chosen):
            k, r, _ = distinct(*block.window_keys(own), block.order[block.owner[own]], which=False)
            keys[n : n + len(k)], rest[n : n + len(k)] = k, r
            n += len(k)
        return keys[:n], rest[:n], note

    @staticmethod
    def _sections(chosen: np.ndarray) -> list[np.ndarray]:
        return [chosen[a : a + GROUP] for a in range(0, len(chosen), GROUP)]

    @staticmethod
    def _places(head: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The window starts of runs."""
        places = np.repeat((head - np.cumsum(count) + count).astype(np.int32), count)
        places += np.arange(len(places), dtype=np.int32)
        return places

    @staticmethod
    def removed(block: Block, notes: list, answers: list) -> np.ndarray:
        """Which bytes an earlier document's windows cover."""
        (begin, finish, _), (gone,), (head, count) = notes
        late, n = [np.zeros(0, np.int32)], 0
        for own in Step._sections(Step._places(head, count)):
            which = places(*block.window_keys(own))
            late.append(own[answers[2][n : n + int(which.max()) + 1][which] < block.order[block.owner[own]]])
            n += int(which.max()) + 1
        late, w = np.concatenate(late), block.width
        return _covered(len(block.data), begin[gone], finish[gone] + w - 1) | _covered(len(block.data), late, late + w)


def _covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge, out=edge)[:n] > 0


def blocks_of(docs: DataFrame, key: str, text: str, block_bytes: int, parts: int) -> DataFrame:
    """Texts in blocks, as a table bucketed by block: answers come to the blocks, texts stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, data, seq = [], [], [], TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = Texts.of(batch.column(1))
            for a, b in texts.blocks(block_bytes):
                part = texts.part(a, b)
                keys += batch.column(0).slice(a, b - a).to_pylist()
                sizes += np.diff(part.offsets).tolist()
                data.append(part.data.tobytes())
                if sum(map(len, data)) >= block_bytes:
                    yield pa.RecordBatch.from_pylist([{"block": seq, "keys": keys, "sizes": sizes, "data": b"".join(data)}], schema)
                    keys, sizes, data, seq = [], [], [], seq + 1
        if keys:
            yield pa.RecordBatch.from_pylist([{"block": seq, "keys": keys, "sizes": sizes, "data": b"".join(data)}], schema)

    schema = pa.schema([("block", pa.int64()), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])
    spark = docs.sparkSession
    table = f"sinew_blocks_{uuid.uuid4().hex}"
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, BLOCKS)
    rows.write.bucketBy(parts, "block").option("path", scratch(spark, "blocks")).option("compression", "zstd").option("parquet.page.size.row.check.min", 1).option("parquet.page.size.row.check.max", 1).saveAsTable(table)
    return spark.table(table)


_SENT = pa.schema([("part", pa.int64()), ("section", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("rest", pa.binary())])
_REPLY = pa.schema([("part", pa.int64()), ("section", pa.int32()), ("block", pa.int64()), ("answer", pa.binary())])


def _planes(rows: np.ndarray) -> bytes:
    """64-bit columns compressed byte plane by byte plane: bytes that are all zero cost nothing."""
    rows = np.ascontiguousarray(rows)
    return zlib.compress(rows.view(np.uint8).reshape(len(rows), -1).T.tobytes(), 1)


def _rows(raw: bytes, n: int, kind: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(-1, n).T).view(kind) if n else np.zeros((0, 1), kind)


def _answer(found: np.ndarray) -> bytes:
    """Answers to some of a row's keys; those to all of them are such pieces in a row."""
    raw = _planes(found[:, None])
    return len(found).to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw


def _answers(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        n, size = (int.from_bytes(raw[a : a + 4], "little") for a in (at, at + 4))
        out.append(_rows(raw[at + 8 : at + 8 + size], n, np.int64).ravel())
        at += 8 + size
    return out


def _noted(arrays: tuple) -> bytes:
    return zlib.compress(pickle.dumps(arrays, protocol=5), 1)


def _opened(row: dict, width: int) -> tuple[Block, list, list]:
    """A block with the notes and answers of the steps so far."""
    notes, answers = [], []
    for got in (row[c] for c in sorted(c for c in row if c.startswith("answers"))):
        ordered = sorted(got, key=lambda a: (a["section"], a["part"]))
        notes.append(pickle.loads(zlib.decompress(ordered[0]["answer"])))  # this library's own arrays
        answers.append(np.concatenate([np.zeros(0, np.int64), *(x for a in ordered[1:] for x in _answers(a["answer"]))]))
    return Block(row["keys"], row["sizes"], row["data"], width), notes, answers


def answered(blocks: DataFrame, ask: Callable, answer: Callable, number: int, width: int, parts: int) -> DataFrame:
    """(block, answers): each block's keys go to hash parts, and each part answers all keys that came together.

    A block's note takes the same way under a part number of its own, below zero. A part puts GROUP keys in order at a time: those
    of one range of hashes after another, so that only packed keys and answers are held of a part as a whole.
    """
    edges = [int(x) for x in _bounds(parts)[:-1]] + [1 << 64]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                keys, rest, note = ask(*_opened(row, width))
                block, held, size = row["block"], [], 0
                del row
                yield pa.RecordBatch.from_pylist([{"part": -1 - block, "section": -1, "block": block, "keys": _noted(note), "rest": b""}], _SENT)
                del note
                starts = np.concatenate([[0], np.flatnonzero(keys[1:] < keys[:-1]) + 1, [len(keys)]]).tolist()
                for section, (start, stop) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                    cuts = (start + np.searchsorted(keys[start:stop], _bounds(parts))).tolist()
                    cuts[-1] = stop
                    for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        if b > a:
                            held.append({"part": p, "section": section, "block": block, "keys": packed(keys[a:b] - np.uint64(edges[p])), "rest": _planes(rest[a:b])})
                            size += len(held[-1]["keys"]) + len(held[-1]["rest"])
                        if size > SENT_BYTES:
                            yield pa.RecordBatch.from_pylist(held, _SENT)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, _SENT)
                del keys, rest, held
                released()

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        p = rows[0]["part"]
        if p < 0:
            yield pa.RecordBatch.from_pylist([{**r, "answer": r["keys"]} for r in rows], _REPLY)
            return
        total = sum((len(r["keys"]) - 1) // r["keys"][0] for r in rows)
        pieces = -(-total // GROUP)
        ends = [(edges[p + 1] - edges[p]) * j // pieces for j in range(1, pieces)]
        ends, found = np.array(ends, np.uint64), [[] for _ in rows]
        for j in range(pieces):
            keys, rest = [], []
            for r in rows:
                k = unpacked(r["keys"])
                a, b = ([0, *np.searchsorted(k, ends).tolist(), len(k)][j : j + 2])
                keys.append(k[a:b].copy())
                rest.append(_rows(r["rest"], len(k), np.uint64)[a:b].copy())
            cuts = np.cumsum([len(k) for k in keys])[:-1]
            keys, rest = np.concatenate(keys), np.concatenate(rest)
            for own, x in zip(found, np.split(answer(keys, rest), cuts) if len(keys) else (), strict=False):
                if len(x):
                    own.append(_answer(x))
            del keys, rest
            released()
        held, size = [], 0
        for r, own in zip(rows, found, strict=True):
            held.append({"part": p, "section": r["section"], "block": r["block"], "answer": b"".join(own)})
            size += len(held[-1]["answer"])
            if size > SENT_BYTES:
                yield pa.RecordBatch.from_pylist(held, _REPLY)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _REPLY)

    sent = blocks.mapInArrow(send, "part long, section int, block long, keys binary, rest binary")
    replies = sent.groupBy("part").applyInArrow(reply, "part long, section int, block long, answer binary")
    return replies.groupBy("block").agg(F.collect_list(F.struct("section", "part", "answer")).alias(f"answers{number}"))


def marked(docs: DataFrame, key: str, text: str, kernel: Callable[[Block, np.ndarray], pa.RecordBatch], schema: str, *, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, parts: int | None = None) -> DataFrame:
    """`kernel(block, removed)` of every block of texts."""
    if not parts:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    rows = blocks_of(docs, key, text, block_bytes, parts)
    for number, (ask, answer) in enumerate(((Step.phrases, first_of), (Step.groups, in_several), (Step.windows, first_of))):
        table = scratch(docs.sparkSession, f"answers{number}")
        answered(rows, ask, answer, number, width, parts).write.parquet(table)
        replies = docs.sparkSession.read.parquet(table)
        rows = rows.join(replies.hint("shuffle_hash"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                block, notes, answers = _opened(batch.slice(i, 1).to_pylist()[0], width)
                yield kernel(block, Step.removed(block, notes, answers))
                del block, notes, answers
                released()

    return rows.mapInArrow(run, schema)


def spans_of(block: Block, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of maximal removed runs."""
    n = len(removed)
    edge = np.zeros(n + 1, bool)
    edge[block.at] = True
    before, after = np.concatenate([[False], removed[:-1]]), np.concatenate([removed[1:], [False]])
    begin = np.flatnonzero(removed & (~before | edge[:n]))
    end = np.flatnonzero(removed & (~after | edge[1:])) + 1
    return begin, end, block.owner[begin]


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row; spans are byte ranges of the text.

    A byte goes if a string of `width` bytes around it also starts in a text of a smaller key. Null texts are empty. Null
    keys count as larger than all others; rows of equal keys do not remove each other's bytes. Other columns are not read.
    """
    schema = f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"

    def kernel(block: Block, removed: np.ndarray) -> pa.RecordBatch:
        begin, end, text_ = spans_of(block, removed)
        kept = block.data[~removed]
        gone = np.concatenate([[0], np.cumsum(removed)])[block.at]
        at = (block.at - gone).tolist()
        raw = memoryview(kept.tobytes())
        digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
        spans = pa.StructArray.from_arrays([pa.array(begin - block.at[text_]), pa.array(end - block.at[text_])], names=["start", "end"])
        first = pa.array(np.searchsorted(text_, np.arange(len(block.keys) + 1)), pa.int32())
        counts = np.diff(np.searchsorted(text_, np.arange(len(block.keys) + 1)))
        return pa.RecordBatch.from_arrays(
            [pa.array(block.keys, pa.int64()), pa.array(np.diff(block.at)), pa.array(np.diff(gone)), pa.array(counts.astype(np.int64)), pa.array(digests, pa.string()), pa.ListArray.from_arrays(first, spans)],
            names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )

    return marked(docs, key, text, kernel, schema, **options)
