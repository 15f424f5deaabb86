"""Language-model scores by stupid backoff, from n-gram counts of the whole corpus.

The relations are packed, so that an n-gram costs a few bytes and not a row: `blocks` has the word numbers of a block
of texts, and every block sends its distinct n-grams, by hash part, to the count tables. Each part adds up the
counts of its n-grams over all blocks and joins them back to the blocks that sent them, where they are looked up for
every word and summed by document. Only what one block or one hash part holds is ever in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinew.llm.frames import stored
from sinew.llm.text import PLAIN_WORD, Hasher, Texts, mixed, owners

ALPHA = 0.4
LEAST = 2  # bigrams seen less often count as unseen
BLOCK_BYTES = 4 << 20
_HASH = Hasher(6)

BLOCKS = "block long, keys array<long>, words array<int>, number binary, vocabulary binary"


def packed(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences of as few bytes as the largest needs."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    width = raw[0]
    body = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    steps = np.zeros((len(body), 8), np.uint8)
    steps[:, :width] = body
    return np.cumsum(steps.reshape(-1).view(np.uint64), dtype=np.uint64)


def _small(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<u4").tobytes(), 1)


def _large(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64)


def blocks_of(docs: DataFrame, key: str, text: str, block_bytes: int) -> DataFrame:
    """One row for each block of texts: keys, numbers of words, and every word's number in the block's vocabulary of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seq = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = Texts.of(batch.column(1)).lowered()
            for a, b in texts.blocks(block_bytes):
                part = texts.part(a, b)
                starts, ends, first = part.words(PLAIN_WORD)
                held.append((batch.column(0).slice(a, b - a), np.diff(first), _HASH.ranges(part.data, starts, ends)))
                size += len(part.data)
                if size >= block_bytes:
                    yield _block(seq, held)
                    held, size, seq = [], 0, seq + 1
        if held:
            yield _block(seq, held)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, BLOCKS)


def _block(block: int, held: list) -> pa.RecordBatch:
    vocabulary, number = np.unique(np.concatenate([h for _, _, h in held]), return_inverse=True)
    keys = pa.concat_arrays([k for k, _, _ in held])
    words = np.concatenate([w for _, w, _ in held]).astype(np.int32)
    columns = [pa.array([block]), pa.array([keys.to_pylist()], pa.list_(pa.int64())), pa.array([words], pa.list_(pa.int32())), pa.array([_small(number)], pa.binary()), pa.array([packed(vocabulary)], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BLOCKS.split(", ")])


def bigrams(number: np.ndarray, vocabulary: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a block's bigrams, and the place of each one's second word."""
    owner = np.repeat(np.arange(len(words)), words)
    at = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    return mixed(vocabulary[number[at - 1]] * np.uint64(0xD6E8FEB86659FD93) + vocabulary[number[at]]), at


_SENT = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("size", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def sent(blocks: DataFrame, parts: int) -> DataFrame:
    """(part, block, size, keys, counts): each block's distinct n-grams of one and two words by hash part, with its own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, number, vocabulary in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "number", "vocabulary")), strict=True):
                number, vocabulary = _large(number), unpacked(vocabulary)
                pairs, _ = bigrams(number, vocabulary, np.array(words, np.int64))
                distinct, count = np.unique(pairs, return_counts=True)
                rows = []
                for size, keys, many in ((1, vocabulary, np.bincount(number, minlength=len(vocabulary))), (2, distinct, count)):
                    cuts = np.searchsorted(keys, _bounds(parts)).tolist()
                    rows += [(p, block, size, packed(keys[a:b]), _small(many[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_pylist([dict(zip(_SENT.names, r, strict=True)) for r in rows], _SENT)

    return blocks.select("block", "words", "number", "vocabulary").mapInArrow(run, "part int, block long, size int, keys binary, counts binary")


def _bounds(parts: int) -> np.ndarray:
    """Where hash parts begin: equal ranges of 64-bit hashes; the last bound leaves nothing out."""
    inner = np.array([(k << 64) // parts for k in range(parts)], np.uint64)
    return np.concatenate([inner, [np.uint64((1 << 64) - 1)]])


def counted(ngrams: DataFrame) -> DataFrame:
    """(part, block, size, counts) with the whole corpus's counts, in the order of the keys that came; parts are tables of their own."""

    def run(table: pa.Table) -> pa.Table:
        size = table["size"].to_numpy()
        out = [b""] * len(table)
        for s in np.unique(size):
            rows = np.flatnonzero(size == s).tolist()
            keys = [unpacked(table["keys"][i].as_py()) for i in rows]
            own = [_large(table["counts"][i].as_py()) for i in rows]
            _, which = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(which, weights=np.concatenate(own)).astype(np.int64)
            at = 0
            for i, k in zip(rows, keys, strict=True):
                out[i] = _small(np.minimum(total[which[at : at + len(k)]], (1 << 32) - 1))
                at += len(k)
        return pa.table({"part": table["part"], "block": table["block"], "size": table["size"], "counts": pa.array(out, pa.binary())})

    return ngrams.groupBy("part").applyInArrow(run, "part int, block long, size int, counts binary")


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", *, alpha: float = ALPHA, least: int = LEAST, block_bytes: int = BLOCK_BYTES, parts: int | None = None) -> DataFrame:
    """(key, n_words, n_seen, score) for every row: the mean natural logarithm of stupid backoff over the words.

    A word after another one scores count(both) / count(first) if both stand together `least` times or more in the corpus
    (n_seen counts these), else alpha * count(word) / all words; a text's first word scores count(word) / all words. Words
    are lower-cased runs of ASCII letters, digits and other characters. A text without words, null included, has score
    null. Repeated rows count each time; other columns are not read.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = stored(blocks_of(docs, key, text, block_bytes), "blocks")
    counts = counted(sent(blocks, parts)).groupBy("block").agg(F.collect_list(F.struct("size", "part", "counts")).alias("counts"))
    total = blocks.select(F.sum(F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + w))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, number, vocabulary = np.array(row["words"], np.int64), _large(row["number"]), unpacked(row["vocabulary"])
                got = {s: [_large(c["counts"]) for c in sorted((c for c in row["counts"] or [] if c["size"] == s), key=lambda c: c["part"])] for s in (1, 2)}
                one, two = (np.concatenate([np.zeros(0, np.int64), *got[s]]) for s in (1, 2))
                pairs, at = bigrams(number, vocabulary, words)
                _, which = np.unique(pairs, return_inverse=True)
                value = np.log(one[number] / max(total, 1)) if len(number) else np.zeros(0)
                both = two[which] if len(which) else np.zeros(0, np.int64)
                seen = both >= least
                value[at] = np.where(seen, np.log(np.maximum(both, 1) / one[number[at - 1]]), np.log(alpha) + value[at])
                found = np.zeros(len(number), bool)
                found[at] = seen
                owner = owners(np.concatenate([[0], np.cumsum(words)]))
                sums, hits = np.bincount(owner, weights=value, minlength=len(words)), np.bincount(owner, weights=found, minlength=len(words)).astype(np.int64)
                mean = [s / w if w else None for s, w in zip(sums.tolist(), words.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["keys"], pa.int64()), pa.array(words), pa.array(hits), pa.array(mean, pa.float64())], names=[key, "n_words", "n_seen", "score"])

    return blocks.join(counts, "block", "left").mapInArrow(run, f"`{key}` long, n_words long, n_seen long, score double")


def sql(alpha: float = ALPHA, least: int = LEAST) -> str:
    """The scores of `documents` in DuckDB."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM texts),
one AS (SELECT word, count(*) AS n FROM words GROUP BY word),
pairs AS (SELECT b.r, b.i, a.word AS first, b.word FROM words b LEFT JOIN words a ON a.r = b.r AND a.i = b.i - 1),
two AS (SELECT first, word, count(*) AS n FROM pairs WHERE first IS NOT NULL GROUP BY first, word),
scored AS (
  SELECT p.r, coalesce(two.n, 0) >= {least} AS seen,
         CASE WHEN coalesce(two.n, 0) >= {least} THEN ln(two.n / f.n)
              WHEN p.first IS NOT NULL THEN ln({alpha}) + ln(one.n / (SELECT count(*) FROM words))
              ELSE ln(one.n / (SELECT count(*) FROM words)) END AS v
  FROM pairs p JOIN one ON one.word = p.word LEFT JOIN one f ON f.word = p.first
       LEFT JOIN two ON two.first = p.first AND two.word = p.word)
SELECT doc_id, len(any_value(w)) AS n_words, count(*) FILTER (WHERE seen) AS n_seen, round(avg(v), 6) AS score
FROM texts LEFT JOIN scored USING (r) GROUP BY r, doc_id"""
