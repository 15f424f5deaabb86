"""Benchmark decontamination: benchmark word windows are searched in an FM-index of every training shard.

A shard is a block of texts inside a task. Its words are mapped to the numbers of the benchmark's words, all
other words and the ends of texts to the separator, so phrases never cross texts. Windows are found by backward
search, their places located by sampled suffix positions, and hit words merged into spans.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sinew.llm.fmindex import FmIndex
from sinew.llm.frames import field, map_texts
from sinew.llm.text import PLAIN_WORD, Hasher, Texts, owners

WIDTH = 10
SHARD_BYTES = 3 << 20
ITEM_BYTES = 2 << 20  # benchmark text that is searched in one pass over the documents
LOCATED = 1 << 20  # suffixes located at once
_HASH = Hasher(4)

SPAN = T.StructType([field("first_word", T.LongType()), field("last_word", T.LongType()), field("start", T.LongType()), field("end", T.LongType())])
_FIELDS = [field("n_words", T.LongType()), field("spans", T.ArrayType(SPAN)), field("items", T.ArrayType(T.StringType()))]


class Phrases:
    """Windows of a block of benchmark items, as numbers of their words."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int = WIDTH):
        texts = Texts.of(pa.array([t for _, t in items], pa.string())).lowered()
        starts, ends, first = texts.words(PLAIN_WORD)
        self.words, number = np.unique(_HASH.ranges(texts.data, starts, ends), return_inverse=True)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.words >> np.uint64(44)] = True
        number = (number + 1).astype(np.int32)
        names = sorted({str(i) for i, _ in items if i is not None})
        place = {name: k for k, name in enumerate(names)}
        self.names = np.array(names, object)
        by_size: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for (item, _), a, b in zip(items, first[:-1], first[1:], strict=True):
            if b > a:
                size = int(min(width, b - a))
                rows = np.lib.stride_tricks.sliding_window_view(number[a:b], size)
                by_size.setdefault(size, []).append((rows, np.full(len(rows), -1 if item is None else place[str(item)])))
        #: For each window length: distinct windows, and the items of each as offsets and numbers.
        self.windows = []
        for _size, parts in sorted(by_size.items()):
            rows, which = np.unique(np.concatenate([r for r, _ in parts]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.concatenate([i for _, i in parts])], axis=1), axis=0)
            pairs = pairs[pairs[:, 1] >= 0]
            self.windows.append((rows, np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1)), pairs[:, 1]))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The benchmark's numbers of words, 0 for words it does not have."""
        out = np.zeros(len(hashes), np.int32)
        if len(self.words):
            some = np.flatnonzero(self.maybe[hashes >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.words, hashes[some]), len(self.words) - 1)
            out[some] = np.where(self.words[at] == hashes[some], at + 1, 0)
        return out


def found_in(shard: Texts, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and each text's first word; which words are hit; and (text, item) pairs, ordered."""
    low = shard.lowered()
    starts, ends, first = low.words(PLAIN_WORD)
    number = phrases.numbers(_HASH.ranges(low.data, starts, ends))
    owner = owners(first)
    # A separator after every text; word k of text d stands at k + d.
    symbols = np.zeros(len(number) + len(shard), np.int32)
    symbols[np.arange(len(number)) + owner] = number
    depth = np.zeros(len(number) + 1, np.int32)
    pairs = [np.zeros((0, 2), np.int64)]
    if phrases.windows and number.any():
        index = FmIndex(symbols, len(phrases.words) + 1)
        for rows, at, items in phrases.windows:
            lo, hi = index.search(rows)
            seen = np.flatnonzero(hi > lo)
            many = (hi - lo)[seen]
            total = np.concatenate([[0], np.cumsum(many)])
            for a in range(0, int(total[-1]), LOCATED):
                k = np.arange(a, min(a + LOCATED, int(total[-1])))
                which = np.searchsorted(total, k, "right") - 1
                place = index.locate(lo[seen[which]] + k - total[which])
                text = np.searchsorted(first[:-1] + np.arange(len(shard)), place, "right") - 1
                word = place - text
                np.add.at(depth, word, 1)
                np.add.at(depth, word + rows.shape[1], -1)
                hit = np.unique(np.stack([text, seen[which]], axis=1), axis=0)
                count = at[hit[:, 1] + 1] - at[hit[:, 1]]
                flat = np.repeat(at[hit[:, 1]] - np.cumsum(count) + count, count) + np.arange(count.sum())
                pairs.append(np.unique(np.stack([np.repeat(hit[:, 0], count), items[flat]], axis=1), axis=0))
    pairs_ = np.unique(np.concatenate(pairs), axis=0)
    return starts, ends, first, np.cumsum(depth)[:-1] > 0, pairs_[:, 0], pairs_[:, 1]


def _kernel(phrases: Phrases):
    def run(shard: Texts, rows: pa.RecordBatch) -> list:
        starts, ends, first, hit, text, item = found_in(shard, phrases)
        earlier = rows.schema.get_field_index("spans")
        names = [phrases.names[item[a:b]].tolist() for a, b in _cuts(text, len(shard))]
        if earlier >= 0:  # passes over further blocks of a large benchmark
            for d, spans in enumerate(rows.column(earlier).to_pylist()):
                for span in spans:
                    hit[first[d] + span["first_word"] : first[d] + span["last_word"] + 1] = True
            names = [sorted({*a, *b}) for a, b in zip(names, rows.column(rows.schema.get_field_index("items")).to_pylist(), strict=True)]
        # Spans: maximal runs of hit words inside a text.
        edge = np.zeros(len(hit) + 1, bool)
        edge[first] = True
        begin = np.flatnonzero(hit & (np.concatenate([[True], ~hit[:-1]]) | edge[:-1]))
        finish = np.flatnonzero(hit & (np.concatenate([~hit[1:], [True]]) | edge[1:])) if len(hit) else begin
        own = np.searchsorted(first, begin, "right") - 1
        base = shard.offsets[own]
        flat = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (begin - first[own], finish - first[own], starts[begin] - base, ends[finish] - base)], names=[f.name for f in SPAN])
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(shard) + 1)), pa.int32()), flat)
        return [np.diff(first), spans, pa.array(names, pa.list_(pa.string()))]

    return run


def _cuts(sorted_owner: np.ndarray, n: int) -> list[tuple[int, int]]:
    at = np.searchsorted(sorted_owner, np.arange(n + 1)).tolist()
    return list(zip(at[:-1], at[1:], strict=True))


def item_blocks(benchmark: DataFrame, item: str, text: str, item_bytes: int) -> list[list[tuple]]:
    """The benchmark in blocks of about `item_bytes` of text, each small enough for every task to hold."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, ceil(size / item_bytes))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    return [[(r["item"], r["text"]) for r in rows.where(part == k).collect()] for k in range(blocks)]


def searched(docs: DataFrame, benchmark: DataFrame, text: str, *, item: str = "item_id", item_text: str = "text", keep: list[str], width: int = WIDTH, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Columns `keep` with n_words, the merged hit spans (words and bytes of the text) and the ids of items found."""
    out, see = docs, ()
    for block in item_blocks(benchmark, item, item_text, item_bytes):
        out = map_texts(out, text, _kernel(Phrases(block, width)), _FIELDS, keep=list(dict.fromkeys([*keep, text])), see=see, block=SHARD_BYTES)
        see = ("spans", "items")
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", *, item: str = "item_id", item_text: str = "text", width: int = WIDTH, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated, spans, items) for every row.

    Windows are `width` consecutive words of an item, or all words of a shorter one; a null or wordless item has
    none. Null texts have no words. An item without id hits words but is not listed. Repeated rows are reported
    each; other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = searched(rows, benchmark, "text", item=item, item_text=item_text, keep=["key"], width=width, item_bytes=item_bytes)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last_word"] - s["first_word"] + 1)
    return found.select(
        F.col("key").alias(key), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans", "items",
    )


def without_spans(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts with their byte spans replaced by a line break each."""
    out = texts.to_pylist()
    for i, own in enumerate(spans.to_pylist()):
        if own:
            raw, kept, at = out[i].encode(), [], 0
            for s in own:
                kept.append(raw[at : s["start"]])
                at = s["end"]
            out[i] = b"\n".join([*kept, raw[at:]]).decode()
    return pa.array(out, pa.string())


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", length: str | None = "n_chars", **options) -> DataFrame:
    """All rows with hit spans cut out of their texts (a line break stays), and `length` set to the new number of characters.

    Rows without hits are unchanged, nulls included.
    """
    rows = docs.select(F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"), F.col(text).alias("text"))
    found = searched(rows, benchmark, "text", keep=["row", "text"], **options)
    cut = map_texts(found, "text", lambda _, b: [without_spans(b.column(1), b.column(2))], [field("cut", T.StringType())], keep=["row", "text", "spans"])
    touched = F.size("spans") > 0
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.when(touched, F.col("cut")).otherwise(F.col("text")).alias(c))
        elif c == length:
            columns.append(F.when(touched, F.length("cut").cast(docs.schema[c].dataType)).otherwise(F.col(f"row.`{c}`")).alias(c))
        else:
            columns.append(F.col("row").getField(c).alias(c))
    return cut.select(columns)
