"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in NumPy.

A word's vector is the sum of a vector of its hash and one of the hash of its first bytes, which words of one stem
share. Filters of several widths slide over all words of a text; each filter's maximum feeds a logistic output. The
network is fitted on all labelled rows and applied to whole texts, both inside Spark tasks: an epoch is one job, in which every shard
of the rows takes its steps from the same state.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field as dataclass_field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sinew.llm.frames import BLOCK, field, fresh_name, map_texts, released, stored
from sinew.llm.labelled import best_cut_counted, held_out, known_labels, part_of, sigmoid
from sinew.llm.text import PLAIN_WORD, Hasher, Texts
from sinew.session import settle

BUCKETS = 1 << 17
STEM = 5  # bytes
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8  # of each width
SHARD_ROWS = 6000  # labels whose texts one state passes through in an epoch
TASKS = 64  # at most so many tasks of an epoch send their sums
SLICE = 1 << 10  # buckets of a table that travel in one row
PIECE = 1 << 20  # bytes of text that are compressed together
PART_BITS = 1 << 15  # of a row of `bitmap_construct_agg`
MAYBE = 8  # bits, or up to twice as many, that tell a labelled key
MOST_BITS = 1 << 27
BINS = 1 << 12  # of a logit, when cuts are looked for
LEAST = 30  # labelled texts of each label that a language needs for a threshold of its own
_WORD, _STEM = Hasher(31), Hasher(32)


def word_numbers(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each word and of its stem, and each text's first word."""
    low = texts.lowered()
    starts, ends, first = low.words(PLAIN_WORD)
    word = _WORD.ranges(low.data, starts, ends) >> np.uint64(47)
    stem = _STEM.ranges(low.data, starts, np.minimum(ends, starts + STEM)) >> np.uint64(47)
    return word.astype(np.int32), stem.astype(np.int32), first


@dataclass
class Network:
    word: np.ndarray
    stem: np.ndarray
    filters: list[np.ndarray]  # by width: (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    base: float = 0.0
    thresholds: dict[str, float] = dataclass_field(default_factory=dict)

    @classmethod
    def start(cls, word_odds: np.ndarray, stem_odds: np.ndarray, seed: int = 0) -> Network:
        """Vectors start with the label's log odds in their first dimension, and each width has one filter that reads it."""
        rng = np.random.default_rng(seed)
        word, stem = (rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32) for _ in range(2))
        word[:, 0] = word_odds / 4
        stem[:, 0] = stem_odds / 4
        filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for w, f in zip(WIDTHS, filters, strict=True):
            f[:, :, 0] = 0
            f[:, 0, 0] = 1 / w
        out = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32)
        out[::FILTERS] = 1
        return cls(word, stem, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], out, -1.0)

    def _sums(self, x: np.ndarray, k: int) -> np.ndarray:
        """Filter values at every word; words past the end of a text count as zero vectors there (see `pooled`)."""
        f = self.filters[k]
        z = x @ f[0]
        for j in range(1, len(f)):
            z[:-j] += x[j:] @ f[j]
        return z

    def pooled(self, word: np.ndarray, stem: np.ndarray, first: np.ndarray, *, places: bool = False):
        """(texts, filters) maxima over each text's windows, and if wanted the first word of each winning window.

        Texts are set apart by zero vectors, as many as the widest filter reaches over.
        """
        n, gap = len(first) - 1, max(WIDTHS) - 1
        shifted = first + gap * np.arange(n + 1)
        x = np.zeros((len(word) + gap * n, DIM), np.float32)
        at = np.arange(len(word)) + gap * np.repeat(np.arange(n), np.diff(first))
        x[at] = self.word[word] + self.stem[stem]
        best = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        won = np.zeros((n, len(WIDTHS) * FILTERS), np.int64)
        full = np.flatnonzero(np.diff(first) > 0)
        for k in range(len(WIDTHS)):
            if not len(full):
                break
            z = self._sums(x, k) + self.bias[k]
            columns = slice(k * FILTERS, (k + 1) * FILTERS)
            # Windows start at words only: between texts stands nothing that could win.
            spaces = np.ones(len(x), bool)
            spaces[at] = False
            z[spaces] = -np.inf
            starts = shifted[full]
            starts[0] = 0
            top = np.maximum.reduceat(z, starts, axis=0)
            best[full, columns] = top
            if places:
                lengths = np.diff(np.append(starts, len(x)))
                row, column = np.nonzero(z == np.repeat(top, lengths, axis=0))
                text = np.repeat(np.arange(len(full)), lengths)[row]
                key, where = np.unique(text * FILTERS + column, return_index=True)
                won[full[key // FILTERS], k * FILTERS + key % FILTERS] = row[where]
        return (best, won, x, at) if places else best

    def logits(self, word: np.ndarray, stem: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(word, stem, first), 0) @ self.out + self.base

    def step(self, word: np.ndarray, stem: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray, memory: dict, rate: float) -> float:
        """One Adagrad step of the weighted log loss over a batch; only winning windows pass gradients on."""
        best, won, x, at = self.pooled(word, stem, first, places=True)
        hidden = np.maximum(best, 0)
        p = sigmoid(hidden @ self.out + self.base)
        g = ((p - label) * weight / weight.sum()).astype(np.float32)
        back = np.where(best > 0, g[:, None] * self.out, 0).astype(np.float32)
        origin = np.full(len(x) + max(WIDTHS), -1)
        origin[at] = np.arange(len(at))
        padded = np.concatenate([x, np.zeros((max(WIDTHS), DIM), np.float32)])
        moved = np.zeros_like(x, shape=(len(word), DIM))

        def adapt(name: str, value: np.ndarray, grad: np.ndarray) -> None:
            memory[name] = memory.get(name, np.float32(1e-8)) + grad * grad
            value -= (rate * grad / np.sqrt(memory[name])).astype(value.dtype)

        out_grad, filter_grads, bias_grads = hidden.T @ g + 1e-4 * self.out, [], []
        for k, width in enumerate(WIDTHS):
            columns = slice(k * FILTERS, (k + 1) * FILTERS)
            b, place = back[:, columns], won[:, columns]
            grad = np.empty_like(self.filters[k])
            for j in range(width):
                grad[j] = np.einsum("tfd,tf->df", padded[place + j], b)
                source = origin[place + j]
                ok = (source >= 0) & (b != 0)
                _, f = np.nonzero(ok)
                np.add.at(moved, source[ok], b[ok][:, None] * self.filters[k][j].T[f])
            filter_grads.append(grad)
            bias_grads.append(b.sum(axis=0))
        adapt("out", self.out, out_grad)
        memory["base"] = memory.get("base", 1e-8) + float(g.sum()) ** 2
        self.base -= rate * float(g.sum()) / memory["base"] ** 0.5
        for k in range(len(WIDTHS)):
            adapt(f"filter{k}", self.filters[k], filter_grads[k])
            adapt(f"bias{k}", self.bias[k], bias_grads[k])
        used = np.flatnonzero(moved.any(axis=1))
        for name, table, number in (("word", self.word, word), ("stem", self.stem, stem)):
            rows, which = np.unique(number[used], return_inverse=True)
            grad = np.zeros((len(rows), DIM), np.float32)
            np.add.at(grad, which, moved[used])
            seen = memory.setdefault(name, np.full(table.shape, 1e-4, np.float32))
            seen[rows] += grad * grad
            table[rows] -= 0.2 * rate * grad / np.sqrt(seen[rows])
        return float(-(weight * np.log(np.where(label == 1, p, 1 - p) + 1e-9)).sum() / weight.sum())


def label_odds(having: np.ndarray, texts: np.ndarray, prior: float = 2.0) -> np.ndarray:
    """Smoothed log odds of label 1 for texts that have a bucket's words (`having`: texts by label and bucket), against all texts."""
    with_zero, with_one = having
    zeros, ones = np.maximum(1, texts)
    odds = np.log((with_one + prior) / (ones + prior)) - np.log((with_zero + prior) / (zeros + prior))
    # A bucket that nothing was seen in says nothing.
    return np.where(with_one + with_zero > 0, odds, 0.0).astype(np.float32)


def maybe_known(docs: DataFrame, known: DataFrame, count: int) -> DataFrame:
    """The rows of `docs` whose key is among the `count` keys of `known`, and a few others.

    A bit per hash of a key goes to every task, `MAYBE` bits a key but never more than `MOST_BITS`; with more keys than that
    serves, more other rows pass. So texts without a label are not shuffled.
    """
    bits = min(MOST_BITS, max(PART_BITS, 1 << (MAYBE * count).bit_length()))
    place = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(bits))
    part, at = F.floor(place / PART_BITS).cast("long"), place % PART_BITS
    filled = known.groupBy(part.alias("part")).agg(F.bitmap_construct_agg(at).alias("bits"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.floor(byte / F.pow(F.lit(2), F.col("at") % 8)) % 2 == 1
    placed = docs.where(F.col("key").isNotNull()).withColumns({"part": part, "at": at})
    return placed.join(F.broadcast(filled), "part").where(there).drop("part", "at", "bits")


def packed(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(shard, rows): the labelled rows of every shard, ordered, as compressed pieces of some `PIECE` bytes of text.

    Every text with a label is shuffled once, to its shard, and meets its label there.
    """

    def meet(texts: pa.Table, labels: pa.Table) -> pa.Table:
        places = pa.table({"key": texts["key"], "row": pa.array(np.arange(len(texts)))})
        found = places.join(labels.drop_columns("shard"), "key", join_type="inner", use_threads=False)
        label, there = np.zeros(len(texts), np.int32), np.zeros(len(texts), bool)
        label[found["row"].to_numpy()], there[found["row"].to_numpy()] = found["label"].to_numpy(), True
        order = pc.sort_indices(texts, [("key", "ascending"), ("lang", "ascending"), ("text", "ascending")]).to_numpy()
        order = order[there[order]]
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts["text"]), 0).to_numpy()[order], dtype=np.int64)
        cuts_at = np.append(np.flatnonzero(np.diff(ends // PIECE, prepend=0)), len(order))
        pieces = []
        for rows in np.split(order, cuts_at):
            if len(rows):
                piece = texts.drop_columns("shard").take(pa.array(rows)).append_column("label", pa.array(label[rows]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(piece)
                pieces.append(sink.getvalue().to_pybytes())
        shard = texts["shard"][0].as_py() if pieces else 0
        released()
        return pa.table({"shard": pa.array([shard] * len(pieces), pa.int32()), "rows": pa.array(pieces, pa.binary())})

    return known.groupBy("shard").cogroup(docs.groupBy("shard")).applyInArrow(lambda labels, texts: meet(texts, labels), "shard int, rows binary")


def shard_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a task shard by shard; a shard's pieces follow each other."""
    held, current = [], None
    for batch in batches:
        for shard, rows in zip(batch.column("shard").to_pylist(), batch.column("rows"), strict=True):
            if held and shard != current:
                yield pa.concat_tables(held)
                held = []
            current = shard
            held.append(pa.ipc.open_stream(rows.as_buffer()).read_all())
    if held:
        yield pa.concat_tables(held)


def _numbers(table: pa.Table) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Buckets of every text, labels, and which rows calibrate."""
    texts = []
    for chunk in table["text"].chunks:
        whole = Texts.of(chunk)
        for a, b in whole.blocks(BLOCK):
            word, stem, first = word_numbers(whole.part(a, b))
            texts += [(word[x:y], stem[x:y]) for x, y in zip(first[:-1], first[1:], strict=True)]
    return texts, table["label"].to_numpy().astype(np.int64), part_of(table["key"].to_numpy(), 4)


def _joined(texts: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (
        np.concatenate([np.zeros(0, np.int32), *(texts[i][0] for i in rows)]),
        np.concatenate([np.zeros(0, np.int32), *(texts[i][1] for i in rows)]),
        np.concatenate([[0], np.cumsum([len(texts[i][0]) for i in rows], dtype=np.int64)]),
    )


def _summed(rows: DataFrame, by: str) -> Iterator[tuple[int, np.ndarray]]:
    """Rows (`by`, v) with the vectors of equal `by` added up on the cluster; they reach the driver compressed."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(len(table["v"][0]))
        for v in table["v"]:
            total += v.values.to_numpy()
        return pa.table({by: table[by][:1].cast(pa.int32()), "v": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    for slot, v in rows.groupBy(by).applyInArrow(add, f"{by} int, v binary").collect():
        yield slot, np.frombuffer(zlib.decompress(v))


def seen_words(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all texts: texts by (word or stem, label, bucket) and by label, without those that calibrate, and those that calibrate by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        having, count = np.zeros((2, 2, BUCKETS)), np.zeros((2, 2))
        for table in shard_tables(batches):
            texts, label, calibrating = _numbers(table)
            for (word, stem), y, held in zip(texts, label, calibrating, strict=True):
                one = int(y == 1)
                count[int(held), one] += 1
                if not held:
                    having[0, one, np.unique(word)] += 1
                    having[1, one, np.unique(stem)] += 1
        if count.any():
            # A bounded piece of the table a row.
            flat = having.reshape(-1, SLICE)
            yield pa.record_batch({"slot": pa.array(range(-1, len(flat)), pa.int32()), "v": pa.array([count.ravel(), *flat], pa.list_(pa.float64()))})
        released()

    having, count = np.zeros((2, 2, BUCKETS)), np.zeros((2, 2))
    flat = having.reshape(-1, SLICE)
    for slot, v in _summed(rows.mapInArrow(run, "slot int, v array<double>"), "slot"):
        if slot < 0:
            count[:] = v.reshape(2, 2)
        else:
            flat[slot] = v
    return having, count[0], count[1]


def _dense(network: Network) -> list[np.ndarray]:
    return [network.out, *network.filters, *network.bias]


_DENSE = ["out", *(f"filter{k}" for k in range(len(WIDTHS))), *(f"bias{k}" for k in range(len(WIDTHS)))]


def epoch_of(rows: DataFrame, network: Network, memory: dict, epoch: int, share: float, *, batch: int, rate: float, seed: int) -> tuple[Network, dict]:
    """The network after an epoch: every shard takes its steps from the given state, and their states are put together.

    Filters, outputs and their memories are means by rows. A bucket's vector moves by the mean over the shards that moved
    it, and its memory grows by what they all added.
    """
    shared = rows.sparkSession.sparkContext.broadcast((network, memory))
    width = 2 * DIM + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved, dense, trained_rows = np.zeros((2, BUCKETS, width), np.float32), None, 0
        for table in shard_tables(batches):
            start, before = shared.value
            texts, label, calibrating = _numbers(table)
            train = np.flatnonzero(~calibrating)
            if not len(train):
                continue
            own, kept = copy.deepcopy(start), copy.deepcopy(before)
            weight = np.where(label == 1, 0.5 / share, 0.5 / max(1e-3, 1 - share))
            rng = np.random.default_rng(seed)
            for _ in range(epoch + 1):
                order = rng.permutation(train)
            for a in range(0, len(order), batch):
                at = order[a : a + batch]
                own.step(*_joined(texts, at), label[at].astype(np.float32), weight[at].astype(np.float32), kept, rate)
            for t, name in enumerate(("word", "stem")):
                old, new = getattr(start, name), getattr(own, name)
                grown = kept[name] - (before[name] if name in before else np.float32(1e-4))
                change = new - old
                moved[t, :, :DIM] += change
                moved[t, :, DIM:-1] += grown
                moved[t, :, -1] += (change != 0).any(axis=1)
            flat = np.concatenate([
                *(v.ravel() for v in _dense(own)), *(np.broadcast_to(kept[n], v.shape).ravel() for n, v in zip(_DENSE, _dense(own), strict=True)),
                [own.base, kept["base"], 1.0],
            ]).astype(np.float64) * len(train)
            dense, trained_rows = flat if dense is None else dense + flat, trained_rows + len(train)
        if trained_rows:
            yield pa.record_batch({"slot": pa.array([-1], pa.int32()), "v": pa.array([dense], pa.list_(pa.float64()))})
            flat = moved.reshape(-1, SLICE * width)
            for a in range(0, len(flat), 16):
                some = flat[a : a + 16].astype(np.float64)
                yield pa.record_batch({"slot": pa.array(range(a, a + len(some)), pa.int32()), "v": pa.array(list(some), pa.list_(pa.float64()))})
        released()

    network, memory = copy.deepcopy(network), dict(memory)
    moved = np.zeros((2, BUCKETS, width), np.float32)
    pieces = moved.reshape(-1, SLICE * width)
    for slot, flat in _summed(rows.mapInArrow(run, "slot int, v array<double>"), "slot"):
        if slot >= 0:
            pieces[slot] = flat
            continue
        flat, at = flat[:-1] / flat[-1], 0
        for target in ("value", "memory"):
            for name, value in zip(_DENSE, _dense(network), strict=True):
                part = flat[at : at + value.size].reshape(value.shape).astype(np.float32)
                at += value.size
                if target == "value":
                    value[...] = part
                else:
                    memory[name] = part
        network.base, memory["base"] = float(flat[-2]), float(flat[-1])
    for t, name in enumerate(("word", "stem")):
        table = getattr(network, name)
        table += moved[t, :, :DIM] / np.maximum(moved[t, :, -1:], 1)
        memory[name] = memory.get(name, np.float32(1e-4)) + moved[t, :, DIM:-1]
    shared.unpersist()
    return network, memory


def cuts(rows: DataFrame, network: Network, calibrating: bool) -> None:
    """Set the network's cut and its languages' thresholds from all rows that calibrate, or from all that do not.

    Scores are counted in bins of 1 / `BINS` of a logit, so what comes back is bounded whatever the number of rows.
    """
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for table in shard_tables(batches) for b in table.to_batches()):
            keep = part_of(batch.column("key").to_numpy(zero_copy_only=False), 4) == calibrating
            chosen = batch.filter(pa.array(keep))
            texts = Texts.of(chosen.column("text"))
            for a, b in texts.blocks(BLOCK):
                own = chosen.slice(a, b - a)
                score = shared.value.logits(*word_numbers(texts.part(a, b))).astype(np.float64)
                yield pa.record_batch({"lang": own.column("lang"), "label": own.column("label"), "bin": pa.array(np.round(score * BINS).astype(np.int64))})
        released()

    schema = T.StructType([field("lang", T.StringType()), field("label", T.IntegerType()), field("bin", T.LongType())])
    found = rows.mapInArrow(run, schema).groupBy("lang", "label", "bin").count().toPandas()
    found["score"] = found["bin"] / BINS
    whole = found.groupby(["score", "label"], as_index=False)["count"].sum()
    cut = best_cut_counted(whole)
    network.base -= cut
    found["score"] -= cut
    for code, own in found[found["lang"].notna()].groupby("lang"):
        if min(own.loc[own["label"] == v, "count"].sum() for v in (0, 1)) >= LEAST:
            network.thresholds[code] = float(sigmoid(np.array(best_cut_counted(own))))


def trained(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", *, modulus: int = 5, rest: int = 0, epochs: int = 6, batch: int = 64, rate: float = 0.05, seed: int = 0) -> Network:
    """The classifier, learnt from all labels of keys whose crc32 does not leave `rest`.

    A share of the texts only sets the cut and the languages' thresholds; the others are trained on in shards.
    """
    known = stored(known_labels(labels, key, label, ~held_out(key, modulus, rest)), "labels")
    known = known.withColumn("key", F.col("key").cast(docs.schema[key].dataType))
    count = known.count()
    shards = max(1, -(-count // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    texts = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = packed(maybe_known(texts, known, count).withColumn("shard", shard), known.withColumn("shard", shard))
    # A task holds one shard at a time; many shards share a task, so sums that meet stay few.
    rows = settle(rows.coalesce(min(shards, TASKS)))
    having, train, held = seen_words(rows)
    network, memory = Network.start(label_odds(having[0], train), label_odds(having[1], train), seed), {}
    share = max(1e-3, train[1] / train.sum()) if train.sum() else 0.5
    for epoch in range(epochs if train.all() else 0):
        network, memory = epoch_of(rows, network, memory, epoch, share, batch=batch, rate=rate, seed=seed)
    cuts(rows, network, bool(held.any()))
    released()
    return network


def scored(docs: DataFrame, network: Network, text: str, *, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Rows with the score of the whole text; null and empty texts get the score of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(network)  # of a size fixed by the network's shape

    def run(texts: Texts, _: pa.RecordBatch) -> list:
        return [sigmoid(shared.value.logits(*word_numbers(texts)).astype(np.float64))]

    return map_texts(docs, text, run, [field(name, T.DoubleType())], keep=keep)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """(key, held_out, score, predicted, threshold, toxic) for every row: `predicted` by score 0.5, `toxic` by its language's threshold.

    A language without enough labelled texts, and a null one, has threshold 0.5. Null keys are never held out. Repeated rows
    stay; other columns are not read.
    """
    network = trained(docs, labels, key, text, lang, **options)
    modulus, rest = options.get("modulus", 5), options.get("rest", 0)
    rows = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    out = scored(rows, network, "text", keep=["key", "lang"])
    threshold = threshold_of(network, F.col("lang"))
    return out.select(
        F.col("key").alias(key), held_out("key", modulus, rest).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        threshold.alias("threshold"), (F.col("score") >= threshold).alias("toxic"),
    )


def threshold_of(network: Network, lang):
    out = F.lit(0.5)
    for code, value in network.thresholds.items():
        out = F.when(lang == code, value).otherwise(out)
    return out


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """The rows that their language's threshold does not reject, with all their columns."""
    network = trained(docs, labels, key, text, lang, **options)
    name = fresh_name(docs.columns, "score")
    return scored(docs, network, text, name=name).where(F.col(name) < threshold_of(network, F.col(lang))).drop(name)
