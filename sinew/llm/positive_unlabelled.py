"""Quality classifier by positive-unlabelled learning: non-negative unbiased risk on trusted positives and web text.

Texts become counts of what surface noise changes (case, symbols, punctuation, repetition, word lengths and shapes); a
small network is fitted in NumPy on a bounded sample. The class prior is estimated from the two samples: the share of
positives is at most U(A) / P(A) for any set A of texts, and sets of high scores come close to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sinew.llm.frames import field, fresh_name, lists, map_texts
from sinew.llm.labelled import best_cut, chosen_labels, held_out, logit, matched, part_of, sigmoid
from sinew.llm.text import SPACED_WORD, Hasher, Texts, joined, mixed, owners, per_text

CUT = 0.7
#: Bounds of the fitting sample: trusted positives, and labelled negatives that only set where the score crosses CUT.
SAMPLE = {1: 6000, 0: 3000}
UNLABELLED = 12_000  # texts of any kind for the gradient steps, by a hash of the key
SHAPES = 64  # hashed word shapes
HIDDEN = 16
_HASH, _SHAPE = Hasher(91), Hasher(92)
_MARKS = b".,;:!?'\"()[]{}<>#*$%&|@/\\_=+-~^`0123456789"
_CHARACTER = SPACED_WORD & (np.arange(256) & 0xC0 != 0x80)  # first bytes of characters in words
_KIND = np.full(256, 4, np.uint8)  # shapes: lower, upper, digit, the mark itself, other characters
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
for _b in range(33, 127):
    if not chr(_b).isalnum():
        _KIND[_b] = _b


def features(texts: Texts) -> np.ndarray:
    """(texts, features): shares and logarithms, all 0 for a text without words."""
    data, at, n = texts.data, texts.offsets, len(texts)
    starts, ends, first = texts.words(SPACED_WORD)
    owner, words, length = owners(first), np.diff(first), ends - starts
    many = np.maximum(words, 1)
    # How often each text has each byte.
    counts = np.bincount(np.repeat(np.arange(n) * 256, np.diff(at)) + data, minlength=n * 256).reshape(n, 256)
    chars = np.maximum(counts[:, _CHARACTER].sum(axis=1), 1)
    upper, lower = counts[:, 65:91].sum(axis=1), counts[:, 97:123].sum(axis=1)
    columns = [upper / np.maximum(upper + lower, 1)]
    columns += [np.log1p(100 * counts[:, m] / chars) for m in _MARKS]
    columns.append(np.log1p(100 * counts[:, 10] / many))
    hashes = _HASH.ranges(data, starts, ends)
    own = mixed(owner.astype(np.uint64))
    distinct = lambda h, o: np.bincount(o[np.unique(h, return_index=True)[1]], minlength=n)
    columns.append(distinct(hashes ^ own, owner) / many)
    for width in (2, 4):
        grams = joined(hashes, width)
        valid = np.flatnonzero(owner[: len(grams)] == owner[width - 1 :]) if len(grams) else np.zeros(0, np.int64)
        columns.append(1 - distinct(grams[valid] ^ own[valid], owner[valid]) / np.maximum(words - width + 1, 1) * (words >= width))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    columns.append(per_text(again, first) / many if len(hashes) else np.zeros(n))
    mean = per_text(length, first) / many if len(length) else np.zeros(n)
    square = per_text(length * length, first) / many if len(length) else np.zeros(n)
    columns += [np.log1p(mean), np.log1p(np.sqrt(np.maximum(square - mean * mean, 0))), np.log1p(words)]
    # Shapes: runs of equal kinds count once, so "Word," and "Another," share one.
    kind = _KIND[data]
    change = np.concatenate([[True], kind[1:] != kind[:-1]]) if len(data) else np.zeros(0, bool)
    change[starts] = True
    places = np.flatnonzero(change & SPACED_WORD[data]) if len(data) else np.zeros(0, np.int64)
    shape = _SHAPE.ranges(kind[places], np.searchsorted(places, starts), np.searchsorted(places, ends)) >> np.uint64(58)
    shaped = np.bincount(owner * SHAPES + shape.astype(np.int64), minlength=n * SHAPES).reshape(n, SHAPES)
    return np.column_stack([*columns, np.log1p(20 * shaped / many[:, None])]) * (words > 0)[:, None]


@dataclass
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    base: float = 0.0

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.first + self.bias)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.out + self.base


def descend(x: np.ndarray, seed: int, steps: int, batches, slope) -> Scorer:
    """Adam on a network with one hidden layer; `slope(logits, batch)` is the derivative of the risk by the logits."""
    rng = np.random.default_rng(seed)
    net = Scorer(x.mean(axis=0), x.std(axis=0) + 1e-3, rng.normal(0, 0.1, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN))
    base, m, v = np.zeros(1), {}, {}
    for t in range(1, steps + 1):
        rows, batch = batches(rng)
        z = np.clip((x[rows] - net.mean) / net.scale, -8, 8)
        h = np.tanh(z @ net.first + net.bias)
        g = slope(h @ net.out + base[0], batch)
        back = g[:, None] * net.out * (1 - h * h)
        for name, value, grad in (
            ("out", net.out, h.T @ g + 1e-4 * net.out), ("base", base, np.array([g.sum()])),
            ("first", net.first, z.T @ back + 1e-4 * net.first), ("bias", net.bias, back.sum(axis=0)),
        ):
            m[name] = 0.9 * m.get(name, 0) + 0.1 * grad
            v[name] = 0.999 * v.get(name, 0) + 0.001 * grad * grad
            value -= 0.005 * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)
    net.base = float(base[0])
    return net


def prior_cuts(positive: np.ndarray, least: float = 0.25) -> np.ndarray:
    """Ascending scores whose upper tails hold from nearly all down to `least` of the positives."""
    return np.quantile(positive, np.linspace(0.02, 1 - least, 60))


def estimated_prior(positive: np.ndarray, cuts: np.ndarray, tails: np.ndarray, n: int) -> float:
    """Share of positives among n texts of which the shares `tails` lie above the cuts: the least ratio of upper tails."""
    # One standard error is added, as the least of many noisy ratios lies too low.
    share = tails + np.sqrt(tails * (1 - tails) / max(n, 1))
    ratio = share / np.maximum([(positive >= c).mean() for c in cuts], 1e-9)
    return float(np.clip(ratio.min(), 0.05, 0.98))


def _epochs(rows: int, batch: int, epochs: int = 20) -> int:
    return int(np.clip(epochs * rows / batch, 150, 1500))


def fit(positive: np.ndarray, unlabelled: np.ndarray, *, halves: tuple[np.ndarray, np.ndarray] | None = None, tails=None, batch: int = 256, seed: int = 0) -> tuple[Scorer, float]:
    """The scorer of least non-negative risk, and the prior used.

    Risk with the sigmoid loss: prior * R_P(+1) + max(0, R_U(-1) - prior * R_P(-1)); where the second part falls below
    zero its gradient is turned round, as it then only fits noise. The prior comes from scores of texts that the scoring
    network has not seen: it is fitted on one half of both samples and judged on the other, both ways. `tails(nets, cuts)` counts, for
    both networks, how many texts of the other half of the corpus lie above each cut, and how many there are; without it the sample's do.
    """

    def against(z, _):  # positives against unlabelled
        return (sigmoid(z) - np.repeat([1.0, 0.0], batch)) / batch

    def draw(p: int, u: int):
        return lambda rng: (np.concatenate([rng.integers(0, p, batch), p + rng.integers(0, u, batch)]), None)

    own_p, own_u = halves or (np.arange(len(positive)) % 2, np.arange(len(unlabelled)) % 2)
    if min((own_p == 0).sum(), (own_p == 1).sum(), (own_u == 0).sum(), (own_u == 1).sum()) == 0:
        own_p, own_u = np.full(len(positive), 2), np.full(len(unlabelled), 2)  # too few to halve: both see all
    nets, cuts, unseen = [], [], []
    for half in (0, 1):
        p, u = positive[(own_p == half) | (own_p == 2)], unlabelled[(own_u == half) | (own_u == 2)]
        nets.append(descend(np.concatenate([p, u]), seed, _epochs(len(p) + len(u), batch, 5), draw(len(p), len(u)), against))
        unseen.append(nets[half].logits(positive[own_p != half]))
        cuts.append(prior_cuts(unseen[half]))
    if tails is None:
        counts = [(nets[h].logits(unlabelled[own_u != h])[:, None] >= cuts[h]).sum(axis=0) for h in (0, 1)]
        sizes = [int((own_u != h).sum()) for h in (0, 1)]
    else:
        counts, sizes = tails(nets, cuts)
    prior = float(np.mean([estimated_prior(unseen[h], cuts[h], counts[h] / max(sizes[h], 1), sizes[h]) for h in (0, 1) if sizes[h]] or [0.5]))

    def slope(z, _):
        s = sigmoid(z)
        d = s * (1 - s)  # of the loss of calling a text negative; the other loss has the opposite sign
        negative = s[batch:].mean() - prior * s[:batch].mean()
        up = np.concatenate([-prior * d[:batch], np.zeros(batch)]) / batch
        down = np.concatenate([-prior * d[:batch], d[batch:]]) / batch
        return up + down if negative >= 0 else -down

    x = np.concatenate([positive, unlabelled])
    return descend(x, seed + 1, _epochs(len(x), batch), draw(len(positive), len(unlabelled)), slope), prior


def corpus_tails(rows: DataFrame, nets: list[Scorer], cuts: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
    """How many of all rows (text, half) score at each network's cuts or above, counted in Spark; network h only judges rows of the other half."""

    def levels(texts: Texts, batch: pa.RecordBatch) -> list:
        x, half = features(texts), batch.column(batch.schema.get_field_index("half")).to_numpy()
        level = np.zeros(len(x), np.int32)
        for h in (0, 1):
            level[half != h] = np.searchsorted(cuts[h], nets[h].logits(x[half != h]), "right")
        return [level]

    found = map_texts(rows, "text", levels, [field("level", T.IntegerType())], keep=["half"]).groupBy("half", "level").count().collect()
    counts = np.zeros((2, len(cuts[0]) + 1), np.int64)
    for r in found:
        counts[1 - r["half"], r["level"]] = r["count"]
    above = [c[::-1].cumsum()[::-1] for c in counts]
    return [a[1:] for a in above], [int(a[0]) for a in above]


def trained(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", *, modulus: int = 4, rest: int = 2, sample: dict[int, int] = SAMPLE, unlabelled: int = UNLABELLED) -> Scorer:
    """The scorer, learnt from labels of keys whose crc32 does not leave `rest`; its score crosses CUT between the labelled classes.

    Positives labelled 1 are trusted; unlabelled texts are a sample of all documents, labels unseen. The sample only serves the
    gradient steps: the class prior comes from the scores of all documents, each judged by the network that saw the other half of keys.
    A fourth of the labelled sample is kept out of the fit and sets the cut.
    """
    half = F.pmod(F.xxhash64(F.col("key"), F.lit("half")), F.lit(2)).cast("int")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("half", half)
    chosen = chosen_labels(labels, key, label, ~held_out(key, modulus, rest), sample)
    some = rows.select("key").where("key IS NOT NULL").orderBy(F.xxhash64("key", F.lit("web")), "key").limit(unlabelled).distinct().withColumn("label", F.lit(-1))

    def rows_of(texts: Texts, _: pa.RecordBatch) -> list:
        x = features(texts)
        return [lists(x.ravel(), np.arange(len(x) + 1) * x.shape[1], pa.float64())]

    table = map_texts(matched(rows, chosen.unionByName(some)), "text", rows_of, [field("x", T.ArrayType(T.DoubleType()))], keep=["key", "label", "half"]).toArrow().sort_by([("key", "ascending"), ("label", "ascending")])
    if not len(table):
        return constant()
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(len(table), -1)
    kind, keys, part = table["label"].to_numpy(), table["key"].to_numpy(), table["half"].to_numpy()
    kept_out = part_of(keys, 4) & (kind >= 0)
    positive, web = x[(kind == 1) & ~kept_out], x[kind == -1]
    if not len(positive) or not len(web):
        return constant(x.shape[1])
    halves = part[(kind == 1) & ~kept_out], part[kind == -1]
    scorer, _ = fit(positive, web, halves=halves, tails=lambda nets, cuts: corpus_tails(rows, nets, cuts))
    rows_ = kept_out if kept_out.any() else kind >= 0
    scorer.base += logit(CUT) - best_cut(scorer.logits(x[rows_]), kind[rows_], balanced=True)
    return scorer


def constant(width: int = 1) -> Scorer:
    """Scores every text CUT: nothing was learnt."""
    return Scorer(np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), logit(CUT) + 1e-9)


def scored(docs: DataFrame, scorer: Scorer, text: str, *, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    def run(texts: Texts, _: pa.RecordBatch) -> list:
        x = features(texts)
        return [sigmoid(scorer.logits(x if len(scorer.mean) == x.shape[1] else x[:, : len(scorer.mean)]))]

    return map_texts(docs, text, run, [field(name, T.DoubleType())], keep=keep)


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, held_out, score, predicted) for every row; `predicted` is 1 from score CUT on.

    Null and empty texts have the score of no words. Null keys are never held out. Repeated rows stay; other columns are
    not read. Without labelled positives every score is CUT.
    """
    scorer = trained(docs, labels, key, text, **options)
    out = scored(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), scorer, "text", keep=["key"])
    return out.select(F.col("key").alias(key), held_out("key", options.get("modulus", 4), options.get("rest", 2)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def good_only(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that score CUT or more, with all their columns."""
    name = fresh_name(docs.columns, "score")
    return scored(docs, trained(docs, labels, key, text, **options), text, name=name).where(F.col(name) >= CUT).drop(name)
