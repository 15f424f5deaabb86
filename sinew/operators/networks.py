"""Gradient-trained classifiers whose steps run on the cluster: a ReLU perceptron and a kernel machine on random features.

Training rows are cut into fixed mini-batches by a hash of their keys, and mini-batches into shards of a fixed number of rows. An
epoch is one job: weights and moments go out as a broadcast of known size, every shard takes its Adam steps from there for
all models, and the states of all shards are averaged by their rows on the cluster, so that one row per model reaches the
driver. Tables of one shard take the steps of plain mini-batch training. All folds of a cross-validation are models of the
same epochs: a row adds to the models that do not hold its fold out. Batches, shards, dropout and start weights come from
hashes and a seed, so results depend on partitioning only by the rounding of sums.

Mini-batches are kept as packed rows. A kernel machine with ``single`` computes features and gradients in single precision; weights,
moments, averages and scores are always in double precision.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sinew.functions import arrow
from sinew.operators.models import PROBABILITIES, DenseNet, cross_val_accuracy, fit_qda, predict_label, softmax
from sinew.session import checkpoint_folder, written

GROUPS = 64  # groups in which the sums of tasks meet before those of a model
SHARD_ROWS = 1 << 14  # rows that one state passes through in an epoch
TASKS_PER_CORE = 4  # that shards are dealt to; the states of a task's shards are summed before they are shuffled
CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PACKED = "part int, shard int, y binary, fold binary, h binary, x binary"
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def uniforms(rows: np.ndarray, columns: int, *salt: int) -> np.ndarray:
    """Numbers in [0, 1) for (row hash, column), the same wherever a row is."""
    h = _mixed(rows.astype(np.int64).view(np.uint64))
    for s in salt:
        h = _mixed(h + np.array([s + 1], np.uint64) * _GOLDEN)
    cells = _mixed(h[:, None] + np.arange(1, columns + 1, dtype=np.uint64) * _GOLDEN)
    return (cells >> np.uint64(11)) * 2.0**-53


@dataclass(frozen=True)
class Perceptron:
    """ReLU layers, dropout after the first one, softmax and cross-entropy."""

    hidden: tuple[int, ...] = (32, 16)
    dropout: float = 0.2
    rate: float = 1e-3

    def start(self, width: int, classes: int, seed: int) -> list[np.ndarray]:
        """Uniform weights within sqrt(6 / (in + out)), biases 0; weights and biases in turn."""
        rng = np.random.default_rng(seed)
        sizes = [width, *self.hidden, classes]
        out = []
        for a, b in zip(sizes[:-1], sizes[1:]):
            limit = np.sqrt(6.0 / (a + b))
            out += [rng.uniform(-limit, limit, (a, b)), np.zeros(b)]
        return out

    def gradients(self, weights: list[np.ndarray], x: np.ndarray, y: np.ndarray, rows: np.ndarray, step: int, seed: int) -> tuple[list[np.ndarray], float]:
        """Sums over the rows of the loss and its gradients."""
        inputs, masks = [x], []
        for n, (w, b) in enumerate(zip(weights[:-2:2], weights[1:-2:2])):
            a = inputs[-1] @ w
            a += b
            np.maximum(a, 0.0, out=a)
            mask = None
            if n == 0 and self.dropout:
                mask = (uniforms(rows, a.shape[1], seed, step) >= self.dropout) / (1.0 - self.dropout)
                a *= mask
            masks.append(mask)
            inputs.append(a)
        p = softmax(inputs[-1] @ weights[-2] + weights[-1])
        at = np.arange(len(y))
        loss = -np.log(np.maximum(p[at, y], 1e-300)).sum()
        p[at, y] -= 1.0
        out: list[np.ndarray] = []
        for n in range(len(weights) // 2 - 1, -1, -1):
            out[:0] = [inputs[n].T @ p, p.sum(axis=0)]
            if n:
                p = p @ weights[2 * n].T
                p *= inputs[n] > 0
                if masks[n - 1] is not None:
                    p *= masks[n - 1]
        return out, float(loss)

    def penalty(self, weights: list[np.ndarray], rows: int) -> list[np.ndarray]:
        return [np.zeros(1)] * len(weights)

    def scores(self, weights: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        for w, b in zip(weights[:-2:2], weights[1:-2:2]):
            x = np.maximum(x @ w + b, 0.0)
        return x @ weights[-2] + weights[-1]


@lru_cache(maxsize=8)
def _draws(width: int, dimensions: int, gamma: float, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Directions and shifts of random cosine features, the same for all rows and models."""
    rng = np.random.default_rng(7)
    w = rng.normal(0.0, np.sqrt(2 * gamma), (width, dimensions))
    return w.astype(kind), rng.uniform(0, 2 * np.pi, dimensions).astype(kind)


@dataclass(frozen=True)
class KernelMachine:
    """One-against-rest squared hinge loss on random cosine features, whose products approximate an RBF kernel.

    Half the squared weights over C times the number of rows is added to the mean loss; gamma is 1 / width unless given.
    """

    dimensions: int = 256
    c: float = 10.0
    gamma: float | None = None
    rate: float = 0.02
    single: bool = False

    def _features(self, x: np.ndarray) -> np.ndarray:
        w, shift = _draws(x.shape[1], self.dimensions, 1.0 / x.shape[1] if self.gamma is None else self.gamma, np.dtype(x.dtype).char)
        z = x @ w
        z += shift
        np.cos(z, out=z)
        z *= z.dtype.type(np.sqrt(2.0 / self.dimensions))
        return z

    def start(self, width: int, classes: int, seed: int) -> list[np.ndarray]:
        return [np.zeros((self.dimensions, classes)), np.zeros(classes)]

    def gradients(self, weights: list[np.ndarray], x: np.ndarray, y: np.ndarray, rows: np.ndarray, step: int, seed: int) -> tuple[list[np.ndarray], float]:
        if self.single:
            x, weights = x.astype(np.float32, copy=False), [w.astype(np.float32) for w in weights]
        z = self._features(x)
        side = np.where(np.arange(weights[1].size) == y[:, None], x.dtype.type(1), x.dtype.type(-1))
        short = np.maximum(0.0, 1.0 - side * (z @ weights[0] + weights[1]))
        d = x.dtype.type(-2) * side * short
        return [z.T @ d, d.sum(axis=0)], float((short**2).sum())

    def penalty(self, weights: list[np.ndarray], rows: int) -> list[np.ndarray]:
        return [weights[0] / (self.c * rows), np.zeros(1)]

    def scores(self, weights: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        return self._features(x) @ weights[0] + weights[1]


@dataclass
class Adam:
    """First and second moments of one model's gradients."""

    rate: float
    steps: int = 0
    first: list[np.ndarray] = field(default_factory=list)
    second: list[np.ndarray] = field(default_factory=list)

    def move(self, weights: list[np.ndarray], gradients: list[np.ndarray]) -> list[np.ndarray]:
        """The weights after a step. Moments and gradients are changed in place."""
        if not self.steps:
            self.first, self.second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        self.steps += 1
        rate, out = self.rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps), []
        for w, g, m, v in zip(weights, gradients, self.first, self.second):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            square = 0.001 * g
            square *= g
            v += square
            np.sqrt(v, out=square)
            square += 1e-7
            np.divide(m, square, out=square)
            square *= rate
            out.append(np.subtract(w, square, out=square))
        return out


@dataclass(frozen=True)
class Model:
    """A fitted kind with the scaling of its inputs."""

    kind: Perceptron | KernelMachine
    classes: tuple[str, ...]
    weights: list[np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.kind.scores(self.weights, (x - self.mean) / self.scale))

    def net(self) -> DenseNet:
        """A perceptron as stored layers, its scaling folded into the first."""
        w, b = self.weights[0] / self.scale[:, None], self.weights[1] - (self.mean / self.scale) @ self.weights[0]
        return DenseNet(self.classes, [w, *self.weights[2::2]], [b, *self.weights[3::2]])


def _scalings(rows: DataFrame, folds: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and deviation of every feature over all rows and over the rows outside each fold, from one pass.

    Tasks keep counts, means and sums of squares about the means, which are merged, so that large offsets do not cancel.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = {}
        for batch in batches:
            if batch.num_rows:
                x, fold = arrow.matrix(batch.column("f")), batch.column("fold").to_numpy()
                for f in np.unique(fold):
                    at = x[fold == f]
                    mean = at.mean(axis=0)
                    found[int(f)] = _merged(found.get(int(f)), (len(at), mean, ((at - mean) ** 2).sum(axis=0)))
        if found:
            yield state([TaskContext.get().partitionId() % GROUPS] * len(found), list(found), list(found.values()))

    def state(part: list, fold: list, values: list) -> pa.RecordBatch:
        n, mean, square = zip(*values)
        lists = [pa.array([list(x) for x in v], pa.list_(pa.float64())) for v in (mean, square)]
        return arrow.batch({"part": pa.array(part, pa.int32()), "fold": pa.array(fold, pa.int32()), "n": pa.array(n, pa.int64()), "mean": lists[0], "square": lists[1]})

    def add(table: pa.Table) -> pa.Table:
        table, total = table.sort_by("part"), None
        for r in table.to_pylist():
            total = _merged(total, (r["n"], np.array(r["mean"]), np.array(r["square"])))
        return pa.Table.from_batches([state(table["part"][:1].to_pylist(), table["fold"][:1].to_pylist(), [total])])

    schema = "part int, fold int, n long, mean array<double>, square array<double>"
    sums = rows.select("fold", "f").mapInArrow(own, schema).groupBy("part", "fold").applyInArrow(add, schema).groupBy("fold").applyInArrow(add, schema)
    # One row per fold.
    parts = {r["fold"]: (r["n"], np.array(r["mean"]), np.array(r["square"])) for r in sums.collect()}
    out = []
    for held in [None, *range(folds)]:
        total = None
        for f in sorted(parts):
            if f != held:
                total = _merged(total, parts[f])
        # All rows in the fold held out: their own mean, as no model will take a step from it.
        n, mean, square = total or (0, next(iter(parts.values()))[1], np.ones(width))
        spread = np.sqrt(square / n) if n else square
        out.append((mean, np.where(spread > 1e-12, spread, 1.0)))
    return out


def _merged(a: tuple | None, b: tuple) -> tuple:
    """Rows, mean and sum of squares about it of two sets of rows."""
    if a is None:
        return b
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + apart**2 * (a[0] * b[0] / n)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come in the order of their mini-batches as a row of arrays for each mini-batch."""

    def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        x = np.concatenate([arrow.matrix(c) for c in table["f"].chunks])
        y, fold, h = (np.ascontiguousarray(table[c].to_numpy(), kind) for c, kind in (("y", np.int32), ("fold", np.int32), ("h", np.int64)))
        return arrow.batch({
            **{c: pa.array([held[0].column(c)[0].as_py()], pa.int32()) for c in ("part", "shard")},
            **{c: pa.array([v.tobytes()], pa.binary()) for c, v in (("y", y), ("fold", fold), ("h", h), ("x", x))},
        })

    held, current = [], None
    for b in batches:
        part = b.column("part").to_numpy()
        for piece in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
            if not len(piece):
                continue
            if part[piece[0]] != current:
                if held:
                    yield row(held)
                held, current = [], part[piece[0]]
            held.append(b.slice(int(piece[0]), len(piece)))
    if held:
        yield row(held)


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fit_networks(
    features: DataFrame, classes: Sequence[str], kinds: dict[str, Perceptron | KernelMachine], *, folds: int = 0, scaled: bool = True,
    epochs: int = 150, batch: int = 4096, seed: int = 42, whole: bool = True, stored: bool = False,
) -> dict[tuple[str, int | None], Model]:
    """Models by (kind, held-out fold): of every kind one without each of the folds 0 … ``folds`` − 1, and one on all rows (None) if ``whole``.

    ``features`` has ``session_id, k, label, f`` and, with folds, ``fold``. A step sees the rows of one mini-batch of about ``batch``
    rows; an epoch visits all mini-batches in an order drawn for it, those of different shards side by side. Rows of other labels than ``classes`` are left out, and so
    are rows without label. ``features`` that are ``stored`` are cheap to read again; others are written first.
    """
    spark = features.sparkSession
    names = F.array(*[F.lit(c) for c in classes])
    rows = features.select(
        (F.array_position(names, F.col("label")) - 1).cast("int").alias("y"), (F.col("fold") if folds else F.lit(0)).cast("int").alias("fold"),
        F.xxhash64("session_id", "k", F.lit(seed)).alias("h"), "f",
    ).filter("y >= 0")
    if not stored:
        rows = written(rows, _scratch(spark, "training"))
    count = rows.count()
    if not count:
        raise ValueError("no rows to train on")
    batches = -(-count // batch)
    shards = -(-batches // max(1, SHARD_ROWS // batch))
    # A task has whole shards and holds one at a time; a mini-batch is a packed row.
    part = F.pmod("h", F.lit(batches)).cast("int")
    tasks = min(shards, TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    placed = rows.withColumn("part", part).withColumn("shard", F.col("part") % shards)
    packed = placed.repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard", "part", "h").mapInArrow(_packed, PACKED).persist()
    models = [(kind, fold) for kind in kinds for fold in [*([None] if whole else []), *range(folds)]]
    inputs = _scalings(rows, folds) if scaled else None
    width = len(rows.select("f").first()["f"])
    plain = (np.zeros(width), np.ones(width))
    scales = [plain if inputs is None else inputs[0 if fold is None else fold + 1] for _, fold in models]
    weights = [kinds[kind].start(width, len(classes), seed) for kind, _ in models]
    movers = [Adam(kinds[kind].rate) for kind, _ in models]
    schema = "part int, model int, n long, steps double, v binary"

    def run_epoch(epoch: int) -> None:
        sent = spark.sparkContext.broadcast((weights, movers))
        order = np.random.default_rng([seed, epoch]).permutation(batches)

        def shard_of(parts: dict[int, tuple]) -> list[tuple[int, int, int, np.ndarray]]:
            """Every model's rows, steps and state after the shard's mini-batches of this epoch."""
            states = [(list(w), replace(m, first=[v.copy() for v in m.first], second=[v.copy() for v in m.second]), [0]) for w, m in zip(*sent.value)]
            for at in np.flatnonzero(np.isin(order, list(parts))):
                y, fold, h, x = parts[order[at]]
                for held in dict.fromkeys(held for _, held in models):
                    own = slice(None) if held is None else np.flatnonzero(fold != held)
                    y_, h_ = y[own], h[own]
                    if not len(y_):
                        continue
                    mean, scale = scales[models.index((next(iter(kinds)), held))]
                    scaled = (x[own] - mean) / scale
                    for kind, k in kinds.items():
                        n = models.index((kind, held))
                        now, mover, seen = states[n]
                        g, _ = k.gradients(now, scaled, y_, h_, epoch * batches + int(at), seed)
                        g = [v.astype(np.float64, copy=False) / len(y_) + more for v, more in zip(g, k.penalty(now, count))]
                        now[:] = mover.move(now, g)
                        seen[0] += len(y_)
            return [(n, seen, mover.steps, np.concatenate([v.ravel() for v in (*now, *mover.first, *mover.second)])) for n, (now, mover, (seen,)) in enumerate(states) if seen]

        def train(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            sums, held, current = {}, {}, None

            def finish() -> None:
                for n, seen, steps, flat in shard_of(held) if held else []:
                    old = sums.get(n, (0, 0.0, 0.0))
                    sums[n] = (old[0] + seen, old[1] + seen * steps, old[2] + seen * flat)

            for b in batches_:
                for r in b.to_pylist():
                    if r["shard"] != current:
                        finish()
                        held, current = {}, r["shard"]
                    y, fold, h, x = (np.frombuffer(r[c], kind) for c, kind in (("y", np.int32), ("fold", np.int32), ("h", np.int64), ("x", np.float64)))
                    held[r["part"]] = y, fold, h, x.reshape(len(y), -1)
            finish()
            if sums:
                yield arrow.batch({
                    "part": pa.array([TaskContext.get().partitionId() % GROUPS] * len(sums), pa.int32()), "model": pa.array(list(sums), pa.int32()),
                    "n": pa.array([v[0] for v in sums.values()]), "steps": pa.array([v[1] for v in sums.values()]),
                    "v": pa.array([v[2].tobytes() for v in sums.values()], pa.binary()),
                })

        def add(table: pa.Table) -> pa.Table:
            table = table.sort_by("part").combine_chunks()
            v = sum(np.frombuffer(x.as_buffer()) for x in table["v"])
            return pa.table({
                "part": table["part"][:1], "model": table["model"][:1], "n": pa.array([int(np.sum(table["n"].to_numpy()))]),
                "steps": pa.array([float(np.sum(table["steps"].to_numpy()))]), "v": pa.array([v.tobytes()], pa.binary()),
            })

        found = packed.mapInArrow(train, schema)
        if tasks > GROUPS:
            found = found.groupBy("part", "model").applyInArrow(add, schema)
        if tasks > 1:
            found = found.groupBy("model").applyInArrow(add, schema)
        # One row per model.
        for r in found.toArrow().to_pylist():
            n, flat = r["model"], np.frombuffer(r["v"]) / r["n"]
            shapes, at, pieces = [w.shape for w in weights[n]], 0, []
            for shape in shapes * 3:
                size = int(np.prod(shape))
                pieces.append(flat[at : at + size].reshape(shape))
                at += size
            own = len(shapes)
            weights[n] = pieces[:own]
            movers[n] = Adam(movers[n].rate, round(r["steps"] / r["n"]), pieces[own : 2 * own], pieces[2 * own :])
        sent.unpersist()

    # Every epoch shuffles its states; they need not stay on disk until the driver collects its garbage.
    before = spark.conf.get(CLEANS, None)
    spark.conf.set(CLEANS, "true")
    try:
        for epoch in range(epochs):
            run_epoch(epoch)
    finally:
        spark.conf.unset(CLEANS) if before is None else spark.conf.set(CLEANS, before)
    packed.unpersist()
    return {m: Model(kinds[m[0]], tuple(classes), w, *s) for m, w, s in zip(models, weights, scales)}


def fit_perceptron(features: DataFrame, classes: Sequence[str], hidden: Sequence[int] = (32, 16), *, epochs: int = 150, batch: int = 4096, dropout: float = 0.2,
                   rate: float = 1e-3, seed: int = 42) -> DenseNet:
    """ReLU layers with dropout after the first, trained by Adam on the vectors as they are."""
    found = fit_networks(features, classes, {"mlp": Perceptron(tuple(hidden), dropout, rate)}, scaled=False, epochs=epochs, batch=batch, seed=seed)
    return found["mlp", None].net()


def score_by_fold(features: DataFrame, models: dict[int, Model], keep: Sequence[str] = ("label", "fold")) -> DataFrame:
    """Rows with ``p`` of the model that held their fold out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, fold = arrow.matrix(batch.column("f")), batch.column("_fold").to_numpy()
            p = np.empty((len(x), len(next(iter(models.values())).classes)))
            for f in np.unique(fold):
                p[fold == f] = models[int(f)].probabilities(x[fold == f])
            yield arrow.batch({**{c: batch.column(c) for c in keep}, "p": arrow.list_column(p)})

    schema = T.StructType([*[features.schema[c] for c in keep], PROBABILITIES])
    return features.select(*keep, F.col("fold").alias("_fold"), "f").mapInArrow(run, schema)


def classifier_benchmark(
    sets: dict[str, DataFrame], classes: Sequence[str], folds: int = 5, models: Sequence[str] = ("lda", "qda", "svm_rbf", "mlp"), *,
    epochs: int = 60, batch: int = 1024, stored: bool = False,
) -> DataFrame:
    """``features, model, mean, std``: grouped accuracy of each model on each feature set.

    ``sets`` has rows (session_id, k, label, fold, f) with folds 0 … ``folds`` − 1. LDA and QDA come from the folds' statistics. The kernel
    machine and the perceptron (128-64) of all folds are trained in the same steps, on vectors scaled by their training folds.
    Sets that are ``stored`` are cheap to read again; others are written first.
    """
    kinds = {"svm_rbf": KernelMachine(single=True), "mlp": Perceptron((128, 64), 0.0, 3e-3)}
    results = []
    for name, rows in sets.items():
        rows = rows.select("session_id", "k", "label", "fold", "f")
        if not stored:
            rows = written(rows, _scratch(rows.sparkSession, "benchmark"))
        trained = {m: kinds[m] for m in models if m in kinds}
        nets = fit_networks(rows, classes, trained, folds=folds, epochs=epochs, batch=batch, whole=False, stored=True) if trained else {}
        for model in models:
            if model in kinds:
                held = score_by_fold(rows, {f: nets[model, f] for f in range(folds)})
                hit = F.avg((predict_label(F.col("p"), classes) == F.col("label")).cast("double"))
                scores = held.groupBy("fold").agg(hit.alias("accuracy"))
            else:
                scores = cross_val_accuracy(rows, **({"fit": fit_qda} if model == "qda" else {}))
            results.append(scores.agg(F.lit(name).alias("features"), F.lit(model).alias("model"), F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std")))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out
