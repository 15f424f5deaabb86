"""Classifiers fitted from additive statistics, and their scoring.

A Gaussian classifier only needs count, mean and scatter matrix per class. These are computed once
per (fold, class) in Arrow batches and merged pairwise, so one pass over the data serves every
model, every feature subset and every cross-validation fold: training statistics of a fold are
those of the other folds merged. Only matrices of vector length reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sinew.functions import arrow
from sinew.session import settle

# --------------------------------------------------------------------------------- statistics


@dataclass(frozen=True)
class Moments:
    """Count, mean and centred scatter of a set of vectors."""

    n: float
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> "Moments":
        mean = x.mean(axis=0)
        d = x - mean
        return cls(float(len(x)), mean, d.T @ d)

    def merge(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(
            n,
            self.mean + gap * (other.n / n),
            self.scatter + other.scatter + np.outer(gap, gap) * (self.n * other.n / n),
        )

    def without(self, part: "Moments") -> "Moments":
        """Moments of the rows that are not in ``part``, which is some of these rows but not all."""
        n = self.n - part.n
        mean = (self.n * self.mean - part.n * part.mean) / n
        gap = mean - part.mean
        return Moments(n, mean, self.scatter - part.scatter - np.outer(gap, gap) * (n * part.n / self.n))

    def subset(self, columns: Sequence[int]) -> "Moments":
        columns = list(columns)
        return Moments(self.n, self.mean[columns], self.scatter[np.ix_(columns, columns)])


def merged(parts: Sequence[Moments]) -> Moments:
    total = parts[0]
    for p in parts[1:]:
        total = total.merge(p)
    return total


MOMENT_FIELDS = "n double, mean array<double>, scatter array<double>"
# With a million tasks a merge group still holds about a thousand matrices.
MERGE_GROUPS = 1024


def _moment_rows(keys: dict, found: dict[tuple, Moments]) -> pa.RecordBatch:
    columns = {name: pa.array([k[i] for k in found], type=t) for i, (name, t) in enumerate(keys.items())}
    return arrow.batch({
        **columns,
        "n": pa.array([m.n for m in found.values()]),
        "mean": pa.array([m.mean for m in found.values()], type=pa.list_(pa.float64())),
        "scatter": pa.array([m.scatter.ravel() for m in found.values()], type=pa.list_(pa.float64())),
    })


def moment_table(features: DataFrame, fold: str | None = None) -> DataFrame:
    """``fold, label, n, mean, scatter`` of each fold and class; fold 0 without ``fold``.

    Partition results are merged in two rounds of bounded groups.
    """
    rows = features.select((F.col(fold) if fold else F.lit(0)).alias("fold"), F.col("label").cast("string").alias("label"), "f")
    kind = rows.schema["fold"].dataType.simpleString()
    schema = f"part int, fold {kind}, label string, {MOMENT_FIELDS}"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % MERGE_GROUPS
        found: dict[tuple, Moments] = {}
        fold_type = pa.int32()
        for batch in batches:
            if not batch.num_rows:
                continue
            fold_type = batch.column("fold").type
            x = arrow.matrix(batch.column("f"))
            groups = pd.DataFrame({
                "fold": batch.column("fold").to_pandas(), "label": batch.column("label").to_numpy(zero_copy_only=False),
            }).groupby(["fold", "label"], sort=True).indices
            for key, at in groups.items():
                m = Moments.of(x[at])
                key = (part, key[0].item() if hasattr(key[0], "item") else key[0], str(key[1]))
                found[key] = found[key].merge(m) if key in found else m
        if found:
            yield _moment_rows({"part": pa.int32(), "fold": fold_type, "label": pa.string()}, found)

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        total = merged([_moments(r) for r in frame.itertuples()])
        first = frame.iloc[0]
        return pd.DataFrame({
            "part": [int(first["part"])], "fold": [first["fold"]], "label": [first["label"]], "n": [total.n],
            "mean": [total.mean.tolist()], "scatter": [total.scatter.ravel().tolist()],
        })

    parts = rows.mapInArrow(partial, schema)
    first = parts.groupBy("part", "fold", "label").applyInPandas(combine, schema)
    return first.groupBy("fold", "label").applyInPandas(combine, schema).drop("part")


def class_moments(features: DataFrame) -> dict[tuple[int, str], Moments]:
    """Moments per (0, label): one matrix per class on the driver."""
    return {(r.fold, r.label): _moments(r) for r in moment_table(features).toPandas().itertuples()}


def _moments(row) -> Moments:
    mean = np.asarray(row.mean, dtype=float)
    return Moments(float(row.n), mean, np.asarray(row.scatter, dtype=float).reshape(len(mean), -1))


def by_class(stats: dict[tuple[int, str], Moments]) -> dict[str, Moments]:
    """Moments per class."""
    return {
        label: merged([m for (_, name), m in sorted(stats.items()) if name == label])
        for label in sorted({label for _, label in stats})
    }


# ------------------------------------------------------------------------------------- models


@dataclass(frozen=True)
class LinearModel:
    """Class scores w·x + b, turned into probabilities by softmax."""

    classes: tuple[str, ...]
    weights: np.ndarray
    intercepts: np.ndarray
    xbar: np.ndarray | None = None
    scalings: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights.T + self.intercepts

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.scores(x))

    def rows(self, name: str) -> list[tuple]:
        return [(name, c, float(b), [float(v) for v in w]) for c, b, w in zip(self.classes, self.intercepts, self.weights)]

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.createDataFrame(self.rows(name), "model string, class string, intercept double, w array<double>")

    @classmethod
    def from_table(cls, rows: DataFrame, name: str) -> "LinearModel":
        found = sorted(rows.filter(F.col("model") == name).collect(), key=lambda r: r["class"])
        return cls(
            tuple(r["class"] for r in found), np.array([r["w"] for r in found]), np.array([r["intercept"] for r in found])
        )


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


RANK_TOLERANCE = 1e-4


def fit_lda(stats: dict[str, Moments]) -> LinearModel:
    """Discriminant with pooled covariance, priors from class shares, rank-truncated.

    Proportional features make the covariance singular; directions whose standardised singular
    value is at most 1e-4 carry nothing and are left out.
    """
    classes = tuple(sorted(stats))
    n = np.array([stats[c].n for c in classes])
    means = np.stack([stats[c].mean for c in classes])
    total, k = n.sum(), len(classes)
    priors = n / total
    centre = priors @ means
    within = sum(stats[c].scatter for c in classes)
    std = np.sqrt(np.diag(within) / total)
    std[std == 0] = 1.0
    values, vectors = np.linalg.eigh(within / np.outer(std, std) / (total - k))
    singular = np.sqrt(np.maximum(values, 0.0))
    keep = singular > RANK_TOLERANCE
    scalings = (vectors[:, keep] / std[:, None]) / singular[keep]
    between = (np.sqrt(n / max(1, k - 1))[:, None] * (means - centre)) @ scalings
    _, s, vt = np.linalg.svd(between, full_matrices=False)
    scalings = scalings @ vt.T[:, s > RANK_TOLERANCE * s[0]]
    projected = (means - centre) @ scalings
    intercepts = -0.5 * (projected**2).sum(axis=1) + np.log(priors)
    weights = projected @ scalings.T
    return LinearModel(classes, weights, intercepts - weights @ centre, centre, scalings)


@dataclass(frozen=True)
class QuadraticModel:
    """Gaussian classes with own covariance."""

    classes: tuple[str, ...]
    means: np.ndarray
    rotations: np.ndarray
    variances: np.ndarray
    priors: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = []
        for mean, rotation, variance, prior in zip(self.means, self.rotations, self.variances, self.priors):
            d = (x - mean) @ rotation
            out.append(-0.5 * ((d**2 / variance).sum(axis=1) + np.log(variance).sum()) + np.log(prior))
        return np.stack(out, axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.scores(x))


def fit_qda(stats: dict[str, Moments], reg: float = 0.1) -> QuadraticModel:
    """Per-class covariance over n − 1, eigenvalues shrunk to (1 − reg)·λ + reg."""
    classes = tuple(sorted(stats))
    spectra = [np.linalg.eigh(stats[c].scatter / (stats[c].n - 1)) for c in classes]
    n = np.array([stats[c].n for c in classes])
    return QuadraticModel(
        classes,
        np.stack([stats[c].mean for c in classes]),
        np.stack([v for _, v in spectra]),
        np.stack([(1 - reg) * np.maximum(w, 0.0) + reg for w, _ in spectra]),
        n / n.sum(),
    )


# -------------------------------------------------------------------------- feature subsets

CHANNEL_WIDTH = 20
TIME_DOMAIN = 12


def specialist_columns(features: int = 69, channels: int = 3) -> dict[str, list[int]]:
    """Positions of the time-domain, spectral and cross-channel specialists: 36, 24 and 9."""
    per = range(CHANNEL_WIDTH)
    return {
        "td": [c * CHANNEL_WIDTH + j for c in range(channels) for j in per if j < TIME_DOMAIN],
        "fd": [c * CHANNEL_WIDTH + j for c in range(channels) for j in per if j >= TIME_DOMAIN],
        "cc": list(range(channels * CHANNEL_WIDTH, features)),
    }


@dataclass(frozen=True)
class Ensemble:
    """Specialists on column subsets and a discriminant on their concatenated probabilities."""

    columns: dict[str, list[int]]
    specialists: dict[str, LinearModel]
    meta: LinearModel

    def inner(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([m.probabilities(x[:, self.columns[name]]) for name, m in self.specialists.items()], axis=1)

    @property
    def classes(self) -> tuple[str, ...]:
        return self.meta.classes

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self.meta.probabilities(self.inner(x))


def fit_specialists(stats: dict[str, Moments], columns: dict[str, list[int]]) -> dict[str, LinearModel]:
    """All specialists from sub-blocks of the same statistics."""
    return {name: fit_lda({c: m.subset(at) for c, m in stats.items()}) for name, at in columns.items()}


# ------------------------------------------------------------------------------------- scoring

PROBABILITIES = T.StructField("p", T.ArrayType(T.DoubleType()))


def score(features: DataFrame, model, keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``p``, the class probabilities in the model's class order, by batched matrix products."""
    keep = list(keep or [c for c in features.columns if c != "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = model.probabilities(arrow.matrix(batch.column("f")))
                yield arrow.batch({**{c: batch.column(c) for c in keep}, "p": arrow.list_column(p)})

    schema = T.StructType([*[features.schema[c] for c in keep], PROBABILITIES])
    return features.select(*keep, "f").mapInArrow(run, schema)


@dataclass(frozen=True)
class _Aligned:
    """A model that lacks classes of the full set scores them 0."""

    model: object
    classes: tuple[str, ...]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        p = np.zeros((len(x), len(self.classes)))
        p[:, [self.classes.index(c) for c in self.model.classes]] = self.model.probabilities(x)
        return p


# Rows of a fold that one task scores.
FOLD_ROWS = 20_000


def out_of_fold_proba(
    features: DataFrame, fold: str = "fold", columns: dict[str, list[int]] | None = None,
    keep: Sequence[str] = ("session_id", "k", "label"), fit=fit_lda, table: DataFrame | None = None,
) -> tuple[DataFrame, tuple[str, ...]]:
    """Every row scored by models fitted without its fold; one statistics pass for all folds.

    With ``columns`` the specialists' probabilities are concatenated. ``fold`` stays a column. Rows of a
    fold meet its matrices in groups of bounded size, where total − fold is fitted, so the number of
    folds is not bounded by the driver. ``table`` is the ``moment_table`` of the folds, if it is there already.
    """
    # One row per fold and class, read for the total, the sizes and the fits.
    table = settle(moment_table(features, fold)) if table is None else table
    total = label_totals(table)
    classes = tuple(sorted(total))
    sizes = table.groupBy(F.col("fold").alias("_fold")).agg(F.ceil(F.sum("n") / FOLD_ROWS).cast("int").alias("_groups"))
    keep = [*keep, *([fold] if fold not in keep else [])]
    rows = features.select(*keep, F.col(fold).alias("_fold"), "f").join(sizes, "_fold")
    rows = rows.withColumn("_group", F.pmod(F.xxhash64(*keep), F.col("_groups")).cast("int")).drop("_groups")
    parts = table.withColumnRenamed("fold", "_fold").join(sizes, "_fold")
    parts = parts.withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1))).drop("_groups")

    def run(held: pa.Table, own: pa.Table) -> pa.Table:
        x = arrow.matrix(held["f"].combine_chunks()) if len(held) else np.empty((0, 0))
        gone = {r["label"]: Moments(r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(len(r["mean"]), -1)) for r in own.to_pylist()}
        train = {label: m.without(gone[label]) if label in gone else m for label, m in total.items() if label not in gone or m.n > gone[label].n}
        if columns is None:
            model = _Aligned(fit(train), classes)
        else:
            model = _Stack(columns, {n: _Aligned(m, classes) for n, m in fit_specialists(train, columns).items()})
        p = model.probabilities(x) if len(held) else np.empty((0, 1))
        return held.select(keep).append_column("p", arrow.list_column(p))

    schema = T.StructType([*[features.schema[c] for c in keep], PROBABILITIES])
    by = ["_fold", "_group"]
    return rows.groupBy(*by).cogroup(parts.groupBy(*by)).applyInArrow(run, schema), classes


def label_totals(table: DataFrame) -> dict[str, Moments]:
    """Moments of each class over all folds, merged in bounded groups before one matrix per class is sent."""
    schema = f"part int, label string, {MOMENT_FIELDS}"

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        m = merged([_moments(r) for r in frame.itertuples()])
        first = frame.iloc[0]
        return pd.DataFrame({"part": [int(first["part"])], "label": [first["label"]], "n": [m.n], "mean": [m.mean.tolist()], "scatter": [m.scatter.ravel().tolist()]})

    rows = table.select(F.pmod(F.xxhash64("fold"), F.lit(MERGE_GROUPS)).cast("int").alias("part"), "label", "n", "mean", "scatter")
    first = rows.groupBy("part", "label").applyInPandas(combine, schema)
    last = first.groupBy("label").applyInPandas(combine, schema)
    return {r.label: _moments(r) for r in last.toPandas().itertuples()}


@dataclass(frozen=True)
class _Stack:
    columns: dict[str, list[int]]
    specialists: dict[str, object]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([m.probabilities(x[:, self.columns[n]]) for n, m in self.specialists.items()], axis=1)


def fit_ensemble(features: DataFrame, fold: str = "fold", columns: dict[str, list[int]] | None = None) -> Ensemble:
    """Stacking: meta model on out-of-fold probabilities, specialists refitted on all rows."""
    columns = columns or specialist_columns()
    held, _ = out_of_fold_proba(features, fold, columns)
    meta = fit_lda(by_class(class_moments(held.withColumnRenamed("p", "f"))))
    return Ensemble(columns, fit_specialists(by_class(class_moments(features)), columns), meta)


def cross_val_accuracy(features: DataFrame, fold: str = "fold", fit=fit_lda, columns: Sequence[int] | None = None) -> DataFrame:
    """``fold, n, accuracy`` of models fitted without each fold."""
    rows = features
    if columns is not None:
        rows = features.withColumn("f", F.transform(F.array(*[F.lit(c) for c in columns]), lambda c: F.get("f", c)))
    held, classes = out_of_fold_proba(rows, fold, keep=("label",), fit=fit)
    hit = predict_label(F.col("p"), classes) == F.col("label")
    return held.groupBy(fold).agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("accuracy"))


def cross_val_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"))


def specialist_cv(features: DataFrame, fold: str = "fold", columns: dict[str, list[int]] | None = None) -> DataFrame:
    """``model, mean, std`` of grouped accuracy for each specialist and the meta model."""
    columns = columns or specialist_columns()
    held, classes = out_of_fold_proba(features, fold, columns)
    k = len(classes)
    specialists = [
        held.select(F.lit(name).alias("model"), fold, (predict_label(F.slice("p", n * k + 1, k), classes) == F.col("label")).alias("hit"))
        for n, name in enumerate(columns)
    ]
    meta_held, meta_classes = out_of_fold_proba(held.withColumnRenamed("p", "f"), fold)
    hits = meta_held.select(F.lit("meta").alias("model"), fold, (predict_label(F.col("p"), meta_classes) == F.col("label")).alias("hit"))
    for s in specialists:
        hits = hits.unionByName(s)
    per_fold = hits.groupBy("model", fold).agg(F.avg(F.col("hit").cast("double")).alias("accuracy"))
    return per_fold.groupBy("model").agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"))


# ----------------------------------------------------------------------- vectors of probability


def predict_label(p: Column, classes: Sequence[str]) -> Column:
    """Class of the first maximum."""
    names = F.array(*[F.lit(c) for c in classes])
    return F.get(names, (F.array_position(p, F.array_max(p)) - 1).cast("int"))


def soft_one_hot(p: Column) -> Column:
    """The winner keeps its probability, the others share the rest evenly."""
    top = F.array_max(p)
    at = F.array_position(p, top) - 1
    return F.transform(p, lambda v, i: F.when(i == at, v).otherwise((1 - top) / (F.size(p) - 1)))


def average_models(*vectors: Column) -> Column:
    """Mean over the models that are present (null vectors are not)."""
    present = F.array_compact(F.array(*vectors))
    total = F.aggregate(
        F.slice(present, 2, len(vectors)), F.get(present, F.lit(0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y)
    )
    return F.transform(total, lambda v: v / F.size(present))


def quantise_int8(x: Column, scale: float, zero: int) -> Column:
    """Rounded half away from zero, clamped to −128..127."""
    return F.least(F.greatest(F.round(x / scale) + zero, F.lit(-128)), F.lit(127)).cast("int")


def dequantise_int8(q: Column, scale: float, zero: int) -> Column:
    return (q - zero) * F.lit(scale)


def feature_importance(model: DataFrame) -> DataFrame:
    """``pos, importance``: mean |weight| over classes of a model table."""
    return model.select(F.posexplode("w").alias("pos", "v")).groupBy("pos").agg(F.avg(F.abs("v")).alias("importance"))


def importance_top_k(model: DataFrame, k: int = 8) -> DataFrame:
    return feature_importance(model).orderBy(F.desc("importance"), "pos").limit(k)


def lda_project(features: DataFrame, model: LinearModel, axes: int = 2) -> DataFrame:
    """First discriminant axes of each vector: ``axis0, axis1``."""
    keep = [c for c in features.columns if c != "f"]
    axes = min(axes, model.scalings.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = (arrow.matrix(batch.column("f")) - model.xbar) @ model.scalings[:, :axes]
                yield arrow.batch({
                    **{c: batch.column(c) for c in keep}, **{f"axis{n}": pa.array(np.ascontiguousarray(y[:, n])) for n in range(axes)}
                })

    fields = [T.StructField(f"axis{n}", T.DoubleType()) for n in range(axes)]
    return features.select(*keep, "f").mapInArrow(run, T.StructType([*[features.schema[c] for c in keep], *fields]))


# ---------------------------------------------------------------------------------- neural net


@dataclass(frozen=True)
class DenseNet:
    """ReLU layers and a softmax output from stored weight matrices."""

    classes: tuple[str, ...]
    weights: list[np.ndarray] = field(default_factory=list)
    biases: list[np.ndarray] = field(default_factory=list)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        for w, b in zip(self.weights[:-1], self.biases[:-1]):
            x = np.maximum(x @ w + b, 0.0)
        return softmax(x @ self.weights[-1] + self.biases[-1])

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, w.tolist(), b.tolist()) for n, (w, b) in enumerate(zip(self.weights, self.biases))]
        return spark.createDataFrame(rows, "layer int, w array<array<double>>, b array<double>")

    @classmethod
    def from_table(cls, rows: DataFrame, classes: Sequence[str]) -> "DenseNet":
        found = rows.orderBy("layer").collect()
        return cls(tuple(classes), [np.array(r["w"]) for r in found], [np.array(r["b"]) for r in found])
