"""Frame helpers of the training-data operators: passes over texts, scratch tables, names."""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sinew.llm.text import Texts
from sinew.session import checkpoint_folder, prepare

BLOCK = 1 << 20  # bytes of text handled together; a longer text makes a block of its own


def ready(spark: SparkSession) -> SparkSession:
    """Settings for passes over texts: small Arrow batches, as one text may be very long."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place that spark.checkpoint.dir names."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *, files: int | None = None) -> DataFrame:
    """The rows as a written table: later steps read it instead of repeating the work, whichever executors are lost.

    `files` is for small tables that are written often: so many files, uncompressed.
    """
    path = scratch(df.sparkSession, name)
    if files:
        df.repartition(files).write.option("compression", "none").parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released() -> None:
    """Give memory that Arrow and the C library keep for reuse back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def fresh_name(columns: list[str], wanted: str) -> str:
    """`wanted`, or with underscores until no column has it (Spark does not tell upper from lower case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def map_texts(
    df: DataFrame,
    text: str,
    kernel: Callable[[Texts, pa.RecordBatch], list],
    fields: list[T.StructField],
    *,
    keep: list[str] | None = None,
    see: tuple[str, ...] = (),
    block: int = BLOCK,
) -> DataFrame:
    """Rows of the columns `keep` (all if not given) with `fields` appended, which `kernel` computes from texts of up to `block` bytes.

    The text column and the columns `see` reach the kernel even if they are not kept. Fields replace kept columns of the same name.
    """
    names = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if (keep is None or f.name in keep) and f.name.lower() not in names]
    schema = T.StructType([*kept, *fields])
    arrow = to_arrow_schema(schema)
    carried = [f.name for f in kept]
    columns = list(dict.fromkeys([*carried, text, *see]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts.of(batch.column(columns.index(text)))
            for a, b in texts.blocks(block):
                rows = batch.slice(a, b - a)
                made = kernel(texts.part(a, b), rows)
                arrays = [rows.column(i) for i in range(len(carried))]
                arrays += [m if isinstance(m, pa.Array) else pa.array(m, arrow.field(len(carried) + i).type) for i, m in enumerate(made)]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) if x.type != f.type else x for x, f in zip(arrays, arrow, strict=True)], names=arrow.names)
        released()

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


def lists(flat: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and each row's first value."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat, kind))


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def digests(df: DataFrame, keys: list[str], order: list[str], piece: str, separator: str, name: str) -> DataFrame:
    """(keys, name): lowercase SHA-256 of each key's pieces in `order`, joined by `separator`; null pieces are left out.

    Rows of a key run through one sorted task and are hashed as they come, so no key is ever held as a whole.
    """
    schema = T.StructType([*(df.schema[k] for k in keys), field(name, T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, started = None, None, False
        for batch in batches:
            done = []
            for *key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != current:
                    if current is not None:
                        done.append([*current, state.hexdigest()])
                    current, state, started = key, hashlib.sha256(), False
                if text is not None:
                    state.update((separator + text if started else text).encode())
                    started = True
            if done:
                yield _rows(done)
        if current is not None:
            yield _rows([[*current, state.hexdigest()]])

    def _rows(values: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*values, strict=True), arrow, strict=True)], schema=arrow)

    return df.select(*keys, *order, piece).repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, piece).mapInArrow(run, schema)
