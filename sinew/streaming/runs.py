"""Running a stream over what is there, again and again, with its state kept between runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from sinew.session import checkpoint_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, so every executor reaches it."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_files(spark: SparkSession, path: str, schema, *, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream; ``files_per_trigger`` bounds what one trigger takes in."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_available(stream: DataFrame, out: str, checkpoint: str, *, mode: str = "append") -> list:
    """Process everything that has arrived and stop; state and progress stay in ``checkpoint``.

    Append results go to Parquet exactly once. Complete results replace the previous ones. Gives the progress of each trigger.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return query.recentProgress


def state_rows(progress: Iterable) -> list[int]:
    """Rows kept in the state after each trigger."""
    return [sum(s.numRowsTotal for s in p.stateOperators) for p in progress if p.stateOperators]


def dropped_by_watermark(progress: Iterable) -> int:
    """Rows the built-in aggregations left out because they came behind the watermark."""
    return sum(s.numRowsDroppedByWatermark for p in progress for s in p.stateOperators)


def replay(
    slices: Iterable[DataFrame], operator: Callable[[DataFrame], DataFrame], *, mode: str = "append", progress: list | None = None,
) -> DataFrame:
    """Append each slice to a source folder, run the stream over it, and read all results.

    The state carries from one run to the next, as in a job that is scheduled or restarted. The triggers' progress goes to ``progress``.
    """
    slices = list(slices)
    spark = slices[0].sparkSession
    base = scratch(spark, "stream")
    for rows in slices:
        rows.write.mode("append").parquet(f"{base}/in")
        source = read_files(spark, f"{base}/in", slices[0].schema)
        seen = run_available(operator(source), f"{base}/out", f"{base}/state", mode=mode)
        if progress is not None:
            progress += seen
    return spark.read.parquet(f"{base}/out")
