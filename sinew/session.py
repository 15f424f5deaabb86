"""Session settings and stage boundaries."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sinew", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (AQE, UTC, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Kernels import it there, and a worker does not see the driver's module path.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sinew-package-")) / "sinew.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator relies on; safe to repeat on a given session.

    Kernel stages cost far more per byte than scans, so partitions may shrink to 64 KB as long as
    there are cores to use them; at scale the advisory size decides as usual. A row of a kernel's batch may be a whole
    chunk of samples, so batches are bounded by bytes as well.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; a temporary one only for a local master (tests)."""
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sinew-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage at a stage boundary with a reliable checkpoint.

    Used where a small derived table feeds several prefix scans, each of which reads its input
    twice; without it the upstream work would be repeated for every reader.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows as a Parquet table at `path`: for large tables that feed several scans."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
