"""Session construction and written intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quantframe", cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster supplies its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QF_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names, or the one already set on the context."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    holder = spark.sparkContext._jsc.sc().getCheckpointDir()
    return holder.get() if holder.isDefined() else None


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    Only a local master, where driver and executors share one disk, may fall back to a
    temporary folder.
    """
    named = checkpoint_dir(spark)
    if named:
        return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix=f"spark-{name}-")
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this session, unless the session or the folder is gone already."""
    with contextlib.suppress(Exception):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shared_at(df: DataFrame, name: str = "shared") -> tuple[DataFrame, Callable[[], None]]:
    """Like :func:`shared`, with a call that removes the table once nothing reads it any more."""
    spark = df.sparkSession
    folder = scratch_folder(spark, name)
    path = f"{folder}/rows"

    def discard() -> None:
        _remove(spark, folder)

    atexit.register(discard)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), discard


def shared(df: DataFrame, name: str = "shared") -> DataFrame:
    """Write a frame that several branches read, and continue from the written table.

    The branches then start from a small scan instead of repeating (and re-planning) the work
    above it, the optimiser sees the table's real size, and a lost executor re-reads files
    instead of replaying lineage. The table goes when the driver's Python ends.
    """
    return shared_at(df, name)[0]
