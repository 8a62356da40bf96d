"""Session helpers shared by the library, the tests and the benchmark."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = 8, app: str = "docloom", memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", os.environ.get("DOCLOOM_WAREHOUSE", "/tmp/docloom-warehouse"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables, read by Spark from any file system."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset a local session gets one of its own; a cluster must name it.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or "/tmp/checkpoints/docloom")
    return sc.getCheckpointDir()


#: Folders written inside a scratch block, innermost block last.
_SCRATCH: list[list[str]] = []
#: Folders that are removed when the program ends.
_LEFT: set[str] = set()


@atexit.register
def _swept() -> None:
    """Removes the tables that results could read until the program ended."""
    spark = SparkSession.getActiveSession() if _LEFT else None
    if spark is not None:
        for path in _LEFT:
            removed(spark, path)


def stored(df: DataFrame, name: str = "table") -> str:
    """Writes ``df`` as Parquet into the shared folder; returns where."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _LEFT.add(path)
    df.write.parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    A ``scratch`` block removes its tables; others stay to the program's end, as results may read them.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name))


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession, keep: int = 1) -> Iterator[None]:
    """Removes what was written inside the block, but for the last ``keep`` tables, which belong to the block around it."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        made = _SCRATCH.pop()
        for path in made[: len(made) - keep]:
            removed(spark, path)
            _LEFT.discard(path)
        if _SCRATCH:
            _SCRATCH[-1].extend(made[len(made) - keep :])
