"""Where intermediate tables go: the shared folder the cluster names, never a worker's own disk."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="scoutline-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this session has written below its checkpoint folder, once no result that reads it is needed any more."""
    root = spark.sparkContext.getCheckpointDir()
    if root:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to Python workers whose path does not have it, once per application (an installed package needs no call).

    The workers of a local session count too: they see the folder the session was started in, which may be another one."""
    sc = spark.sparkContext
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root, name = os.path.split(package)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = os.path.join(tempfile.gettempdir(), f"{name}-{sc.applicationId}.zip")
    if not os.path.exists(archive):
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, files in os.walk(package):
                for f in (f for f in files if f.endswith(".py")):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), root))
        sc.addPyFile(archive)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path of its own below the checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to a table in the shared checkpoint folder and go on from there.

    Lost executors cost only a re-read, later plans read just the columns they need, and the optimizer knows
    the table's size.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def concurrently(spark: SparkSession, fn: Callable, items: Iterable, threads: int = 4) -> list:
    """`fn` of each item, with a few Spark jobs in flight at once: for independent model fits made of many short jobs."""
    items = list(items)
    with ThreadPool(max(1, min(threads, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(fn), items)
