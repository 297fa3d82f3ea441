"""Sums and factorisations of large arrays that every task contributes to, reduced on the executors.

A task's contribution has the size of a model, not of its rows. The partitions of a table are therefore first put together
to one per core (`coalesce`, no shuffle): the number of contributions, and with it the bytes shuffled, grows with the
cluster and not with the table. What is left is merged chunk by chunk, or in a tree, and the driver gets one array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 16384  # values per merged row
FAN = 8        # contributions that one task of a tree merges


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def summed(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], size: int = CHUNK) -> np.ndarray | None:
    """The sum of what `partial` returns for the batches of each core, `size` values a row; None if there are no rows anywhere. One job."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = partial(batches)
        if total is not None:
            pieces = [total[i:i + size] for i in range(0, len(total), size)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], names=["chunk", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, total = None, 0.0
        for batch in batches:
            chunk = batch.column("chunk")[0].as_py()
            for p in batch.column("part"):
                total = total + np.frombuffer(p.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "part"])

    schema = "chunk int, part binary"
    found = rows.coalesce(cores(rows.sparkSession)).mapInArrow(task, schema).groupBy("chunk").applyInArrow(add, schema).collect()
    return np.concatenate([np.frombuffer(bytes(r["part"])) for r in sorted(found, key=lambda r: r["chunk"])]) if found else None


def triangle(rows: DataFrame, blocks: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], width: int) -> np.ndarray | None:
    """R of the QR decomposition of a tall matrix of `width` columns, whose rows `blocks` makes of batches: tall-skinny QR.

    Each core keeps one triangle; triangles are stacked and decomposed again, `FAN` at a time, in a tree. One job.
    """
    def squeezed(parts: Iterator[np.ndarray]) -> np.ndarray:
        r = np.zeros((0, width))
        for part in parts:
            r = np.linalg.qr(np.concatenate([r, part]), mode="r")
        return r

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = squeezed(blocks(batches))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.tobytes()], pa.binary())], names=["node", "part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, r = None, np.zeros((0, width))
        for batch in batches:
            node = batch.column("node")[0].as_py()
            r = squeezed([r, *[np.frombuffer(p.as_py()).reshape(-1, width) for p in batch.column("part")]])
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([r.tobytes()], pa.binary())], names=["node", "part"])

    schema, nodes = "node int, part binary", cores(rows.sparkSession)
    tree = rows.coalesce(nodes).mapInArrow(task, schema)
    while nodes > 1:
        tree, nodes = tree.withColumn("node", F.floor(F.col("node") / FAN).cast("int")).groupBy("node").applyInArrow(merge, schema), -(-nodes // FAN)
    found = tree.collect()
    return np.frombuffer(bytes(found[0]["part"])).reshape(-1, width) if found else None
