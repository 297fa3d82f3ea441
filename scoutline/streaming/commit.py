"""Measurements as a stream, committed batch by batch.

The state is the winning measurement per key, a table that grows with the measured rows and not with the space. Each
micro-batch writes the winners among its own rows, so its cost is that of the batch; replaying a batch writes the same
files again. Every `COMPACT_EVERY` batches the files so far are folded into one, and readers fold what came since.
The winner carries its (ts, event id), so a measurement that arrives late cannot displace a newer one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.commit import accepted

COMPACT_EVERY = 50


def winners_schema(keys: dict[str, str], seq: dict[str, str]) -> str:
    cols = {**keys, **seq, "yield": "double"}
    return ", ".join(f"`{c}` {t}" for c, t in cols.items())


def _fold(rows: DataFrame, keys: dict[str, str], seq: dict[str, str]) -> DataFrame:
    row = F.struct(*seq, "yield")
    return rows.groupBy(*keys).agg(F.max_by(row, F.struct(*seq)).alias("w")).select(*keys, "w.*")


def stream_commit(feed: DataFrame, root: str, keys: dict[str, str], seq: dict[str, str], checkpoint: str,
                  once: bool = True) -> StreamingQuery:
    """Start committing a feed of (keys, seq, entry). `keys` and `seq` give column names and types."""
    def commit(batch: DataFrame, batch_id: int) -> None:
        _fold(accepted(batch).select(*keys, *seq, "yield"), keys, seq).write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
        if _last_fold(batch_id) == batch_id:
            earlier = _last_fold(batch_id - 1)
            _since(batch.sparkSession, root, keys, seq, earlier, batch_id).write.mode("overwrite").parquet(f"{root}/upto={batch_id}")

    writer = feed.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _last_fold(batch_id: int) -> int:
    """The last batch up to which the state is in one table, -1 for none."""
    return (batch_id + 1) // COMPACT_EVERY * COMPACT_EVERY - 1


def _since(spark: SparkSession, root: str, keys: dict[str, str], seq: dict[str, str], fold: int, version: int) -> DataFrame:
    paths = [f"{root}/upto={fold}"] * (fold >= 0) + [f"{root}/batch={i}" for i in range(fold + 1, version + 1)]
    return _fold(spark.read.schema(winners_schema(keys, seq)).parquet(*paths), keys, seq)


def winners(spark: SparkSession, root: str, keys: dict[str, str], seq: dict[str, str], version: int) -> DataFrame:
    """The winning measurements as of a batch; none before the first (-1)."""
    if version < 0:
        return spark.createDataFrame([], winners_schema(keys, seq))
    return _since(spark, root, keys, seq, _last_fold(version), version)


def last_batch(run: StreamingQuery) -> int:
    """The last batch of a query that has ended; -1 if the feed was empty."""
    return run.lastProgress["batchId"] if run.lastProgress else -1
