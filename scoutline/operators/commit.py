"""Committing measurements back to the space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.selection import exact_rank


def validate_results(df: DataFrame, entry: str = "entry", out: str = "yield") -> DataFrame:
    """Typed-in results: 0 to 100 is accepted, -1 skipped, anything else, text included, rejected."""
    value = F.col(entry).try_cast("double")
    status = (F.when(value.between(0, 100), "accepted").when(value == -1, "skipped").otherwise("rejected"))
    return df.withColumn(out, value).withColumn("status", status)


def accepted(df: DataFrame, entry: str = "entry", out: str = "yield") -> DataFrame:
    return validate_results(df, entry, out).where(F.col("status") == "accepted").drop("status", entry)


def latest(history: DataFrame, keys: list[str], seq: list[str], label: str = "yield") -> DataFrame:
    """The last entry per key by the sequence columns; pre-aggregated before the shuffle."""
    order = F.struct(*seq)
    return history.groupBy(*keys).agg(F.max_by(label, order).alias("_new"), F.max(order).alias("_seq"))


def apply_history(space: DataFrame, history: DataFrame, keys: list[str], seq: list[str],
                  label: str = "yield") -> DataFrame:
    """Set the label of every row that matches all keys; the later entry wins; unmatched entries are ignored."""
    last = latest(history, keys, seq, label).drop("_seq")
    return (space.join(last, keys, "left").withColumn(label, F.coalesce("_new", F.col(label)))
            .select(*space.columns))


def commit_by_id(space: DataFrame, edits: DataFrame, seq: list[str], label: str = "yield") -> DataFrame:
    """Set labels by row id where the new value is a number of at least 0."""
    y = F.col(label)
    return apply_history(space, edits.where(y.isNotNull() & ~F.isnan(y) & (y >= 0)), ["row_id"], seq, label)


def count_known(space: DataFrame, label: str = "yield") -> DataFrame:
    """How many labels are above -1; unlike the training set, this counts measured zeros."""
    return space.agg(F.count_if((F.col(label) > -1) & ~F.isnan(label)).alias("n_known"))


def history_summary(history: DataFrame, ts: str = "ts", tie: str = "event_id", label: str = "yield") -> DataFrame:
    """A list numbered from 1 of the date and value of each entry, in append order."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp")).cast("double")
    return (exact_rank(history, seconds, tie, "_n")
            .select((F.col("_n") + 1).alias("number"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("date"), label))
