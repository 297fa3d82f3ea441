"""Splits and the labelled / unlabelled sets.

Random choices are row predicates from `functions.selection`: exactly the asked number of rows, the same
rows on every retry, no shuffle. The same predicate can therefore split every representation alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.selection import exact_rank, first_n_by, random_n


def _tag(df: DataFrame, is_test: Column) -> DataFrame:
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def split_exact(df: DataFrame, test_ratio: float, seed: int) -> DataFrame:
    """Exactly int(n * ratio) rows are test, without replacement."""
    return _tag(df, random_n(df, lambda n: int(n * test_ratio), seed))


def split_ratio(df: DataFrame, train_ratio: float = 0.8, seed: int = 0) -> DataFrame:
    """Exactly round(n * ratio) rows (half to even) are train."""
    return _tag(df, ~random_n(df, lambda n: round(n * train_ratio), seed))


def initial_set(df: DataFrame, n: int = 0, test_ratio: float = 0.95, seed: int = 0) -> DataFrame:
    """The start set in ascending id order: n rows, or all but int(ratio * rows) of them when n is 0."""
    size = n if n else lambda total: total - int(test_ratio * total)
    return df.where(random_n(df, size, seed)).orderBy("row_id")


def split_by_group(df: DataFrame, col: str, test_values: DataFrame | list) -> DataFrame:
    """Rows whose group is among the test values are test. A row without a group is an error."""
    if df.where(F.col(col).isNull()).limit(1).count():
        raise ValueError(f"{col} has nulls: the split would not be exhaustive")
    if not isinstance(test_values, DataFrame):
        return _tag(df, F.col(col).isin(list(test_values)))
    held_out = test_values.select(F.col(test_values.columns[0]).alias("_g")).distinct()
    return (_tag(df.join(held_out, F.col(col) == F.col("_g"), "left"), F.col("_g").isNotNull()).drop("_g"))


def apply_split(views: dict[str, DataFrame], split: DataFrame) -> dict[str, DataFrame]:
    """One split table reused for every representation."""
    return {name: view.join(split.select("row_id", "split"), "row_id") for name, view in views.items()}


def labelled_set(df: DataFrame, label: str = "yield", zero_is_known: bool = False) -> DataFrame:
    """Rows with a known label. A measured 0 counts as unknown unless asked otherwise."""
    y = F.col(label)
    return df.where((y >= 0 if zero_is_known else y > 0) & ~F.isnan(y))


def split_ordered(df: DataFrame, test_size: float = 0.95) -> DataFrame:
    """Unshuffled hold-out of the tail: the last ceil(n * size) rows by id are test."""
    return _tag(df, ~first_n_by(df, lambda n: n - math.ceil(n * test_size), F.col("row_id")))


def union_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both splits stacked; the test ids, in their order and distances, follow the largest train id, so no id comes twice."""
    last, first = train.agg(F.max("row_id")).first()[0], test.agg(F.min("row_id")).first()[0]
    offset = 0 if last is None or first is None else last + 1 - first
    return (train.withColumn("split", F.lit("train"))
            .unionByName(test.withColumn("row_id", F.col("row_id") + F.lit(offset)).withColumn("split", F.lit("test"))))


# --- the active set: a table (row_id, status) ------------------------------------------------------

def _status(ids: DataFrame, is_labelled: Column) -> DataFrame:
    return ids.select("row_id", F.when(is_labelled, "labelled").otherwise("unlabelled").alias("status"))


def active_init(df: DataFrame, init: float, seed: int, existing: DataFrame | None = None) -> DataFrame:
    """Start sets by count, by fraction (< 1), or all (-1). With `existing` ids: those plus `init` new rows."""
    ids = df.select("row_id")
    if existing is not None:
        known = existing.select("row_id").distinct().withColumn("_known", F.lit(True))
        rest = ids.join(known, "row_id", "left_anti")
        is_known = F.coalesce("_known", F.lit(False))
        return _status(ids.join(known, "row_id", "left"), is_known | random_n(rest, int(init), seed))
    size = (lambda n: n) if init == -1 else (lambda n: round(init * n)) if init < 1.0 else round(init)
    return _status(ids, random_n(ids, size, seed))


def active_move(status: DataFrame, ids: DataFrame, is_global: bool = True) -> DataFrame:
    """Move rows to the labelled set by row id, or by position among the unlabelled rows."""
    moved = ids.select(F.col("row_id")).distinct()
    if not is_global:
        waiting = exact_rank(status.where(F.col("status") == "unlabelled"), F.col("row_id"), out="local_id")
        moved = waiting.join(moved.withColumnRenamed("row_id", "local_id"), "local_id").select("row_id")
    return _status(status.join(moved.withColumn("_moved", F.lit(True)), "row_id", "left"),
                   F.coalesce("_moved", F.lit(False)) | (F.col("status") == "labelled"))


def active_uniform(status: DataFrame, n: int, seed: int) -> DataFrame:
    """Move min(n, remaining) random unlabelled rows to the labelled set."""
    waiting = status.where(F.col("status") == "unlabelled")
    return _status(status, random_n(waiting, n, seed) | (F.col("status") == "labelled"))


def active_counts(status: DataFrame) -> DataFrame:
    return status.agg(F.count_if(F.col("status") == "labelled").alias("n_labelled"),
                      F.count_if(F.col("status") == "unlabelled").alias("n_unlabelled"))
