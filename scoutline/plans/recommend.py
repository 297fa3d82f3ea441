"""Choosing the next batch by name of the rule."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import coverage


def _entropy(df: DataFrame, batch: int, delta: float, bonus: Column) -> DataFrame:
    top = coverage.top_entropy(df.withColumn("score", bonus), batch)
    # The batch is a handful of rows, so numbering it needs no partitioning.
    place = F.row_number().over(Window.orderBy(F.desc("score"), "row_id")).cast("bigint")
    return top.select(place.alias("pick"), "row_id")


def _prob(df: DataFrame, batch: int, delta: float, bonus: Column) -> DataFrame:
    return coverage.greedy_cover(df, delta, batch).select("pick", "row_id")


def _mix(df: DataFrame, batch: int, delta: float, bonus: Column) -> DataFrame:
    return coverage.mixed_cover(df, delta, batch, bonus).select("pick", "row_id")


METHODS = {"prob": _prob, "20prob": _prob, "mix": _mix, "entropy": _entropy}


def recommend(df: DataFrame, method: str, batch: int, delta: float, bonus: Column | None = None) -> DataFrame:
    """(pick, row_id) of the next batch from (row_id, features, labelled). `bonus` is the entropy column.

    METHODS is the plug point: any function of the same signature can be added.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, known: {sorted(METHODS)}")
    return METHODS[method](df, batch, delta, bonus)


def trim(picks: DataFrame, batch: int) -> DataFrame:
    """At most `batch` picks, with a warning when there are fewer."""
    have = picks.count()
    if have < batch:
        warnings.warn(f"{have} suggestions for a batch of {batch}")
    return picks.where(F.col("pick") <= batch)
