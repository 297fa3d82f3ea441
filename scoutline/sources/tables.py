"""Reading and writing reaction tables, feature views, predictions, metrics, histories and snapshots."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.space import select_rows
from .nested import json_elements, write_json_documents

VIEW_SCHEMA = ("row_id BIGINT, features ARRAY<DOUBLE>, label DOUBLE, dataset STRING, representation STRING, "
               "dim INT, split_mode INT, tag STRING")
VIEW_KEYS = ["dataset", "representation", "dim", "split_mode", "tag"]


def read_reactions(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A reaction table with a declared schema; csv files have a header row."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def write_view(df: DataFrame, root: str, dataset: str, representation: str, dim: int | None, split_mode: int | None,
               tag_col: str = "split") -> None:
    """Save (row_id, features, label) below one folder per data set, representation and split or other tag.

    Only the partitions written are replaced, so a repeated write leaves one copy.
    """
    keyed = df.select("row_id", "features", "label", F.lit(dataset).alias("dataset"), F.lit(representation).alias("representation"),
                      F.lit(dim).cast("int").alias("dim"), F.lit(split_mode).cast("int").alias("split_mode"), F.col(tag_col).alias("tag"))
    keyed.write.partitionBy(*VIEW_KEYS).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)


def read_view(spark: SparkSession, root: str, dataset: str, representation: str, dim: int | None = None,
              split_mode: int | None = None, tag: str | None = None) -> DataFrame:
    """One stored view. All conditions are on partition columns, so other folders are not opened."""
    want = {"dataset": dataset, "representation": representation, "dim": dim, "split_mode": split_mode}
    view = spark.read.schema(VIEW_SCHEMA).parquet(root)
    for col, value in want.items():
        view = view.where(F.col(col).isNull() if value is None else F.col(col) == value)
    if tag is not None:
        view = view.where(F.col("tag") == tag)
    return view.select("row_id", "features", "label", "tag")


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One prediction per row, with the row id that says which."""
    df.select("row_id", "pred").write.mode("overwrite").option("header", True).format(fmt).save(path)


def append_metrics(df: DataFrame, path: str, batch: str | int | None = None) -> None:
    """One or more metric records at the end of the log. With the id of a round or batch a repeated call replaces its records."""
    _append(df, path, batch)


def _append(df: DataFrame, path: str, batch: str | int | None) -> None:
    if batch is None:
        df.write.mode("append").parquet(path)
    else:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def write_suggestions(space: DataFrame, ids: DataFrame | list[int], path: str, fmt: str = "parquet") -> None:
    """The chosen rows with their ids, in request order; an unknown id is an error."""
    select_rows(space, ids, strict=True).write.mode("overwrite").option("header", True).format(fmt).save(path)


def snapshot(df: DataFrame, root: str, ts: str) -> str:
    """A copy of the table under its time stamp; an existing one is never overwritten."""
    path = f"{root}/version={ts}"
    df.write.mode("errorifexists").parquet(path)
    return path


def history_schema(components: list[str]) -> str:
    fields = ", ".join([f"`{c}`: STRING" for c in components] + ["`Yield`: DOUBLE"])
    return f"date STRING, reaction STRUCT<{fields}>"


def append_history(df: DataFrame, path: str, components: list[str], ts: str | None = None, label: str = "yield",
                   batch: str | int | None = None) -> None:
    """Accepted results as {date, reaction}, one JSON line each. `ts` stamps all rows, else the column `date` does.

    With a `batch` id a repeated call replaces its own lines instead of doubling them.
    """
    date = F.col("date") if ts is None else F.lit(ts)
    reaction = F.struct(*components, F.col(label).alias("Yield"))
    lines = df.select(date.alias("date"), reaction.alias("reaction")).write
    if batch is None:
        lines.mode("append").json(path)
    else:
        lines.mode("overwrite").json(f"{path}/batch={batch}")


def read_history(spark: SparkSession, path: str, components: list[str], nested: bool = False) -> DataFrame:
    """The history as (date, components, Yield); an absent path gives an empty table.

    `nested` reads documents {"iterations": [...]}, each by as many tasks as it has byte ranges; otherwise each line is one iteration.
    """
    schema = history_schema(components)
    try:
        if nested:
            raw = json_elements(spark, path, "iterations").select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("i")).select("i.*")
        else:
            raw = spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.createDataFrame([], schema)
    return raw.select(F.to_timestamp("date", "yyyy-MM-dd HH:mm:ss").alias("ts"), "reaction.*")


def write_nested_history(history: DataFrame, path: str, components: list[str], label: str = "yield") -> None:
    """(date, components, label) as documents {"iterations": [{date, reaction}, ...]}, one per partition."""
    reaction = F.struct(*components, F.col(label).alias("Yield"))
    write_json_documents(history.select(F.to_json(F.struct("date", reaction.alias("reaction"))).alias("json")), path, "iterations")
