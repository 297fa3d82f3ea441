"""One large JSON document whose field holds an array of objects, read by many tasks.

The text is cut at every closing brace, which Spark's text source does per byte range of a file. Whether a brace lies in a string,
and how deep it is, depends on all text before it; both are running sums, taken within a byte range and offset by the totals of
the ranges before, one row each. The pieces of an element meet by its number, so a range may end anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.session import cut_lineage

RANGE = ["file", "start"]  # a byte range of a file


def json_elements(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(file, element, json): each object of the array `field`, the only field of each document below `path`.

    An object is as it stands in the file, nested objects and braces in strings included. Another field, or text that closes
    more than it opens, is an error. A document without elements, or an empty file, has no rows.
    """
    text = spark.read.option("lineSep", "}").text(path)
    pieces = cut_lineage(text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                                     F.monotonically_increasing_id().alias("at"), "value"))
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')  # without escapes every quote opens or closes a string
    opened = lambda odd: F.regexp_count(F.array_join(F.filter(parts, lambda _, i: i % 2 == odd), ""), F.lit(r"\{"))
    pieces = pieces.withColumns({"quotes": F.size(parts) - 1, "even": opened(0), "odd": opened(1)})
    pieces = running(pieces, F.col("quotes"), "before", inclusive=False)
    inside, closes = F.col("before") % 2 == 1, (F.col("before") + F.col("quotes")) % 2 == 0
    pieces = pieces.withColumn("closes", closes.cast("int")).withColumn("opens", F.when(inside, F.col("odd")).otherwise(F.col("even")))
    pieces = running(pieces, F.col("opens") - F.col("closes"), "depth", inclusive=True)
    pieces = pieces.withColumn("ends", ((F.col("closes") == 1) & (F.col("depth") == 1)).cast("int"))
    pieces = running(pieces, F.col("ends"), "element", inclusive=False)
    whole = (pieces.groupBy("file", "element")
             .agg(F.max("ends").alias("ends"), F.array_sort(F.collect_list(F.struct("start", "at", "value"))).alias("p"))
             .where("ends = 1").select("file", "element", F.concat(F.array_join("p.value", "}"), F.lit("}")).alias("json")))
    lead = F.when(F.col("element") == 0, F.lit(rf'^\s*\{{\s*"{field}"\s*:\s*\[\s*')).otherwise(F.lit(r"^\s*,\s*"))
    wrong = F.raise_error(F.concat(F.lit(f"not an object of the array {field}: "), F.substring("json", 1, 80)))
    return whole.withColumn("json", F.when(F.regexp_like("json", F.concat(lead, F.lit(r"\{"))), F.regexp_replace("json", lead, F.lit(""))).otherwise(wrong))


def running(pieces: DataFrame, value: Column, out: str, inclusive: bool) -> DataFrame:
    """`pieces` with the sum of `value` over all pieces of the file before a row, or up to it. A window holds one byte range."""
    inner = Window.partitionBy(*RANGE).orderBy("at").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    outer = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    totals = pieces.groupBy(*RANGE).agg(F.sum(value).alias("_sum"))
    offsets = totals.select(*RANGE, F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_offset"))
    here = pieces.withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return here.join(offsets, RANGE).withColumn(out, F.col(out) + F.col("_offset")).drop("_offset")


def write_json_documents(elements: DataFrame, path: str, field: str) -> None:
    """The column `json` of `elements` as documents {field: [...]}, one per partition, streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = lambda texts: pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])
        yield lines([f'{{"{field}": ['])
        mark = ""
        for batch in batches:
            rows = batch.column(0).to_pylist()
            yield lines([(mark if i == 0 else ", ") + r for i, r in enumerate(rows)])
            mark = ", " if rows else mark
        yield lines(["]}"])

    elements.select("json").mapInArrow(run, "value string").write.text(path)
