"""Plot data: hexagon means, axis extents and jitter of a 2-D projection."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import portable_uniform


def extent(df: DataFrame, x: str = "x", y: str = "y", pad: float = 1.0) -> DataFrame:
    """Padded limits of both axes."""
    return df.agg((F.min(x) - pad).alias("min_x"), (F.max(x) + pad).alias("max_x"),
                  (F.min(y) - pad).alias("min_y"), (F.max(y) + pad).alias("max_y"))


def hexbin(df: DataFrame, gridsize: int = 50, x: str = "x", y: str = "y", value: str = "value") -> DataFrame:
    """Mean value and row count per hexagon. Two offset lattices; each point goes to the nearer centre."""
    rows = int(gridsize / math.sqrt(3))
    ends = df.agg(F.struct(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).alias("e"))
    work = df.withColumn("_e", ends.scalar())
    unit = lambda v, lo, hi, n: F.coalesce((F.col(v) - F.col(f"_e.{lo}")) / F.nullif(F.col(f"_e.{hi}") - F.col(f"_e.{lo}"), F.lit(0.0)),
                                           F.lit(0.0)) * n
    work = work.withColumns({"_u": unit(x, "x0", "x1", gridsize), "_v": unit(y, "y0", "y1", rows)})
    i1, j1, i2, j2 = F.rint("_u"), F.rint("_v"), F.floor("_u"), F.floor("_v")
    square = lambda c: c * c
    d1 = square(F.col("_u") - i1) + 3 * square(F.col("_v") - j1)
    d2 = square(F.col("_u") - i2 - 0.5) + 3 * square(F.col("_v") - j2 - 0.5)
    first = d1 < d2
    cell = {"lattice": F.when(first, 0).otherwise(1), "i": F.when(first, i1).otherwise(i2).cast("bigint"),
            "j": F.when(first, j1).otherwise(j2).cast("bigint")}
    return work.withColumns(cell).groupBy("lattice", "i", "j").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def jitter(df: DataFrame, a: float = 0.5, seed: int = 0, cols: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Uniform noise within +-a on each axis, a function of the row id."""
    return df.withColumns({c: F.col(c) + (portable_uniform("row_id", f"{seed}-{c}") * (2 * a) - a) for c in cols})
