"""Building the experiment space, masking its labels, and picking rows out of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import portable_hash
from ..functions.selection import consecutive, random_n

UNKNOWN = -1.0


def component(df: DataFrame, col: str) -> DataFrame:
    """The distinct values of a column with their ordinals in alphabetical order, numbered in parallel and written once."""
    values = df.select(F.col(col)).where(F.col(col).isNotNull()).distinct()
    return consecutive(values, col, "ord").select(F.col("ord").cast("bigint"), col)


def build_space(spark: SparkSession, *components: DataFrame) -> DataFrame:
    """Every combination of the components (ord, value); the last component varies fastest.

    The id range is generated in parallel and each id is decoded into one ordinal per component, so the
    product needs equi-joins only, and `row_id` needs no sort.
    """
    sizes = [c.count() for c in components]
    space = spark.range(reduce(lambda a, b: a * b, sizes, 1)).withColumnRenamed("id", "row_id")
    stride, ordinals = 1, {}
    for i in reversed(range(len(components))):
        ordinals[f"_o{i}"] = F.expr(f"(row_id div {stride}) % {sizes[i]}")
        stride *= sizes[i]
    space = space.withColumns(ordinals)
    for i, part in enumerate(components):
        space = space.join(part.withColumnRenamed("ord", f"_o{i}"), f"_o{i}").drop(f"_o{i}")
    values = [c for part in components for c in part.columns if c != "ord"]
    return space.select("row_id", *values)


def seed_labels(df: DataFrame, n: int, seed: int = 42, label: str = "yield") -> DataFrame:
    """Exactly n rows get an integer label from 1 to 100, the others -1."""
    value = (portable_hash("row_id", f"{seed}-label") % 100 + 1).cast("double")
    return df.withColumn(label, F.when(random_n(df, n, seed), value).otherwise(F.lit(UNKNOWN)))


def mask_labels(df: DataFrame, label: str = "yield") -> DataFrame:
    """Labels above 0 stay; everything else, null and NaN included, becomes -1."""
    if label not in df.columns:
        return df.withColumn(label, F.lit(UNKNOWN))
    y = F.col(label)
    return df.withColumn(label, F.when((y > 0) & ~F.isnan(y), y).otherwise(F.lit(UNKNOWN)))


def mask_keep_sample(df: DataFrame, n: int, lo: float = 0, hi: float = 30, seed: int = 0,
                     label: str = "yield") -> DataFrame:
    """Keep n random labels strictly between lo and hi, mask the rest. Fewer eligible rows are an error."""
    eligible = (F.col(label) > lo) & (F.col(label) < hi)
    pool = df.where(eligible)

    def enough(have: int) -> int:
        if have < n:
            raise ValueError(f"only {have} rows with {lo} < {label} < {hi}, {n} asked for")
        return n

    return df.withColumn(label, F.when(eligible & random_n(pool, enough, seed), F.col(label)).otherwise(F.lit(UNKNOWN)))


def compose_reaction(df: DataFrame, parts: list[str], maps: dict[str, DataFrame], product: Column,
                     out: str = "reaction") -> DataFrame:
    """`a.b.c>>product` from component names.

    `parts` lists the columns in order; a column in `maps` is looked up in (name, structure) first. Empty
    parts are left out. A name the map does not know gives a null reaction, not a shortened one.
    """
    work = df
    pieces = []
    for i, col in enumerate(parts):
        if col in maps:
            lookup = maps[col].toDF(f"_n{i}", f"_s{i}")
            work = work.join(lookup, F.col(col) == F.col(f"_n{i}"), "left").drop(f"_n{i}")
            pieces.append(F.col(f"_s{i}"))
        else:
            pieces.append(F.col(col))
    complete = reduce(lambda a, b: a & b, [p.isNotNull() for p in pieces])
    text = F.concat(F.concat_ws(".", *[F.nullif(p, F.lit("")) for p in pieces]), F.lit(">>"), product)
    return (work.withColumn(out, F.when(complete, text))
            .drop(*[f"_s{i}" for i, col in enumerate(parts) if col in maps]))


def select_rows(df: DataFrame, ids: DataFrame | list[int], strict: bool = False) -> DataFrame:
    """Rows by id in request order, with the position in `pos`. Unknown ids are skipped, or an error if strict."""
    if not isinstance(ids, DataFrame):
        ids = df.sparkSession.createDataFrame(list(enumerate(ids)), "pos bigint, row_id bigint")
    if strict:
        missing = ids.join(df.select("row_id"), "row_id", "left_anti").count()
        if missing:
            raise IndexError(f"{missing} ids are not in the table")
    return df.join(ids.select("pos", "row_id"), "row_id").orderBy("pos")


def describe(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Rows and label range, of the whole table or of each split."""
    aggs = [F.count("*").alias("n_rows"), F.min(label).alias("min_label"), F.max(label).alias("max_label")]
    out = df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)
    return out.withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))


def head(df: DataFrame, n: int = 5) -> DataFrame:
    """The first n rows by id."""
    return df.orderBy("row_id").limit(n)


def format_rows(df: DataFrame, cols: list[str], width: int = 30) -> DataFrame:
    """Components cut for display: the first `width` characters and an ellipsis."""
    return df.withColumns({c: F.concat(F.substring(c, 1, width), F.lit("...")) for c in cols})
