"""The library's input shapes, derived from the test tables. Each has a DataFrame and an SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.splits import initial_set

DELTA = 1.25  # coverage distance on the test embeddings
START_SEED = 7
START_TEST_RATIO = 0.95


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- reactions: three component columns, full outcome, and the outcome known so far ---------------

REACTIONS = """reactions AS (
  SELECT p_partkey AS row_id, p_brand AS c_0, p_type AS c_1, p_name AS c_2,
         p_size, p_retailprice, coalesce(y, CAST(-1.0 AS DOUBLE)) AS full_y,
         CASE WHEN p_size <= 5 THEN coalesce(y, CAST(-1.0 AS DOUBLE)) ELSE CAST(-1.0 AS DOUBLE) END AS yield
  FROM part LEFT JOIN (
    SELECT l_partkey,
           CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) * CAST(10.0 AS DOUBLE) / count(*) AS y
    FROM lineitem GROUP BY l_partkey) m ON l_partkey = p_partkey)"""


def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = (table(spark, sf_dir, "lineitem").groupBy("l_partkey")
                .agg((F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).cast("double") * 10.0
                      / F.count("*")).alias("y")))
    full = F.coalesce("y", F.lit(-1.0))
    return (table(spark, sf_dir, "part").join(measured, F.col("l_partkey") == F.col("p_partkey"), "left")
            .select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("c_0"),
                    F.col("p_type").alias("c_1"), F.col("p_name").alias("c_2"), "p_size", "p_retailprice",
                    full.alias("full_y"),
                    F.when(F.col("p_size") <= 5, full).otherwise(F.lit(-1.0)).alias("yield")))


GIVEN_PRED = REACTIONS + """, given_pred AS (
  SELECT row_id, full_y AS y, full_y + CAST(p_size % 7 - 3 AS DOUBLE) AS pred FROM reactions)"""


def given_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reactions(spark, sf_dir).select(
        "row_id", F.col("full_y").alias("y"),
        (F.col("full_y") + (F.col("p_size") % 7 - 3).cast("double")).alias("pred"))


# --- points: encoded rows with an outcome ---------------------------------------------------------

POINTS = """points AS (
  SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS features, label * CAST(10.0 AS DOUBLE) AS y
  FROM embeddings)"""

VIEWS = POINTS + """, view_0 AS (SELECT row_id, features[1:32] AS features, y FROM points),
view_1 AS (SELECT row_id, features[33:64] AS features, y FROM points)"""


def hash_sql(col: str, seed) -> str:
    return f"CAST(('0x' || substr(md5(concat({col}, '|{seed}')), 1, 8)) AS BIGINT)"


STARTED = POINTS + f""", started AS (
  SELECT row_id FROM (
    SELECT row_id, row_number() OVER (ORDER BY {hash_sql('row_id', START_SEED)}, row_id) AS rn,
           count(*) OVER () AS n FROM points) ranked
  WHERE rn <= n - CAST(floor(n * CAST({START_TEST_RATIO} AS DOUBLE)) AS BIGINT))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"),
        (F.col("label") * 10.0).alias("y"))


def views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = points(spark, sf_dir)
    return (p.withColumn("features", F.slice("features", 1, 32)),
            p.withColumn("features", F.slice("features", 33, 32)))


def started_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with a `labelled` flag: the start set is a random 5 percent."""
    p = points(spark, sf_dir)
    chosen = initial_set(p, test_ratio=START_TEST_RATIO, seed=START_SEED).select("row_id", F.lit(True).alias("labelled"))
    return p.join(chosen, "row_id", "left").withColumn("labelled", F.coalesce("labelled", F.lit(False)))


# --- feed: measurements as typed in by people -----------------------------------------------------

FEED = """feed AS (
  SELECT event_id, ts, user_id AS row_id,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN '-1'
                         ELSE CAST(value AS VARCHAR) END AS entry
  FROM events)"""

ACCEPTED = FEED + """, accepted AS (
  SELECT event_id, ts, row_id, TRY_CAST(entry AS DOUBLE) AS yield FROM feed
  WHERE TRY_CAST(entry AS DOUBLE) BETWEEN 0 AND 100)"""


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_of(table(spark, sf_dir, "events"))


def feed_of(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "ts", F.col("user_id").alias("row_id"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "-1")
        .otherwise(F.col("value").cast("string")).alias("entry"))
