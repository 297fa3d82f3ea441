"""Registered queries: sources and sinks, co-training, the loop, the stream."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.session import scratch_path
from ..operators import commit, cotrain, splits, targets
from ..operators.features import align_views
from ..sources import tables
from ..streaming.commit import last_batch, stream_commit, winners
from .bindings import (ACCEPTED, DELTA, GIVEN_PRED, POINTS, REACTIONS, VIEWS, feed, feed_of, given_pred, hash_sql, reactions,
                       started_points, table, views)
from .loop import LoopSettings, _feature_rows, active_loop
from .metric_queries import POINT_CENTROIDS, SQL as METRIC_SQL
from .suggest import suggest

Q, SQL = {}, {}
COMPONENTS = ["c_0", "c_1", "c_2"]


def query(name, sql=None):
    def register(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


# --- A: sources and sinks --------------------------------------------------------------------------

@query("a1_read_reactions", "SELECT p_partkey, p_brand, p_type, p_name, p_retailprice FROM part WHERE p_retailprice > 0")
def a1(spark, sf):
    schema = "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"
    return (tables.read_reactions(spark, f"{sf}/part.parquet", schema)
            .select("p_partkey", "p_brand", "p_type", "p_name", "p_retailprice").where(F.col("p_retailprice") > 0))


@query("a1_read_reactions_csv", f"WITH {REACTIONS} SELECT row_id, c_0, c_1, c_2, yield FROM reactions")
def a1_csv(spark, sf):
    path = scratch_path(spark, "reactions")
    reactions(spark, sf).select("row_id", *COMPONENTS, "yield").write.option("header", True).csv(path)
    return tables.read_reactions(spark, path, "row_id BIGINT, c_0 STRING, c_1 STRING, c_2 STRING, yield DOUBLE", "csv")


def _stored_views(spark, sf):
    root = scratch_path(spark, "views")
    for i, view in enumerate(views(spark, sf)):
        tagged = splits.split_exact(view.withColumnRenamed("y", "label"), 0.2, 31)
        tables.write_view(tagged, root, "points", f"half_{i}", 32, 1)
    return root


_SPLIT_31 = f"""
WITH {POINTS}, ranked AS (
  SELECT *, row_number() OVER (ORDER BY {hash_sql('row_id', 31)}, row_id) AS rn, count(*) OVER () AS n FROM points),
tagged AS (SELECT *, CASE WHEN rn <= CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT) THEN 'test' ELSE 'train' END AS tag
           FROM ranked)"""


@query("a2_read_view", _SPLIT_31 + " SELECT row_id, features[33:64] AS features, y AS label, tag FROM tagged WHERE tag = 'test'")
def a2(spark, sf):
    return tables.read_view(spark, _stored_views(spark, sf), "points", "half_1", 32, 1, "test")


@query("a3_write_view", _SPLIT_31 + """
SELECT 'half_0' AS representation, tag, count(*) AS n, sum(y) AS labels FROM tagged GROUP BY tag
UNION ALL SELECT 'half_1', tag, count(*), sum(y) FROM tagged GROUP BY tag""")
def a3(spark, sf):
    stored = spark.read.schema(tables.VIEW_SCHEMA).parquet(_stored_views(spark, sf))
    return stored.groupBy("representation", "tag").agg(F.count("*").alias("n"), F.sum("label").alias("labels"))


@query("a4_write_predictions", f"WITH {GIVEN_PRED} SELECT row_id, pred FROM given_pred")
def a4(spark, sf):
    path = scratch_path(spark, "predictions")
    tables.write_predictions(given_pred(spark, sf), path, "csv")
    return spark.read.schema("row_id BIGINT, pred DOUBLE").option("header", True).csv(path)


@query("a5_append_metrics", METRIC_SQL["g2_regression_metrics"].replace("SELECT round(CASE", "SELECT unnest([1, 2]) AS round, round(CASE"))
def a5(spark, sf):
    from .metric_queries import Q as metrics
    path = scratch_path(spark, "metrics")
    record = metrics["g2_regression_metrics"](spark, sf)
    for round_no in (1, 2):
        tables.append_metrics(record.withColumn("round", F.lit(round_no)), path)
    return spark.read.schema("r2 DOUBLE, mae DOUBLE, rmse DOUBLE, round INT").parquet(path)


@query("a6_write_suggestions", f"""
WITH {REACTIONS} SELECT s_suppkey AS pos, r.row_id, c_0, c_1, c_2, yield
FROM supplier JOIN reactions r ON r.row_id = s_suppkey""")
def a6(spark, sf):
    path = scratch_path(spark, "suggestions")
    wanted = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_suppkey").alias("row_id"))
    tables.write_suggestions(reactions(spark, sf).select("row_id", *COMPONENTS, "yield"), wanted, path)
    return spark.read.schema("pos BIGINT, row_id BIGINT, c_0 STRING, c_1 STRING, c_2 STRING, yield DOUBLE").parquet(path)


def _stored_history(spark, sf):
    """The accepted measurements with their components, written as history and read back."""
    path = scratch_path(spark, "history")
    known = commit.accepted(feed(spark, sf)).join(reactions(spark, sf).select("row_id", *COMPONENTS), "row_id")
    tables.append_history(known.withColumn("date", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), path, COMPONENTS)
    return tables.read_history(spark, path, COMPONENTS)


_HISTORY = f"""
WITH {REACTIONS}, {ACCEPTED}, history AS (
  SELECT date_trunc('second', ts) AS ts, c_0, c_1, c_2, a.yield FROM accepted a JOIN reactions r ON a.row_id = r.row_id)"""


@query("a7_read_history", _HISTORY + " SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS date, c_0, c_1, c_2, yield FROM history")
def a7(spark, sf):
    return _stored_history(spark, sf).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"), *COMPONENTS,
                                             F.col("Yield").alias("yield"))


@query("a7_read_nested_history", _HISTORY + " SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS date, c_0, c_1, c_2, yield FROM history")
def a7_nested(spark, sf):
    """Documents of nested iterations, written by a few tasks and read by more."""
    path = scratch_path(spark, "nested-history")
    known = commit.accepted(feed(spark, sf)).join(reactions(spark, sf).select("row_id", *COMPONENTS), "row_id")
    tables.write_nested_history(known.withColumn("date", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), path, COMPONENTS)
    return tables.read_history(spark, path, COMPONENTS, nested=True).select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"), *COMPONENTS, F.col("Yield").alias("yield"))


@query("a8_snapshot", f"WITH {REACTIONS} SELECT row_id, c_0, c_1, c_2, yield FROM reactions")
def a8(spark, sf):
    r = reactions(spark, sf).select("row_id", *COMPONENTS, "yield")
    return spark.read.schema(r.schema).parquet(tables.snapshot(r, scratch_path(spark, "snapshots"), "20240101_000000"))


@query("h2_append_history", _HISTORY + " SELECT c_0, count(*) AS n, sum(CAST(round(yield * 100) AS BIGINT))::BIGINT AS cents FROM history GROUP BY c_0")
def h2(spark, sf):
    return _stored_history(spark, sf).groupBy("c_0").agg(F.count("*").alias("n"), F.sum(F.round(F.col("Yield") * 100).cast("bigint")).alias("cents"))


# --- E8-E10: co-training ---------------------------------------------------------------------------

def _trained(spark, sf, epochs):
    v0, v1 = views(spark, sf)
    aligned = align_views(v0, v1)
    known = splits.labelled_set(started_points(spark, sf).where("labelled").select("row_id", "y"), "y")
    reps = targets.representatives(known, POINT_CENTROIDS).orderBy("centroid_no").collect()
    rep_x = [_feature_rows(aligned, [r["row_id"] for r in reps], col) for col in ("x0", "x1")]
    rows = cotrain.training_rows(aligned, targets.soft_targets(known, [r["y"] for r in reps]), len(reps))
    encoders = [cotrain.Encoder.create(32, 64, 16, seed) for seed in (0, 1)]
    encoders, losses = cotrain.cotrain(rows, rep_x, encoders, epochs)
    return aligned, rep_x, encoders, losses


@query("e8_cotrain")
def e8(spark, sf):
    losses = _trained(spark, sf, 10)[3]
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(losses)], "epoch int, loss_0 double, loss_1 double")


@query("e9_encode")
def e9(spark, sf):
    aligned, rep_x, encoders, _ = _trained(spark, sf, 3)
    return cotrain.encode_views(aligned, encoders, rep_x).select("row_id", "z0", "z1")


@query("e10_cluster_view")
def e10(spark, sf):
    aligned, rep_x, encoders, _ = _trained(spark, sf, 3)
    return cotrain.encode_views(aligned, encoders, rep_x).select("row_id", "q0", "q1")


def _given(rows: int, columns: int, step: int) -> np.ndarray:
    """Weights that are easy to state: small multiples of an eighth."""
    return np.array([[((step * i + 5 * j) % 9 - 4) / 8 for j in range(columns)] for i in range(rows)])


GIVEN_ENCODER = cotrain.Encoder(_given(32, 4, 7), _given(1, 4, 1)[0], _given(4, 2, 2), _given(1, 2, 3)[0])
GIVEN_ROWS = _given(3, 32, 4)


def _forward_sql(features: str) -> list[str]:
    """The two outputs of the given network as expressions over an array."""
    e = GIVEN_ENCODER
    hidden = [f"greatest(list_dot_product({features}, {e.w1[:, j].tolist()}::DOUBLE[]) + ({e.b1[j]}), 0)" for j in range(4)]
    return [" + ".join(f"{h} * ({e.w2[j, k]})" for j, h in enumerate(hidden)) + f" + ({e.b2[k]})" for k in range(2)]


_ENCODED = f"WITH {VIEWS}, z AS (SELECT row_id, {_forward_sql('features')[0]} AS z0, {_forward_sql('features')[1]} AS z1 FROM view_0)"


@query("e9_given_weights", _ENCODED + " SELECT row_id, round(z0, 9) AS z0, round(z1, 9) AS z1 FROM z")
def e9_given(spark, sf):
    """Encodings of a network with given weights."""
    z = cotrain.encode(views(spark, sf)[0], GIVEN_ENCODER)
    return z.select("row_id", *[F.round(F.col("z")[k], 9).alias(f"z{k}") for k in (0, 1)])


_CENTRES = "SELECT " + ", ".join(f"{expr} AS c{i}{k}" for i, row in enumerate(GIVEN_ROWS.tolist()) for k, expr in enumerate(_forward_sql(f"{row}::DOUBLE[]")))


@query("e10_given_weights", _ENCODED + f""", c AS ({_CENTRES}),
n AS (SELECT row_id, {', '.join(f'1 / (1 + (z0 - c{i}0) * (z0 - c{i}0) + (z1 - c{i}1) * (z1 - c{i}1)) AS n{i}' for i in range(3))} FROM z CROSS JOIN c)
SELECT row_id, {', '.join(f'round(n{i} / (n0 + n1 + n2), 9) AS q{i}' for i in range(3))} FROM n""")
def e10_given(spark, sf):
    """Cluster assignments against the encodings of given rows."""
    q = cotrain.cluster_view(views(spark, sf)[0], GIVEN_ENCODER, GIVEN_ROWS)
    return q.select("row_id", *[F.round(F.col("q")[k], 9).alias(f"q{k}") for k in range(3)])


def _loop(spark, sf):
    """Three acquiring rounds, from a twentieth of the rows to a tenth: a third of the difference each."""
    n = table(spark, sf, "embeddings").count()
    start, total = n // 20, n // 10
    settings = LoopSettings(start=start, step=-(-(total - start) // 3), total=total, method="entropy", hidden=16, out=8, clusters=8, epochs=2,
                            final_clusters=8, final_epochs=2, trees=5, delta=DELTA, kinds=("encoded",), seed=1)
    return active_loop(*views(spark, sf), settings)


@query("f9_active_loop")
def f9(spark, sf):
    settings = LoopSettings(start=40, step=10, total=50, hidden=64, out=16, clusters=8, epochs=5, final_clusters=8,
                            final_epochs=5, trees=20, seed=1)
    return active_loop(*views(spark, sf), settings)


@query("f9_loop_rounds", """
WITH n AS (SELECT count(*) // 20 AS first, count(*) // 10 AS total FROM embeddings),
steps AS (SELECT first, total, CAST(ceil((total - first) / 3.0) AS BIGINT) AS step FROM n),
rounds AS (SELECT unnest(range(0, 5)) AS round, * FROM steps)
SELECT CAST(round AS INTEGER) AS round, first + round * step AS n_labelled, v.view FROM rounds CROSS JOIN (VALUES ('view_0'), ('view_1')) v(view)
WHERE round = 0 OR first + (round - 1) * step < total""")
def f9_rounds(spark, sf):
    """What each round of a loop of several rounds has labelled, from its metrics."""
    return _loop(spark, sf).select("round", "n_labelled", "view")


@query("f8_suggestion_job", f"""
WITH {REACTIONS}, known AS (SELECT *, yield > 0 AS known FROM reactions)
SELECT c_0, count(*) AS n_rows, count(*) FILTER (known) AS n_known, count(*) AS n_predicted, 0::BIGINT AS n_outside, 0::BIGINT AS n_known_suggested
FROM known GROUP BY c_0""")
def f8_job(spark, sf):
    """Stored predictions and suggestions against the table they were made from: every row is predicted, within the range of
    the known labels, and no known row is suggested."""
    r = reactions(spark, sf).select("row_id", *COMPONENTS, "yield")
    settings = LoopSettings(step=10, hidden=32, out=8, clusters=4, epochs=3, trees=10, seed=2)
    stored = suggest(r, COMPONENTS, scratch_path(spark, "suggest"), settings, n_bits=128, k=16)
    preds = spark.read.schema("row_id BIGINT, pred DOUBLE").parquet(stored.predictions)
    picks = spark.read.schema("pos BIGINT, row_id BIGINT").parquet(stored.suggestions).select("row_id", F.lit(1).alias("suggested"))
    ends = splits.labelled_set(r).agg(F.min("yield").alias("lo"), F.max("yield").alias("hi"))
    lo, hi, known, slack = ends.select("lo").scalar(), ends.select("hi").scalar(), F.col("yield") > 0, 1e-9
    return (r.join(preds, "row_id", "left").join(picks, "row_id", "left").withColumns({"lo": lo, "hi": hi}).groupBy("c_0")
            .agg(F.count("*").alias("n_rows"), F.count_if(known).alias("n_known"), F.count("pred").alias("n_predicted"),
                 F.count_if((F.col("pred") < F.col("lo") - slack) | (F.col("pred") > F.col("hi") + slack)).alias("n_outside"),
                 F.count_if(known & F.col("suggested").isNotNull()).alias("n_known_suggested")))


# --- J: stream -------------------------------------------------------------------------------------

@query("j1_stream_commit", f"""
WITH {REACTIONS}, {ACCEPTED}, last AS (
  SELECT row_id, arg_max(yield, (ts, event_id)) AS new_yield FROM accepted GROUP BY row_id)
SELECT r.row_id, coalesce(new_yield, r.yield) AS yield FROM reactions r LEFT JOIN last l ON r.row_id = l.row_id""")
def j1(spark, sf):
    events = table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    root, keys, seq = scratch_path(spark, "winners"), {"row_id": "bigint"}, {"ts": events.schema["ts"].dataType.simpleString(), "event_id": "bigint"}
    run = stream_commit(feed_of(stream), root, keys, seq, scratch_path(spark, "stream"))
    run.awaitTermination()
    last = winners(spark, root, keys, seq, last_batch(run))
    return commit.apply_history(reactions(spark, sf), last, list(keys), list(seq)).select("row_id", "yield")
