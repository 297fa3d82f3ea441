"""Registered queries: label clusters, soft targets, predictions, metrics, plot data."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bins, evaluate, reduce, targets
from ..operators.splits import labelled_set
from .bindings import (GIVEN_PRED, POINTS, REACTIONS, STARTED, VIEWS, given_pred, hash_sql, points, reactions, started_points,
                       table, views)

Q, SQL = {}, {}


def query(name, sql=None):
    def register(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


CENTROIDS = [35.0, 45.0, 55.0, 65.0]
POINT_CENTROIDS = [12.0, 37.0, 63.0, 88.0]


# --- E: targets ------------------------------------------------------------------------------------

def labelled_reactions(spark, sf):
    return labelled_set(reactions(spark, sf)).select("row_id", F.col("yield").alias("y"))


@query("e1_adaptive_label_kmeans")
def e1(spark, sf):
    known = labelled_reactions(spark, sf)
    found = targets.adaptive_label_kmeans(known, 5)
    rows = targets.representatives(known, found.centroids)
    return rows.select("row_id", "y", F.lit(found.max_span).alias("max_span"), F.lit(found.min_span).alias("min_span"),
                       F.lit(len(found.centroids)).alias("n_clusters"))


@query("e1_spans_recomputed", f"""
WITH {REACTIONS} SELECT count(*) AS n_rows, true AS spans_agree, true AS no_empty_cluster FROM reactions WHERE yield > 0""")
def e1_spans(spark, sf):
    """The spans of the fitted clusters, from each label's nearest centroid."""
    known = labelled_reactions(spark, sf)
    found = targets.adaptive_label_kmeans(known, 5)
    near = F.array_min(F.array(*[F.struct(F.abs(F.col("y") - c).alias("d"), F.lit(i).alias("cluster")) for i, c in enumerate(found.centroids)]))
    assigned = known.select("y", near["cluster"].alias("cluster"))
    spans = assigned.groupBy("cluster").agg(F.count("*").alias("n"), (F.max("y") - F.min("y")).alias("span"))
    agree = (F.abs(F.max("span") - found.max_span) < 1e-9) & (F.abs(F.min("span") - found.min_span) < 1e-9)
    return spans.agg(F.sum("n").alias("n_rows"), agree.alias("spans_agree"), (F.count("*") == len(found.centroids)).alias("no_empty_cluster"))


_KNOWN = f"WITH {REACTIONS}, known AS (SELECT row_id, yield AS y FROM reactions WHERE yield > 0)"
_FOUR_CLUSTERS = _KNOWN + """, v AS (
  SELECT y, CAST(count(*) AS DOUBLE) AS w, row_number() OVER (ORDER BY y) AS i FROM known GROUP BY y),
pre AS (
  SELECT i, sum(w) OVER (ORDER BY i) AS w, sum(w * (y - 50)) OVER (ORDER BY i) AS s, sum(w * (y - 50) * (y - 50)) OVER (ORDER BY i) AS q FROM v
  UNION ALL SELECT 0, 0, 0, 0),
seg AS (
  SELECT a.i + 1 AS i, b.i AS j, b.q - a.q - (b.s - a.s) * (b.s - a.s) / (b.w - a.w) AS cost, 50 + (b.s - a.s) / (b.w - a.w) AS centroid
  FROM pre a JOIN pre b ON a.i < b.i),
l1 AS (SELECT j, cost, i FROM seg WHERE i = 1)""" + "".join(f""",
l{k} AS (SELECT s.j, min(l.cost + s.cost) AS cost, arg_min(s.i, l.cost + s.cost) AS i FROM seg s JOIN l{k - 1} l ON l.j = s.i - 1 GROUP BY s.j)""" for k in (2, 3, 4)) + """,
c4 AS (SELECT i, j FROM l4 WHERE j = (SELECT max(i) FROM v)), c3 AS (SELECT l3.i, l3.j FROM l3 JOIN c4 ON l3.j = c4.i - 1),
c2 AS (SELECT l2.i, l2.j FROM l2 JOIN c3 ON l2.j = c3.i - 1), c1 AS (SELECT l1.i, l1.j FROM l1 JOIN c2 ON l1.j = c2.i - 1)"""


@query("e1_label_clusters", _FOUR_CLUSTERS + "".join(f"""
{'UNION ALL ' if k else ''}SELECT {k} AS cluster, round(centroid, 6) AS centroid FROM c{k + 1} c JOIN seg s ON s.i = c.i AND s.j = c.j""" for k in range(4)))
def e1_clusters(spark, sf):
    """The four clusters of least squared distance, exactly."""
    found = targets.LabelSegmentation(labelled_reactions(spark, sf), "y").clusters(4)
    return spark.createDataFrame([(k, round(c, 6)) for k, c in enumerate(found.centroids)], "cluster int, centroid double")


_REPS = _KNOWN + """, reps AS (
  SELECT centroid_no, arg_min(row_id, (abs(y - centroid), row_id)) AS row_id
  FROM known CROSS JOIN (SELECT unnest([35.0::DOUBLE, 45, 55, 65]) AS centroid, unnest(range(4)) AS centroid_no) c
  GROUP BY centroid_no)"""


@query("e2_representatives", _REPS + """
SELECT CAST(centroid_no AS INTEGER) AS centroid_no, r.row_id, y FROM reps r JOIN known k ON r.row_id = k.row_id""")
def e2(spark, sf):
    return targets.representatives(labelled_reactions(spark, sf), CENTROIDS)


@query("e3_cluster_spans", _KNOWN + """, assigned AS (
  SELECT y, CASE WHEN y < 40 THEN 0 WHEN y < 50 THEN 1 WHEN y < 60 THEN 2 ELSE 3 END AS cluster FROM known),
spans AS (SELECT max(y) - min(y) AS span FROM assigned GROUP BY cluster)
SELECT max(span) AS max_span, min(span) AS min_span FROM spans""")
def e3(spark, sf):
    y = F.col("y")
    nearest = F.when(y < 40, 0).when(y < 50, 1).when(y < 60, 2).otherwise(3)
    return targets.cluster_spans(labelled_reactions(spark, sf).withColumn("cluster", nearest))


@query("e4_soft_targets", _REPS + """,
w AS (SELECT k.row_id, centroid_no, greatest(2 - (k.y - c.y) * (k.y - c.y) / 100, 0.0001::DOUBLE) AS w
      FROM known k CROSS JOIN (SELECT r.centroid_no, k2.y FROM reps r JOIN known k2 ON r.row_id = k2.row_id) c)
SELECT row_id, centroid_no AS cluster, round(w / sum(w) OVER (PARTITION BY row_id), 9) AS weight FROM w""")
def e4(spark, sf):
    known = labelled_reactions(spark, sf)
    reps = [r["y"] for r in targets.representatives(known, CENTROIDS).orderBy("centroid_no").collect()]
    return (targets.soft_targets(known, reps).select("row_id", F.posexplode("target").alias("c", "w"))
            .select("row_id", F.col("c").cast("bigint").alias("cluster"), F.round("w", 9).alias("weight")))


def point_representatives(spark, sf) -> list[int]:
    """Representatives among the labelled points: one per fixed centroid."""
    known = labelled_set(started_points(spark, sf).where("labelled"), "y")
    return [r["row_id"] for r in targets.representatives(known, POINT_CENTROIDS).orderBy("centroid_no").collect()]


def assigned_views(spark, sf) -> DataFrame:
    """(row_id, q0, q1): Student-t assignment of both views to the representatives."""
    ids = point_representatives(spark, sf)
    out = []
    for name, view in zip(("q0", "q1"), views(spark, sf)):
        rows = {r["row_id"]: r["features"] for r in view.where(F.col("row_id").isin(ids)).select("row_id", "features").collect()}
        out.append(view.select("row_id", targets.assign_t("features", [rows[i] for i in ids]).alias(name)))
    return out[0].join(out[1], "row_id")


_POINT_REPS = VIEWS + ", " + STARTED.replace(POINTS + ", ", "") + """, reps AS (
  SELECT centroid_no, arg_min(p.row_id, (abs(y - centroid), p.row_id)) AS rep
  FROM points p JOIN started s ON p.row_id = s.row_id
  CROSS JOIN (SELECT unnest([12.0::DOUBLE, 37, 63, 88]) AS centroid, unnest(range(4)) AS centroid_no) c
  WHERE y > 0 GROUP BY centroid_no),
n0 AS (SELECT v.row_id, centroid_no, 1 / (1 + pow(list_distance(v.features, r.features), 2)) AS n
       FROM view_0 v CROSS JOIN reps JOIN view_0 r ON r.row_id = rep),
n1 AS (SELECT v.row_id, centroid_no, 1 / (1 + pow(list_distance(v.features, r.features), 2)) AS n
       FROM view_1 v CROSS JOIN reps JOIN view_1 r ON r.row_id = rep),
q AS (SELECT a.row_id, a.centroid_no, a.n / sum(a.n) OVER (PARTITION BY a.row_id) AS q0,
             b.n / sum(b.n) OVER (PARTITION BY b.row_id) AS q1
      FROM n0 a JOIN n1 b ON a.row_id = b.row_id AND a.centroid_no = b.centroid_no)"""


@query("e5_assign_t", f"WITH {_POINT_REPS} SELECT row_id, centroid_no AS cluster, round(q0, 9) AS q0, round(q1, 9) AS q1 FROM q")
def e5(spark, sf):
    return (assigned_views(spark, sf).select("row_id", F.posexplode(F.arrays_zip("q0", "q1")).alias("c", "q"))
            .select("row_id", F.col("c").cast("bigint").alias("cluster"), F.round("q.q0", 9).alias("q0"), F.round("q.q1", 9).alias("q1")))


@query("e6_sharpen", f"""
WITH {_POINT_REPS} SELECT row_id, centroid_no AS cluster,
  round(q0 * q0 / sum(q0 * q0) OVER (PARTITION BY row_id), 9) AS sharp FROM q""")
def e6(spark, sf):
    return (assigned_views(spark, sf).select("row_id", F.posexplode(targets.sharpen("q0")).alias("c", "s"))
            .select("row_id", F.col("c").cast("bigint").alias("cluster"), F.round("s", 9).alias("sharp")))


@query("e7_kl_sum", f"""
WITH {_POINT_REPS},
rep_y AS (SELECT centroid_no, y FROM reps JOIN points p ON p.row_id = rep),
w AS (SELECT p.row_id, centroid_no, greatest(2 - (p.y - r.y) * (p.y - r.y) / 100, 0.0001::DOUBLE) AS w
      FROM points p JOIN started s ON p.row_id = s.row_id CROSS JOIN rep_y r WHERE p.y > 0),
t AS (SELECT row_id, centroid_no, w / sum(w) OVER (PARTITION BY row_id) AS t FROM w)
SELECT round(sum(coalesce(t * (ln(t) - ln(q0)), 0) + q1 * (ln(q1) - ln(q0))), 6) AS loss_0,
       round(sum(coalesce(t * (ln(t) - ln(q1)), 0) + q0 * (ln(q0) - ln(q1))), 6) AS loss_1
FROM q LEFT JOIN t ON q.row_id = t.row_id AND q.centroid_no = t.centroid_no""")
def e7(spark, sf):
    known = labelled_set(started_points(spark, sf).where("labelled"), "y")
    reps = [r["y"] for r in targets.representatives(known, POINT_CENTROIDS).orderBy("centroid_no").collect()]
    soft = targets.soft_targets(known, reps).select("row_id", "target")
    losses = targets.kl_sum(assigned_views(spark, sf).join(soft, "row_id", "left"), "target", "q0", "q1")
    return losses.select(F.round("loss_0", 6).alias("loss_0"), F.round("loss_1", 6).alias("loss_1"))


@query("e11_converged", """
WITH steps AS (
  SELECT event_id, event_type AS run, row_number() OVER w AS n, avg(value) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l,
         avg(value) OVER (w ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING) AS p
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT event_id, run, n, coalesce(n >= 20 AND abs(l - p) < l * 0.015, FALSE) AS converged FROM steps""")
def e11(spark, sf):
    losses = table(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("run"), F.col("value").alias("loss"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return targets.converged(losses, step=at, tie="event_id").select("event_id", "run", "n", "converged")


# --- G: prediction and metrics ---------------------------------------------------------------------

@query("g1_fit_predict_rf")
def g1(spark, sf):
    p = started_points(spark, sf)
    return evaluate.fit_predict_rf(p, F.col("labelled") & (F.col("y") > 0), seed=1).select("row_id", "y", "pred")


@query("g1_prediction_bounds", f"WITH {POINTS} SELECT row_id, true AS within_labels FROM points")
def g1_bounds(spark, sf):
    """A forest predicts every row, inside the range of the labels it was fitted on."""
    p = started_points(spark, sf).withColumn("fitted", F.col("labelled") & (F.col("y") > 0))
    ends = p.where("fitted").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    return (evaluate.fit_predict_rf(p, F.col("fitted"), seed=1, trees=20)
            .select("row_id", F.col("pred").between(ends["lo"] - 1e-9, ends["hi"] + 1e-9).alias("within_labels")))


_METRICS = """round(CASE WHEN min(y) < max(y) THEN 1 - sum((y - pred) * (y - pred)) / (count(*) * var_pop(y)) END, 6) AS r2,
  round(avg(abs(y - pred)), 6) AS mae, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse"""


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("g2_regression_metrics", f"WITH {GIVEN_PRED} SELECT {_METRICS} FROM given_pred")
def g2(spark, sf):
    return _rounded(evaluate.regression_metrics(given_pred(spark, sf)), "r2", "mae", "rmse")


_RATIOS = "(SELECT unnest([0.05::DOUBLE, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50]) AS ratio)"
_TOP_MAE = f"""top AS (
  SELECT ratio, CAST(floor(n * ratio) AS BIGINT) AS k, avg(abs(y - pred)) FILTER (rn <= floor(n * ratio)) AS mae
  FROM (SELECT *, row_number() OVER (ORDER BY y DESC, row_id) AS rn, count(*) OVER () AS n FROM given_pred) g
  CROSS JOIN {_RATIOS} r GROUP BY ratio, n)"""
_CONFUSION = f"""cuts AS (
  SELECT ratio, y AS threshold
  FROM (SELECT y, row_number() OVER (ORDER BY y, row_id) - 1 AS pos, count(*) OVER () AS n FROM given_pred) g
  JOIN {_RATIOS} r ON pos = floor(ratio * n)),
counts AS (
  SELECT ratio, threshold, count(*) FILTER (y > threshold AND pred > threshold) AS tp,
         count(*) FILTER (y < threshold AND pred < threshold) AS tn,
         count(*) FILTER (y > threshold AND pred < threshold) AS fn,
         count(*) FILTER (y < threshold AND pred > threshold) AS fp
  FROM given_pred CROSS JOIN cuts GROUP BY ratio, threshold),
scored AS (SELECT *, CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END AS f1
           FROM counts)"""


@query("g3_top_ratio_mae", f"WITH {GIVEN_PRED}, {_TOP_MAE} SELECT ratio, k, round(mae, 6) AS mae FROM top")
def g3(spark, sf):
    return _rounded(evaluate.top_ratio_mae(given_pred(spark, sf)), "mae")


@query("g4_rank_threshold_confusion", f"""
WITH {GIVEN_PRED}, {_CONFUSION} SELECT ratio, threshold, tp, tn, fn, fp, round(f1, 6) AS f1 FROM scored""")
def g4(spark, sf):
    return _rounded(evaluate.rank_threshold_confusion(given_pred(spark, sf)), "f1")


_GIVEN_VIEWS = GIVEN_PRED + """, preds AS (
  SELECT 'view_' || v AS view, kind, 1 AS round, row_id, y, pred + v - k AS pred
  FROM given_pred CROSS JOIN (SELECT unnest([0.0::DOUBLE, 1]) AS d, unnest([0, 1]) AS v) a
  CROSS JOIN (SELECT unnest(['original', 'encoded', 'cluster']) AS kind, unnest([0.0::DOUBLE, 1, 2]) AS k) b)"""


def given_views(spark, sf):
    """The given predictions, shifted per view and kind of features."""
    cases = [F.struct(F.lit(f"view_{v}").alias("view"), F.lit(kind).alias("kind"), F.lit(float(v - k)).alias("shift"))
             for v in (0, 1) for k, kind in enumerate(("original", "encoded", "cluster"))]
    return (given_pred(spark, sf).withColumn("c", F.explode(F.array(*cases)))
            .select("c.view", "c.kind", F.lit(1).alias("round"), "row_id", "y", (F.col("pred") + F.col("c.shift")).alias("pred")))


@query("g5_evaluate_representations", f"WITH {_GIVEN_VIEWS} SELECT view, kind, {_METRICS} FROM preds GROUP BY view, kind")
def g5(spark, sf):
    return _rounded(evaluate.evaluate_representations(given_views(spark, sf)), "r2", "mae", "rmse")


_RATIO_LIST = ", ".join(f"{r}::DOUBLE" for r in evaluate.RATIOS)


@query("g5_representation_report", f"""
WITH {_GIVEN_VIEWS}, ranked AS (
  SELECT view, kind, y, pred, count(*) OVER (PARTITION BY view, kind) AS n,
         row_number() OVER (PARTITION BY view, kind ORDER BY y, row_id) - 1 AS up,
         row_number() OVER (PARTITION BY view, kind ORDER BY y DESC, row_id) - 1 AS down FROM preds),
cuts AS (
  SELECT view, kind, ratio, CAST(floor(min(n) * ratio) AS BIGINT) AS k, max(y) FILTER (WHERE up = floor(n * ratio)) AS threshold,
         avg(abs(y - pred)) FILTER (WHERE down < floor(n * ratio)) AS top_mae
  FROM ranked CROSS JOIN (SELECT unnest([{_RATIO_LIST}]) AS ratio) r GROUP BY view, kind, ratio),
counts AS (
  SELECT c.view, c.kind, c.ratio, any_value(k) AS k, any_value(threshold) AS threshold, any_value(top_mae) AS top_mae,
         count(*) FILTER (WHERE y > threshold AND pred > threshold) AS tp, count(*) FILTER (WHERE y < threshold AND pred < threshold) AS tn,
         count(*) FILTER (WHERE y > threshold AND pred < threshold) AS fn, count(*) FILTER (WHERE y < threshold AND pred > threshold) AS fp
  FROM preds p JOIN cuts c ON p.view = c.view AND p.kind = c.kind GROUP BY c.view, c.kind, c.ratio),
metrics AS (SELECT view, kind, {_METRICS} FROM preds GROUP BY view, kind)
SELECT c.view, c.kind, ratio, k, threshold, round(top_mae, 6) AS top_mae, tp, tn, fn, fp,
       CASE WHEN tp > 0 THEN round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) END AS f1, r2, mae, rmse
FROM counts c JOIN metrics m ON c.view = m.view AND c.kind = m.kind""")
def g5_report(spark, sf):
    return _rounded(evaluate.representation_report(given_views(spark, sf)), "top_mae", "f1", "r2", "mae", "rmse")


_SERIES = [f"view_{v}_{kind}_1" for v in (0, 1) for kind in ("original", "encoded", "cluster")]


@query("g6_prediction_matrix", f"WITH {_GIVEN_VIEWS} SELECT row_id, " + ", ".join(
    f"max(pred) FILTER (view || '_' || kind || '_' || round = '{s}') AS {s}" for s in _SERIES) + " FROM preds GROUP BY row_id")
def g6(spark, sf):
    return evaluate.prediction_matrix(given_views(spark, sf), _SERIES)


@query("g7_error_curve", f"""
WITH {GIVEN_PRED}, {_TOP_MAE}, {_CONFUSION}
SELECT t.ratio, round(mae, 6) AS mae, round(1 / f1, 6) AS inverse_f1 FROM top t JOIN scored s ON t.ratio = s.ratio""")
def g7(spark, sf):
    return _rounded(evaluate.error_curve(given_pred(spark, sf)), "mae", "inverse_f1")


@query("g8_threshold_models")
def g8(spark, sf):
    p = points(spark, sf)
    models = evaluate.threshold_models(p, [20.0, 50.0, 80.0])
    return evaluate.apply_threshold_models(p, models)


@query("g8_decisions", f"""
WITH {POINTS} SELECT row_id, boundary, CASE WHEN y > boundary THEN 1 ELSE 0 END AS above
FROM points CROSS JOIN (SELECT unnest([30.0::DOUBLE, 60]) AS boundary) b""")
def g8_decisions(spark, sf):
    """Labels that the features separate are decided without an error."""
    p = points(spark, sf).withColumn("features", F.array("y", F.col("features")[0]))
    return evaluate.apply_threshold_models(p, evaluate.threshold_models(p, [30.0, 60.0])).select("row_id", "boundary", "above")


@query("g1_single_tree", f"WITH {POINTS} SELECT row_id, round(y, 9) AS pred FROM points")
def g1_single_tree(spark, sf):
    """A forest of one tree, which sees every row, gives back labels that a feature tells apart."""
    p = points(spark, sf).withColumn("features", F.array(F.col("features")[0] * 0, "y"))
    return evaluate.fit_predict_rf(p, F.lit(True), "features", "y", 1, 1).select("row_id", F.round("pred", 9).alias("pred"))


# --- I: plot data ----------------------------------------------------------------------------------

_PLANE = POINTS + ", plane AS (SELECT row_id, features[1] AS x, features[2] AS y, y AS value FROM points)"


def plane(spark, sf):
    return points(spark, sf).select("row_id", F.col("features")[0].alias("x"), F.col("features")[1].alias("y"), F.col("y").alias("value"))


@query("i1_hexbin", f"""
WITH {_PLANE}, ends AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM plane),
unit AS (SELECT value, (x - x0) / (x1 - x0) * 50 AS u, (y - y0) / (y1 - y0) * {int(50 / math.sqrt(3))} AS v FROM plane CROSS JOIN ends),
placed AS (SELECT *, pow(u - round_even(u, 0), 2) + 3 * pow(v - round_even(v, 0), 2)
                  < pow(u - floor(u) - 0.5, 2) + 3 * pow(v - floor(v) - 0.5, 2) AS a FROM unit)
SELECT CASE WHEN a THEN 0 ELSE 1 END AS lattice, CAST(CASE WHEN a THEN round_even(u, 0) ELSE floor(u) END AS BIGINT) AS i,
       CAST(CASE WHEN a THEN round_even(v, 0) ELSE floor(v) END AS BIGINT) AS j, round(avg(value), 6) AS mean, count(*) AS n
FROM placed GROUP BY 1, 2, 3""")
def i1(spark, sf):
    return _rounded(bins.hexbin(plane(spark, sf)), "mean")


@query("i1_projection")
def i1_projection(spark, sf):
    """Hexagon means of the plane that the first two SVD components of all dimensions span."""
    p = points(spark, sf)
    flat = reduce.fit_svd(p, 2).transform(p)
    return _rounded(bins.hexbin(flat.select("row_id", F.col("features")[0].alias("x"), F.col("features")[1].alias("y"), F.col("y").alias("value"))), "mean")


@query("i2_extent", f"""
WITH {_PLANE} SELECT min(x) - 1 AS min_x, max(x) + 1 AS max_x, min(y) - 1 AS min_y, max(y) + 1 AS max_y FROM plane""")
def i2(spark, sf):
    return bins.extent(plane(spark, sf))


@query("i3_jitter", f"""
WITH {_PLANE} SELECT row_id, x + ({hash_sql('row_id', '9-x')} / 4294967296.0::DOUBLE * 1.0::DOUBLE - 0.5::DOUBLE) AS x,
  y + ({hash_sql('row_id', '9-y')} / 4294967296.0::DOUBLE * 1.0::DOUBLE - 0.5::DOUBLE) AS y FROM plane""")
def i3(spark, sf):
    return bins.jitter(plane(spark, sf), seed=9).select("row_id", "x", "y")
