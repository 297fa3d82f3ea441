"""Registered queries: coverage and acquisition."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from ..functions.arrays import array_sum
from ..operators import coverage
from .bindings import DELTA, POINTS, STARTED, started_points, points
from .metric_queries import _POINT_REPS, assigned_views
from .recommend import recommend, trim

Q, SQL = {}, {}
BATCH = 5


def query(name, sql=None):
    def register(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def _cover_ctes(prefix):
    return prefix + f""", edges AS (
  SELECT a.row_id AS i, b.row_id AS j FROM points a JOIN points b ON list_distance(a.features, b.features) < {DELTA}),
covered0 AS (SELECT DISTINCT j FROM edges WHERE i IN (SELECT row_id FROM started))"""


_COVER = _cover_ctes(STARTED)


def _greedy_sql(n, score="CAST(0 AS DOUBLE)", stop_empty=True, name=""):
    """The greedy rule unrolled: one pick per step, highest score first, lowest id on ties."""
    ctes = []
    for r in range(1, n + 1):
        picked = " UNION ALL ".join(f"SELECT row_id FROM {name}pick{p}" for p in range(1, r)) or "SELECT -1 AS row_id WHERE FALSE"
        ctes.append(f"""{name}done{r} AS (SELECT j FROM covered0 UNION SELECT j FROM edges WHERE i IN ({picked})),
{name}pick{r} AS (
  SELECT p.row_id, count(e.j) AS gain, {score} + count(e.j) AS score
  FROM points p LEFT JOIN (SELECT * FROM edges WHERE j NOT IN (SELECT j FROM {name}done{r})) e ON e.i = p.row_id
  {'JOIN bonus b ON b.row_id = p.row_id' if 'b.' in score else ''}
  WHERE p.row_id NOT IN (SELECT row_id FROM started) AND p.row_id NOT IN ({picked})
  GROUP BY p.row_id{', b.bonus' if 'b.' in score else ''}{' HAVING count(e.j) > 0' if stop_empty else ''}
  ORDER BY score DESC, p.row_id LIMIT 1)""")
    return ",\n".join(ctes)


@query("f1_coverage_radius")
def f1(spark, sf):
    p = points(spark, sf)
    return p.agg(F.count("*").alias("n_rows")).withColumn("radius", F.lit(coverage.coverage_radius(p, 10, seed=1)))


@query("f1_mean_of_cluster_means", f"""
WITH {POINTS}, dims AS (SELECT y, unnest(features) AS v, generate_subscripts(features, 1) AS i FROM points),
centers AS (SELECT y, list(m ORDER BY i) AS c FROM (SELECT y, i, avg(v) AS m FROM dims GROUP BY y, i) d GROUP BY y),
dist AS (SELECT p.y, list_distance(p.features, c) AS d FROM points p JOIN centers k ON p.y = k.y)
SELECT round(avg(m), 9) AS radius FROM (SELECT avg(d) AS m FROM dist GROUP BY y) a""")
def f1_given(spark, sf):
    """The radius over given clusters: the label values."""
    p = points(spark, sf)
    centers = p.groupBy("y").agg(vector_to_array(Summarizer.mean(array_to_vector("features"))).alias("c"))
    square = F.zip_with("features", "c", lambda a, b: (a - b) * (a - b))
    dist = p.join(centers, "y").withColumn("dist", F.sqrt(array_sum(square)))
    return coverage.mean_of_cluster_means(dist, "y").select(F.round("radius", 9).alias("radius"))


@query("f2_neighbors", f"""
WITH {POINTS}, d AS (SELECT min(row_id) AS pid, count(*) AS copies, features FROM points GROUP BY features)
SELECT a.pid AS i, b.pid AS j, b.copies FROM d a JOIN d b ON list_distance(a.features, b.features) < {DELTA}""")
def f2(spark, sf):
    return coverage.neighbors(points(spark, sf), DELTA)


@query("f2_neighbor_counts", f"""
WITH {POINTS} SELECT a.row_id, count(*) AS n_neighbors
FROM points a JOIN points b ON list_distance(a.features, b.features) < {DELTA} GROUP BY a.row_id""")
def f2_counts(spark, sf):
    return coverage.neighbor_counts(points(spark, sf), DELTA)


@query("f3_covered", f"WITH {_COVER} SELECT j AS row_id FROM covered0")
def f3(spark, sf):
    return coverage.covered(started_points(spark, sf), DELTA)


@query("f4_gain", f"""
WITH {_COVER}, g AS (SELECT i, count(*) AS gain FROM edges WHERE j NOT IN (SELECT j FROM covered0) GROUP BY i)
SELECT row_id, CASE WHEN row_id IN (SELECT row_id FROM started) THEN 0 ELSE coalesce(gain, 0) END AS gain
FROM points LEFT JOIN g ON i = row_id""")
def f4(spark, sf):
    return coverage.gain(started_points(spark, sf), DELTA)


@query("f5_greedy_cover", f"WITH {_COVER},\n{_greedy_sql(BATCH)}\n" + " UNION ALL ".join(
    f"SELECT CAST({r} AS BIGINT) AS pick, row_id, gain FROM pick{r}" for r in range(1, BATCH + 1)))
def f5(spark, sf):
    return coverage.greedy_cover(started_points(spark, sf), DELTA, BATCH)


_ENTROPY = _POINT_REPS + """, bonus AS (
  SELECT row_id, -sum(q0 * ln(q0)) - sum(q1 * ln(q1)) AS bonus FROM q GROUP BY row_id)"""


def with_entropy(spark, sf):
    q = assigned_views(spark, sf).select("row_id", coverage.entropy_score("q0", "q1").alias("bonus"))
    return started_points(spark, sf).join(q, "row_id")


@query("f6_entropy_score", f"WITH {_ENTROPY} SELECT row_id, round(bonus, 9) AS score FROM bonus")
def f6(spark, sf):
    return with_entropy(spark, sf).select("row_id", F.round("bonus", 9).alias("score"))


@query("f6_top_entropy", f"""
WITH {_ENTROPY} SELECT row_id, round(bonus, 9) AS score FROM bonus
WHERE row_id NOT IN (SELECT row_id FROM started) ORDER BY bonus DESC, row_id LIMIT 25""")
def f6_top(spark, sf):
    return coverage.top_entropy(with_entropy(spark, sf), 25, "bonus").select("row_id", F.round("bonus", 9).alias("score"))


_MIX = _cover_ctes(_ENTROPY)


@query("f7_mixed_cover", f"WITH {_MIX},\n{_greedy_sql(BATCH, 'b.bonus', False)}\n" + " UNION ALL ".join(
    f"SELECT CAST({r} AS BIGINT) AS pick, row_id, gain, round(score, 9) AS score FROM pick{r}" for r in range(1, BATCH + 1)))
def f7(spark, sf):
    picks = coverage.mixed_cover(with_entropy(spark, sf), DELTA, BATCH, F.col("bonus"))
    return picks.withColumn("score", F.round("score", 9))


_THREE = 3


@query("f8_recommend", f"WITH {_MIX},\n{_greedy_sql(_THREE)},\n{_greedy_sql(_THREE, 'b.bonus', False, 'mix_')},\nentropy AS (SELECT row_id, row_number() OVER (ORDER BY bonus DESC, row_id) AS pick "
       "FROM bonus WHERE row_id NOT IN (SELECT row_id FROM started))\n" + " UNION ALL ".join(
           f"SELECT 'prob' AS method, CAST({r} AS BIGINT) AS pick, row_id FROM pick{r}" for r in range(1, _THREE + 1))
       + "".join(f" UNION ALL SELECT 'mix', CAST({r} AS BIGINT), row_id FROM mix_pick{r}" for r in range(1, _THREE + 1))
       + f" UNION ALL SELECT 'entropy', pick, row_id FROM entropy WHERE pick <= {_THREE}")
def f8(spark, sf):
    df = with_entropy(spark, sf)
    parts = [trim(recommend(df, method, _THREE, DELTA, F.col("bonus")), _THREE).select(F.lit(method).alias("method"), "pick", "row_id")
             for method in ("prob", "mix", "entropy")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
