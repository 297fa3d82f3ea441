"""Registered queries: space construction, splits, measurement commit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.session import cut_lineage, scratch_path
from ..operators import commit, space, splits
from ..sources import versions
from .bindings import (ACCEPTED, FEED, POINTS, REACTIONS, START_SEED, STARTED, VIEWS, feed, hash_sql, points,
                       reactions, table, views)

Q, SQL = {}, {}


def query(name, sql=None):
    def register(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


# --- B: space --------------------------------------------------------------------------------------

@query("b1_build_space", """
WITH b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS o FROM (SELECT DISTINCT p_brand FROM part) d),
t AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS o FROM (SELECT DISTINCT p_type FROM part) d),
m AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS o FROM (SELECT DISTINCT p_name FROM part) d),
r AS (SELECT r_name, row_number() OVER (ORDER BY r_name) - 1 AS o FROM (SELECT DISTINCT r_name FROM region) d)
SELECT CAST(((b.o * (SELECT count(*) FROM t) + t.o) * (SELECT count(*) FROM m) + m.o) * (SELECT count(*) FROM r) + r.o
            AS BIGINT) AS row_id, p_brand, p_type, p_name, r_name
FROM b CROSS JOIN t CROSS JOIN m CROSS JOIN r""")
def b1(spark, sf):
    part = table(spark, sf, "part")
    return space.build_space(spark, space.component(part, "p_brand"), space.component(part, "p_type"),
                             space.component(part, "p_name"), space.component(table(spark, sf, "region"), "r_name"))


@query("b2_seed_labels", f"""
WITH {REACTIONS}, ranked AS (
  SELECT row_id, row_number() OVER (ORDER BY {hash_sql('row_id', 42)}, row_id) AS rn FROM reactions)
SELECT row_id, CASE WHEN rn <= 15 THEN CAST({hash_sql('row_id', '42-label')} % 100 + 1 AS DOUBLE)
               ELSE CAST(-1.0 AS DOUBLE) END AS yield FROM ranked""")
def b2(spark, sf):
    return space.seed_labels(reactions(spark, sf), 15, 42).select("row_id", "yield")


@query("b3_mask_labels", f"""
WITH {REACTIONS}
SELECT row_id, CASE WHEN yield > 0 THEN yield ELSE CAST(-1.0 AS DOUBLE) END AS yield FROM reactions""")
def b3(spark, sf):
    return space.mask_labels(reactions(spark, sf)).select("row_id", "yield")


@query("b4_mask_keep_sample", f"""
WITH {REACTIONS}, ranked AS (
  SELECT row_id, row_number() OVER (ORDER BY {hash_sql('row_id', 5)}, row_id) AS rn
  FROM reactions WHERE full_y > 0 AND full_y < 50)
SELECT r.row_id, CASE WHEN rn <= 15 THEN full_y ELSE CAST(-1.0 AS DOUBLE) END AS full_y
FROM reactions r LEFT JOIN ranked k ON r.row_id = k.row_id""")
def b4(spark, sf):
    return space.mask_keep_sample(reactions(spark, sf), 15, 0, 50, 5, "full_y").select("row_id", "full_y")


@query("b5_compose_reaction", f"""
WITH {REACTIONS}, halide AS (
  SELECT p_name AS name, CASE WHEN min(p_partkey) % 3 = 0 THEN '' ELSE replace(p_name, ' ', '') END AS structure
  FROM part GROUP BY p_name)
SELECT row_id, concat(concat_ws('.', nullif(c_0, ''), nullif(structure, ''), nullif(c_1, '')), '>>P') AS reaction
FROM reactions JOIN halide ON c_2 = name""")
def b5(spark, sf):
    names = (table(spark, sf, "part").groupBy(F.col("p_name").alias("name"))
             .agg(F.when(F.min("p_partkey") % 3 == 0, "").otherwise(F.replace(F.first("p_name"), F.lit(" "), F.lit("")))
                  .alias("structure")))
    return space.compose_reaction(reactions(spark, sf), ["c_0", "c_2", "c_1"], {"c_2": names},
                                  F.lit("P")).select("row_id", "reaction")


@query("b6_select_rows", f"""
WITH {REACTIONS}, wanted AS (SELECT c_custkey AS pos, CAST(floor(c_acctbal) AS BIGINT) AS row_id FROM customer)
SELECT pos, r.row_id, c_0, c_1, c_2, yield FROM wanted w JOIN reactions r ON r.row_id = w.row_id""")
def b6(spark, sf):
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("pos"),
                                                 F.floor("c_acctbal").cast("bigint").alias("row_id"))
    return space.select_rows(reactions(spark, sf), wanted).select("pos", "row_id", "c_0", "c_1", "c_2", "yield")


@query("b7_describe", f"""
WITH {REACTIONS}, ranked AS (
  SELECT *, row_number() OVER (ORDER BY {hash_sql('row_id', 3)}, row_id) AS rn, count(*) OVER () AS n FROM reactions)
SELECT CASE WHEN rn <= CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT) THEN 'test' ELSE 'train' END AS split,
       count(*) AS n_rows, min(full_y) AS min_label, max(full_y) AS max_label, CAST(9 AS BIGINT) AS n_columns
FROM ranked GROUP BY 1""")
def b7(spark, sf):
    return space.describe(splits.split_exact(reactions(spark, sf), 0.2, 3), "full_y", "split")


@query("b7_head", f"""
WITH {REACTIONS} SELECT row_id, c_0, c_1, c_2, yield FROM reactions ORDER BY row_id LIMIT 10""")
def b7_head(spark, sf):
    return space.head(reactions(spark, sf).select("row_id", "c_0", "c_1", "c_2", "yield"), 10)


@query("b8_format_rows", """
SELECT doc_id AS row_id, concat(substr(text, 1, 30), '...') AS shown, lang FROM documents""")
def b8(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("shown"), "lang")
    return space.format_rows(docs, ["shown"], 30)


# --- D: splits and active set ----------------------------------------------------------------------

def _hash_split(n_test, seed):
    return f"""
WITH {REACTIONS}, ranked AS (
  SELECT row_id, full_y, row_number() OVER (ORDER BY {hash_sql('row_id', seed)}, row_id) AS rn, count(*) OVER () AS n
  FROM reactions)
SELECT row_id, full_y, CASE WHEN rn <= {n_test} THEN {{0}} ELSE {{1}} END AS split FROM ranked"""


@query("d1_split_exact", _hash_split("CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT)", 11).format("'test'", "'train'"))
def d1(spark, sf):
    return splits.split_exact(reactions(spark, sf), 0.2, 11).select("row_id", "full_y", "split")


@query("d2_split_ratio", _hash_split("CAST(round_even(n * CAST(0.8 AS DOUBLE), 0) AS BIGINT)", 12)
       .format("'train'", "'test'"))
def d2(spark, sf):
    return splits.split_ratio(reactions(spark, sf), 0.8, 12).select("row_id", "full_y", "split")


@query("d3_initial_set", f"WITH {STARTED} SELECT p.row_id, y FROM points p JOIN started s ON p.row_id = s.row_id")
def d3(spark, sf):
    return splits.initial_set(points(spark, sf), test_ratio=0.95, seed=START_SEED).select("row_id", "y")


@query("d4_split_by_group", f"""
WITH {REACTIONS}, held AS (SELECT p_type FROM part GROUP BY p_type HAVING avg(p_retailprice) <
  (SELECT avg(p_retailprice) FROM part))
SELECT row_id, c_1, CASE WHEN c_1 IN (SELECT p_type FROM held) THEN 'test' ELSE 'train' END AS split FROM reactions""")
def d4(spark, sf):
    part = table(spark, sf, "part")
    mean = part.agg(F.avg("p_retailprice").alias("m")).scalar()
    held = part.groupBy("p_type").agg(F.avg("p_retailprice").alias("a")).where(F.col("a") < mean).select("p_type")
    return splits.split_by_group(reactions(spark, sf), "c_1", held).select("row_id", "c_1", "split")


@query("d5_apply_split", f"""
WITH {VIEWS}, ranked AS (
  SELECT row_id, row_number() OVER (ORDER BY {hash_sql('row_id', 4)}, row_id) AS rn, count(*) OVER () AS n FROM points),
split AS (SELECT row_id, CASE WHEN rn <= CAST(floor(n * CAST(0.5 AS DOUBLE)) AS BIGINT) THEN 'test' ELSE 'train' END
          AS split FROM ranked)
SELECT 'view_0' AS view, v.row_id, features, split FROM view_0 v JOIN split s ON v.row_id = s.row_id
UNION ALL SELECT 'view_1', v.row_id, features, split FROM view_1 v JOIN split s ON v.row_id = s.row_id""")
def d5(spark, sf):
    v0, v1 = views(spark, sf)
    both = splits.apply_split({"view_0": v0, "view_1": v1}, splits.split_exact(v0, 0.5, 4))
    parts = [v.select(F.lit(name).alias("view"), "row_id", "features", "split") for name, v in both.items()]
    return parts[0].unionByName(parts[1])


@query("d6_labelled_set", f"""
WITH {POINTS} SELECT row_id, y, FALSE AS zero_is_known FROM points WHERE y > 0
UNION ALL SELECT row_id, y, TRUE FROM points WHERE y >= 0""")
def d6(spark, sf):
    p = points(spark, sf)
    return (splits.labelled_set(p, "y").select("row_id", "y", F.lit(False).alias("zero_is_known"))
            .unionByName(splits.labelled_set(p, "y", True).select("row_id", "y", F.lit(True).alias("zero_is_known"))))


_INIT = f"""
WITH {POINTS}, ranked AS (
  SELECT row_id, row_number() OVER (ORDER BY {hash_sql('row_id', 21)}, row_id) AS rn, count(*) OVER () AS n FROM points),
status AS (SELECT row_id, CASE WHEN rn <= CAST(round_even(n * CAST(0.1 AS DOUBLE), 0) AS BIGINT) THEN 'labelled'
                          ELSE 'unlabelled' END AS status FROM ranked)"""


@query("d7_active_init", _INIT + " SELECT row_id, status FROM status")
def d7_init(spark, sf):
    return splits.active_init(points(spark, sf), 0.1, 21)


@query("d7_active_init_existing", f"""
WITH {POINTS}, known AS (SELECT row_id FROM points WHERE y >= 80), ranked AS (
  SELECT row_id, row_number() OVER (ORDER BY {hash_sql('row_id', 22)}, row_id) AS rn
  FROM points WHERE row_id NOT IN (SELECT row_id FROM known))
SELECT p.row_id, CASE WHEN rn IS NULL OR rn <= 30 THEN 'labelled' ELSE 'unlabelled' END AS status
FROM points p LEFT JOIN ranked r ON p.row_id = r.row_id""")
def d7_existing(spark, sf):
    p = points(spark, sf)
    return splits.active_init(p, 30, 22, p.where(F.col("y") >= 80))


@query("d7_active_move_global", _INIT + """
SELECT row_id, CASE WHEN status = 'labelled' OR row_id IN (SELECT row_id FROM points WHERE y = 70)
               THEN 'labelled' ELSE 'unlabelled' END AS status FROM status""")
def d7_move(spark, sf):
    p = points(spark, sf)
    return splits.active_move(splits.active_init(p, 0.1, 21), p.where(F.col("y") == 70))


@query("d7_active_move_local", _INIT + """,
waiting AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS local_id FROM status WHERE status = 'unlabelled'),
moved AS (SELECT row_id FROM waiting WHERE local_id IN (SELECT l_linenumber * l_linenumber FROM lineitem))
SELECT row_id, CASE WHEN status = 'labelled' OR row_id IN (SELECT row_id FROM moved)
               THEN 'labelled' ELSE 'unlabelled' END AS status FROM status""")
def d7_local(spark, sf):
    local = table(spark, sf, "lineitem").select((F.col("l_linenumber") * F.col("l_linenumber")).cast("bigint").alias("row_id"))
    return splits.active_move(splits.active_init(points(spark, sf), 0.1, 21), local, is_global=False)


@query("d7_active_uniform", _INIT + f""",
pool AS (SELECT row_id, row_number() OVER (ORDER BY {hash_sql('row_id', 23)}, row_id) AS rn FROM status
         WHERE status = 'unlabelled')
SELECT s.row_id, CASE WHEN rn IS NULL OR rn <= 40 THEN 'labelled' ELSE 'unlabelled' END AS status
FROM status s LEFT JOIN pool p ON s.row_id = p.row_id""")
def d7_uniform(spark, sf):
    return splits.active_uniform(splits.active_init(points(spark, sf), 0.1, 21), 40, 23)


@query("d7_active_counts", _INIT + """
SELECT count(*) FILTER (status = 'labelled') AS n_labelled, count(*) FILTER (status = 'unlabelled') AS n_unlabelled
FROM status""")
def d7_counts(spark, sf):
    return splits.active_counts(splits.active_init(points(spark, sf), 0.1, 21))


@query("d8_split_ordered", f"""
WITH {REACTIONS}, ranked AS (
  SELECT row_id, full_y, row_number() OVER (ORDER BY row_id) AS rn, count(*) OVER () AS n FROM reactions)
SELECT row_id, full_y, CASE WHEN rn <= n - CAST(ceil(n * CAST(0.95 AS DOUBLE)) AS BIGINT) THEN 'train' ELSE 'test' END
       AS split FROM ranked""")
def d8(spark, sf):
    return splits.split_ordered(reactions(spark, sf), 0.95).select("row_id", "full_y", "split")


@query("d9_union_splits", f"""
WITH {REACTIONS}, low AS (SELECT row_id, c_2, full_y FROM reactions WHERE full_y < 50),
high AS (SELECT row_id, c_2, full_y FROM reactions WHERE full_y >= 50)
SELECT row_id, c_2, full_y, 'train' AS split, true AS id_is_unique FROM low
UNION ALL SELECT row_id + (SELECT max(row_id) FROM low) + 1 - (SELECT min(row_id) FROM high), c_2, full_y, 'test', true FROM high""")
def d9(spark, sf):
    r = reactions(spark, sf).select("row_id", "c_2", "full_y")
    both = splits.union_splits(r.where(F.col("full_y") < 50), r.where(F.col("full_y") >= 50))
    times = both.groupBy("row_id").agg(F.count("*").alias("n"))
    return both.join(times, "row_id").select("row_id", "c_2", "full_y", "split", (F.col("n") == 1).alias("id_is_unique"))


# --- H: measurement commit -------------------------------------------------------------------------

@query("h1_validate_results", f"""
WITH {FEED}
SELECT event_id, row_id, TRY_CAST(entry AS DOUBLE) AS yield,
       CASE WHEN TRY_CAST(entry AS DOUBLE) BETWEEN 0 AND 100 THEN 'accepted'
            WHEN TRY_CAST(entry AS DOUBLE) = -1 THEN 'skipped' ELSE 'rejected' END AS status FROM feed""")
def h1(spark, sf):
    return commit.validate_results(feed(spark, sf)).select("event_id", "row_id", "yield", "status")


@query("h3_apply_history", f"""
WITH {REACTIONS}, {ACCEPTED}, last AS (
  SELECT c_0, c_1, c_2, arg_max(a.yield, (ts, event_id)) AS new_yield
  FROM accepted a JOIN reactions r ON a.row_id = r.row_id GROUP BY c_0, c_1, c_2)
SELECT r.row_id, coalesce(new_yield, r.yield) AS yield
FROM reactions r LEFT JOIN last l ON r.c_0 = l.c_0 AND r.c_1 = l.c_1 AND r.c_2 = l.c_2""")
def h3(spark, sf):
    r = reactions(spark, sf)
    keys = ["c_0", "c_1", "c_2"]
    history = commit.accepted(feed(spark, sf)).join(r.select("row_id", *keys), "row_id")
    return commit.apply_history(r, history, keys, ["ts", "event_id"]).select("row_id", "yield")


@query("h4_commit_by_id", f"""
WITH {REACTIONS}, {FEED}, last AS (
  SELECT row_id, arg_max(v, (ts, event_id)) AS new_yield
  FROM (SELECT row_id, ts, event_id, TRY_CAST(entry AS DOUBLE) AS v FROM feed) e WHERE v >= 0 GROUP BY row_id)
SELECT r.row_id, coalesce(new_yield, r.yield) AS yield FROM reactions r LEFT JOIN last l ON r.row_id = l.row_id""")
def h4(spark, sf):
    edits = commit.validate_results(feed(spark, sf))
    return commit.commit_by_id(reactions(spark, sf), edits, ["ts", "event_id"]).select("row_id", "yield")


@query("h3_versioned_commit", f"""
WITH {REACTIONS}, {ACCEPTED}, last AS (
  SELECT c_0, c_1, c_2, arg_max(a.yield, (ts, event_id)) AS new_yield
  FROM accepted a JOIN reactions r ON a.row_id = r.row_id GROUP BY c_0, c_1, c_2)
SELECT r.row_id, r.yield AS before, coalesce(new_yield, r.yield) AS after
FROM reactions r LEFT JOIN last l ON r.c_0 = l.c_0 AND r.c_1 = l.c_1 AND r.c_2 = l.c_2""")
def h3_versioned(spark, sf):
    """A tagged version and the one that commits of the history's halves have made of it, side by side."""
    root, keys, seq = scratch_path(spark, "versions"), ["c_0", "c_1", "c_2"], ["ts", "event_id"]
    r = cut_lineage(reactions(spark, sf).select("row_id", *keys, "yield"))
    versions.create(r, root, keys, n_buckets=64)
    versions.tag(spark, root, "before")
    history = cut_lineage(commit.accepted(feed(spark, sf)).join(r.select("row_id", *keys), "row_id").select(*keys, *seq, "yield"))
    late = F.coalesce(F.col("ts") > history.agg(F.percentile_approx("ts", 0.5)).scalar(), F.lit(False))
    for batch, part in enumerate([history.where(~late), history.where(late)]):
        versions.commit_edits(spark, root, part, seq, batch=batch)
    before = versions.read_version(spark, root, "before").select("row_id", F.col("yield").alias("before"))
    return before.join(versions.read_version(spark, root).select("row_id", F.col("yield").alias("after")), "row_id")


@query("h5_count_known", f"WITH {REACTIONS} SELECT count(*) FILTER (yield > -1) AS n_known FROM reactions")
def h5(spark, sf):
    return commit.count_known(reactions(spark, sf))


@query("h6_history_summary", f"""
WITH {ACCEPTED} SELECT row_number() OVER (ORDER BY ts, event_id) AS number, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date, yield
FROM accepted""")
def h6(spark, sf):
    return commit.history_summary(commit.accepted(feed(spark, sf)))
