"""Registered queries: featurisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import array_sum
from ..operators import features, reduce
from .bindings import POINTS, REACTIONS, VIEWS, points, reactions, table, views

Q, SQL = {}, {}


def query(name, sql=None):
    def register(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


COMPONENTS = ["c_0", "c_1", "c_2"]


def documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text")


def _kept(text, cls):
    return f"CAST(length(regexp_replace({text}, '[^{cls}]', '', 'g')) AS DOUBLE)"


def _descriptors(text):
    blanks = _kept(text, " ")
    return (f"CASE WHEN length({text}) > 0 THEN [CAST(length({text}) AS DOUBLE), {_kept(text, 'a-zA-Z')}, "
            f"{_kept(text, '0-9')}, {_kept(text, 'A-Z')}, {blanks}, (length({text}) - {blanks}) / ({blanks} + 1.0::DOUBLE)] "
            f"ELSE [0.0::DOUBLE, 0.0, 0.0, 0.0, 0.0, 0.0] END")


@query("c1_encode_distinct", f"SELECT doc_id AS row_id, {_descriptors('text')} AS text_enc FROM documents")
def c1(spark, sf):
    return features.encode_distinct(documents(spark, sf), ["text"], features.descriptors).select("row_id", "text_enc")


_VOCAB = f"""
WITH {REACTIONS}, long AS (SELECT 'c_0' AS col, c_0 AS t FROM reactions UNION ALL SELECT 'c_1', c_1 FROM reactions
                           UNION ALL SELECT 'c_2', c_2 FROM reactions),
chars AS (SELECT DISTINCT col, unnest(string_split(t, '')) AS ch FROM long),
vocab AS (SELECT c.col, ch, row_number() OVER (PARTITION BY c.col ORDER BY ch) - 1 AS idx,
                 count(*) OVER (PARTITION BY c.col) AS n_chars, max_len
          FROM chars c JOIN (SELECT col, CAST(max(length(t)) AS BIGINT) AS max_len FROM long GROUP BY col) m
               ON c.col = m.col)"""


@query("c2_char_vocab", _VOCAB + " SELECT col, ch, idx, n_chars, max_len FROM vocab")
def c2(spark, sf):
    return features.char_vocab(reactions(spark, sf), COMPONENTS)


def _one_hot(spark, sf):
    r = reactions(spark, sf).select("row_id", *COMPONENTS)
    vocab = features.char_vocab(r, COMPONENTS)
    return features.one_hot(r, COMPONENTS, vocab), vocab


@query("c3_one_hot", _VOCAB + """,
width AS (SELECT col, max(n_chars * max_len) AS w FROM vocab GROUP BY col),
placed AS (SELECT row_id, 'c_0' AS col, unnest(string_split(c_0, '')) AS ch,
                  unnest(range(length(c_0))) AS pos FROM reactions
           UNION ALL SELECT row_id, 'c_1', unnest(string_split(c_1, '')), unnest(range(length(c_1))) FROM reactions
           UNION ALL SELECT row_id, 'c_2', unnest(string_split(c_2, '')), unnest(range(length(c_2))) FROM reactions)
SELECT row_id, CAST(pos * n_chars + idx + coalesce((SELECT sum(w) FROM width x WHERE x.col < p.col), 0) AS BIGINT) AS slot
FROM placed p JOIN vocab v ON p.col = v.col AND p.ch = v.ch""")
def c3(spark, sf):
    encoded, _ = _one_hot(spark, sf)
    return encoded.select("row_id", F.explode("slots").alias("slot"))


@query("c4_one_hot_decode", f"WITH {REACTIONS} SELECT row_id, c_0, c_1, c_2 FROM reactions")
def c4(spark, sf):
    encoded, vocab = _one_hot(spark, sf)
    return features.one_hot_decode(encoded.select("row_id", "slots"), COMPONENTS, vocab).drop("slots")


def _bits_sql(source, text, n_bits, offset=0):
    return f"""SELECT DISTINCT row_id, CAST((((
      ((unicode(g[1])::BIGINT * 31 + unicode(g[2])) % 1073741824 * 31 + unicode(g[3])) % 1073741824)
      * 2654435761) % 4294967296 * {n_bits}) >> 32 AS INTEGER) + {offset} AS bit
    FROM (SELECT row_id, [ch[i], ch[i + 1], ch[i + 2]] AS g FROM (
      SELECT row_id, ch, unnest(range(1, len(ch) - 1)) AS i FROM (
        SELECT row_id, string_split({text}, '') AS ch FROM {source} WHERE length({text}) >= 3) a) b) c"""


@query("c5_hash_fingerprint", f"""
WITH docs AS (SELECT doc_id AS row_id, text FROM documents)
{_bits_sql('docs', 'text', 2048)}""")
def c5(spark, sf):
    encoded = features.hash_fingerprint(documents(spark, sf), ["text"], 2048, distinct=False)
    return encoded.select("row_id", F.explode_outer("slots").alias("bit")).where(F.col("bit").isNotNull())


@query("c6_descriptor_minmax", f"""
WITH d AS (SELECT doc_id AS row_id, {_descriptors('text')} AS f FROM documents),
long AS (SELECT row_id, unnest(f) AS v, unnest(range(6)) AS slot FROM d),
ends AS (SELECT slot, min(v) AS lo, max(v) AS hi FROM long GROUP BY slot)
SELECT row_id, l.slot, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 9) AS value
FROM long l JOIN ends e ON l.slot = e.slot""")
def c6(spark, sf):
    block = features.descriptor_block(documents(spark, sf), ["text"], distinct=False)
    return (features.minmax(block).select("row_id", F.posexplode_outer("features").alias("s", "v"))
            .select("row_id", F.col("s").cast("bigint").alias("slot"), F.round("v", 9).alias("value")))


_SHEETS = """
first AS (SELECT p_name AS component, CAST(max(p_size) AS DOUBLE) AS p, max(p_retailprice) AS b
          FROM part WHERE p_type IN ('ECONOMY', 'LARGE') GROUP BY p_name),
second AS (SELECT p_brand AS component, CAST(min(p_size) AS DOUBLE) AS p FROM part
           WHERE p_retailprice < 1000 GROUP BY p_brand),
third AS (SELECT p_name AS component, CAST(min(p_size) AS DOUBLE) AS p FROM part
          WHERE p_type = 'PROMO' AND p_size > 25 GROUP BY p_name),
stacked AS (SELECT component, p, b, 0 AS no FROM first UNION ALL SELECT component, p, 0, 1 FROM second
            UNION ALL SELECT component, p, 0, 2 FROM third),
lookup AS (SELECT component, arg_max(p, no) AS p, arg_max(b, no) AS b FROM stacked GROUP BY component)"""


def _lookup(spark, sf):
    part = table(spark, sf, "part")
    first = (part.where(F.col("p_type").isin("ECONOMY", "LARGE")).groupBy(F.col("p_name").alias("component"))
             .agg(F.max("p_size").cast("double").alias("p"), F.max("p_retailprice").alias("b")))
    second = (part.where(F.col("p_retailprice") < 1000).groupBy(F.col("p_brand").alias("component"))
              .agg(F.min("p_size").cast("double").alias("p")))
    third = (part.where((F.col("p_type") == "PROMO") & (F.col("p_size") > 25))
             .groupBy(F.col("p_name").alias("component")).agg(F.min("p_size").cast("double").alias("p")))
    return features.union_lookup([first, second, third])


@query("c7_property_lookup", f"""
WITH {REACTIONS}, {_SHEETS}
SELECT row_id, [coalesce(l0.p, 0), coalesce(l0.b, 0), coalesce(l1.p, 0), coalesce(l1.b, 0),
                coalesce(l2.p, 0), coalesce(l2.b, 0)] AS features
FROM reactions LEFT JOIN lookup l0 ON c_0 = l0.component LEFT JOIN lookup l1 ON c_1 = l1.component
LEFT JOIN lookup l2 ON c_2 = l2.component""")
def c7(spark, sf):
    return features.property_lookup(reactions(spark, sf), COMPONENTS, _lookup(spark, sf)).select("row_id", "features")


@query("c8_union_lookup", f"WITH {_SHEETS} SELECT component, p, b FROM lookup")
def c8(spark, sf):
    return _lookup(spark, sf)


@query("c9_assemble", f"""
WITH {REACTIONS}
{_bits_sql('reactions', 'c_0', 512)} UNION ALL {_bits_sql('reactions', 'c_1', 512, 512)}
UNION ALL {_bits_sql('reactions', 'c_2', 512, 1024)}""")
def c9(spark, sf):
    encoded = features.hash_fingerprint(reactions(spark, sf), COMPONENTS, 512)
    return encoded.select("row_id", F.explode("slots").alias("bit"))


@query("c10_align_views", f"""
WITH {VIEWS} SELECT a.row_id, a.y, list_concat(a.features, b.features) AS features
FROM view_0 a JOIN view_1 b ON a.row_id = b.row_id""")
def c10(spark, sf):
    both = features.align_views(*views(spark, sf))
    return features.assemble(both, ["x0", "x1"]).select("row_id", "y", "features")


@query("c11_truncated_svd")
def c11(spark, sf):
    projected, ratio = reduce.truncated_svd(points(spark, sf), 16)
    return projected.select("row_id", "features", F.lit(ratio).alias("explained_variance_ratio"))


@query("c11_truncated_svd_sparse")
def c11_sparse(spark, sf):
    encoded = features.hash_fingerprint(reactions(spark, sf).select("row_id", *COMPONENTS), COMPONENTS, 128)
    return reduce.fit_svd_slots(encoded, 384, 8).transform_slots(encoded.select("row_id", "slots"))


@query("c11_full_rank_norms", f"""
WITH {POINTS} SELECT row_id, round(list_dot_product(features, features), 6) AS squared_norm FROM points""")
def c11_norms(spark, sf):
    """A projection on all components turns the rows and keeps their lengths."""
    p = points(spark, sf)
    return reduce.fit_svd(p, 64).transform(p).select("row_id", F.round(array_sum(F.transform("features", lambda v: v * v)), 6).alias("squared_norm"))


@query("c11_wide_full_rank_norms", f"""
WITH {POINTS} SELECT row_id, round(list_dot_product(features, features), 6) AS squared_norm FROM points""")
def c11_wide_norms(spark, sf):
    """The fit in bounded passes, at full rank."""
    p = points(spark, sf)
    return reduce.fit_svd_wide(p, 64, 64).transform(p).select("row_id", F.round(array_sum(F.transform("features", lambda v: v * v)), 6).alias("squared_norm"))


@query("c11_wide_sparse", f"""
WITH {REACTIONS}, bits AS ({_bits_sql('reactions', 'c_0', 4096)})
SELECT r.row_id, CAST(count(DISTINCT b.bit) AS DOUBLE) AS squared_norm FROM reactions r LEFT JOIN bits b ON b.row_id = r.row_id GROUP BY r.row_id""")
def c11_wide_sparse(spark, sf):
    """4,096 slots and no matrix of their square: few names give a low rank, so the projection keeps the lengths, the numbers of bits."""
    encoded = features.hash_fingerprint(reactions(spark, sf).select("row_id", *COMPONENTS), COMPONENTS[:1], 4096)
    model = reduce.fit_svd_wide(encoded, 4096, 32, col="slots", sparse=True)
    projected = model.transform_slots(encoded.select("row_id", "slots"))
    return projected.select("row_id", F.round(array_sum(F.transform("features", lambda v: v * v)), 6).alias("squared_norm"))


@query("c11_explained_variance", f"""
WITH {POINTS}, long AS (SELECT unnest(features) AS v, unnest(range(64)) AS slot FROM points),
vars AS (SELECT slot, var_pop(v) AS s FROM long GROUP BY slot)
SELECT round(sum(s) FILTER (slot < 32) / sum(s), 9) AS explained_variance_ratio FROM vars""")
def c11_ratio(spark, sf):
    given = points(spark, sf).withColumn("projected", F.slice("features", 1, 32))
    return reduce.explained_variance_ratio(given, "projected", "features").select(
        F.round("explained_variance_ratio", 9).alias("explained_variance_ratio"))


@query("c12_binarize", f"""
WITH {POINTS} SELECT row_id, CASE WHEN y <= 40 THEN 0 ELSE 1 END AS label FROM points""")
def c12(spark, sf):
    return points(spark, sf).select("row_id", features.binarize("y", 40.0).alias("label"))
