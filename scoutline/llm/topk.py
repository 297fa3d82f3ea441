"""Exact top-k search by distributed histogram selection.

Every (query, candidate) pair is scored, in tiles of a block of queries and a block of candidates. The scores of a pass
are not kept: a tile reports, per query, how many scores fall into each bin, from the top until k scores are covered.
Summed over tiles these histograms tell the bin of each query's kth score. The next pass bins only that bin, until a bin
is one integer: the kth score. A last pass emits the scores above it and, of the ties at it, the smallest ids.

Blocks have fixed sizes, so memory per task is bounded and the number of tiles follows the work. Rows are dealt to blocks
by a hash of their id, so copies of one vector are spread. Per tile and query at most k bins or rows leave a task, ties
included, so many equal scores cost nothing extra. Nothing is broadcast.

Vectors that are null, or hold null or non-finite components, and rows without an id take no part. Shorter vectors count
as padded with zeros. Rows with equal ids are separate candidates, but never of a query with that id; a repeated query id
is searched once, with the largest of its vectors in component order. Ties go to smaller ids. Inner products must fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.session import cut_lineage

QUERY_BLOCK, CANDIDATE_BLOCK, CHUNK = 2048, 8192, 128
BINS = 2048


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(id, v: ARRAY<BIGINT>) of the rows that take part, each component x as floor(scale * x)."""
    x = F.transform("embedding", lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("bigint"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return (vectors.select(F.col("vec_id").cast("bigint").alias("id"), "embedding").filter(F.col("id").isNotNull() & F.col("embedding").isNotNull())
            .filter(finite).select("id", x.alias("v")))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    rows = [np.asarray(v, dtype=np.int64) for v in column]
    if all(len(v) == width for v in rows):
        return np.stack(rows) if rows else np.zeros((0, width), np.int64)
    out = np.zeros((len(rows), width), np.int64)
    for i, v in enumerate(rows):
        out[i, :len(v)] = v
    return out


def _scores(queries: pd.DataFrame, candidates: pd.DataFrame, bound: float):
    """(positions of the queries, score block, mask of the pairs that count), chunk by chunk. Exact: float products only where they are."""
    width = max((len(v) for v in (*queries["v"], *candidates["v"])), default=0)
    kind = np.float64 if bound < 2**53 else np.int64
    q, c = _matrix(queries["v"], width).astype(kind), _matrix(candidates["v"], width).astype(kind)
    q_ids, c_ids = queries["id"].to_numpy(np.int64), candidates["id"].to_numpy(np.int64)
    for at in range(0, len(q), CHUNK):
        part = slice(at, at + CHUNK)
        yield part, (q[part] @ c.T).astype(np.int64), q_ids[part, None] != c_ids[None, :]


def _top(values: np.ndarray, k: int) -> np.ndarray:
    """The k largest, or all."""
    return values if len(values) <= k else np.partition(values, len(values) - k)[len(values) - k:]


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def _tiles(queries: DataFrame, candidates: DataFrame, blocks: int, cuts: int):
    """Both sides dealt to tiles (qb, cb): queries copied to every candidate block, candidates to every query block."""
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("qb", deal(cuts)).withColumn("cb", every(blocks))
    c = candidates.withColumn("cb", deal(blocks)).withColumn("qb", every(cuts))
    return q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb"))


def _histogram(k: int, bound: float, step: int, width: int):
    """Per query of a tile: (bin, scores in it) of the scores in [low, low + width), from the top until k are covered."""

    def histogram(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        ids, bins, counts = [], [], []
        for part, scores, valid in _scores(queries, candidates, bound):
            for i, (q, low_, above) in enumerate(queries.iloc[part][["id", "low", "above"]].itertuples(index=False)):
                row = scores[i][valid[i]]
                inside = row[(row >= low_) & (row < low_ + width)]
                at, n = np.unique((_top(inside, k - above) - low_) // step, return_counts=True)
                ids.append(np.full(len(at), q)), bins.append(at), counts.append(n)
        return pd.DataFrame({"id": _joined(ids), "bin": _joined(bins), "n": _joined(counts)})

    return histogram


def top_k(vectors: DataFrame, is_query: str, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every row for which the SQL condition `is_query` on vec_id holds."""
    rows = cut_lineage(quantised(vectors, scale))
    asked = rows.filter(F.expr(is_query.replace("vec_id", "id"))).groupBy("id").agg(F.max("v").alias("v"))
    norms = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("m"),
                     F.max(F.size("v")).alias("d")).first()
    bound = float(norms.m or 0) + 1  # |<a, b>| is at most the largest squared norm
    n_asked = rows.filter(F.expr(is_query.replace("vec_id", "id"))).count()
    blocks, cuts = max(1, -(-norms.n // CANDIDATE_BLOCK)), max(1, -(-n_asked // QUERY_BLOCK))
    low, width = -int(bound), 2 * int(bound) + 1
    # per query: the range [low, low + width) that holds the kth score, and how many scores lie above it
    state = cut_lineage(asked.select("id", "v", F.lit(low).cast("bigint").alias("low"), F.lit(0).cast("bigint").alias("above")))
    while width > 1:
        step = -(-width // BINS)

        counted = _tiles(state, rows, blocks, cuts).applyInPandas(_histogram(k, bound, step, width), "id bigint, bin bigint, n bigint")
        down = W.partitionBy("id").orderBy(F.desc("bin"))
        totals = (counted.groupBy("id", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(down))
                  .join(state.select("id", "low", "above"), "id").withColumn("upto", F.col("upto") + F.col("above")))
        # the first bin from the top at which k scores are reached; the lowest one that has any if there are fewer
        last = totals.groupBy("id").agg(F.coalesce(F.max(F.when(F.col("upto") >= k, F.struct("bin", "upto", "n"))), F.min(F.struct("bin", "upto", "n"))).alias("b"))
        state = cut_lineage(state.join(last, "id").select("id", "v", (F.col("low") + F.col("b.bin") * step).alias("low"), (F.col("b.upto") - F.col("b.n")).alias("above")))
        width = step

    def select(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        ids, found, values = [], [], []
        c_ids = candidates["id"].to_numpy(np.int64)
        for part, scores, valid in _scores(queries, candidates, bound):
            for i, (q, kth, above) in enumerate(queries.iloc[part][["id", "low", "above"]].itertuples(index=False)):
                over, ties = valid[i] & (scores[i] > kth), np.sort(c_ids[valid[i] & (scores[i] == kth)])[:k - above]
                ids.append(np.full(int(over.sum()) + len(ties), q)), found.extend([c_ids[over], ties])
                values.extend([scores[i][over], np.full(len(ties), kth)])
        return pd.DataFrame({"query_id": _joined(ids), "vec_id": _joined(found), "score": _joined(values)})

    best = _tiles(state, rows, blocks, cuts).applyInPandas(select, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
