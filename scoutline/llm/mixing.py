"""Mixing sources to target weights by weighted fair queueing.

Every document of a source gets a place in the source's shuffled order (a hash of its id) and, from the sizes before it, a
virtual finish time: cumulative words of the source divided by its weight. A second pass over a source goes on where the
first one ended. All passes of all sources are range-sorted by finish time, and the mix is everything up to the total
budget. A source that runs out leaves its share to the others, because they alone fill the rest of the budget.

Cumulative sums never see a whole source in one task: the order is cut into hash buckets that grow in number with the
table, sums run inside a bucket, and offsets come from the bucket totals. The global sum over the range-sorted passes is
found the same way: totals per range partition first, then rows of the one partition in which the budget ends.

Null texts have size 0. Null sources form one source, last in order; null ids take part like any other. Rows with equal
ids are separate documents; equal rows get places next to each other. Sizes of 0 take nothing. An empty table, or one
without words, has targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import HASH_RANGE, portable_hash
from ..functions.session import cut_lineage
from .common import only, text_of

WEIGHTS = (5, 2, 1)
SHARE, MAX_PASSES, SEED = 1.5, 2, 17
BUCKET_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MAX_PASSES) -> DataFrame:
    """(source, source_size, rank, weight, target) from (source, size): one row per source.

    The level up to which all sources are filled in proportion to weight is found in closed form: with sources in order of
    cap / weight, it is the first one at which the budget left for the later sources no longer exceeds the next cap.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("rank", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1)
    pick = F.array(*[F.lit(float(w)) for w in weights])
    order = W.orderBy("fill", "rank")
    caps = (ranked.withColumn("weight", F.get(pick, F.col("rank") % len(weights)))
            .withColumn("cap", F.col("source_size").cast("double") * most).withColumn("fill", F.col("cap") / F.col("weight"))
            .withColumn("budget", F.sum("source_size").over(W.partitionBy()).cast("double") * share)
            .withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
            .withColumn("left", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
            .withColumn("level", (F.col("budget") - F.col("before")) / F.col("left")))
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "rank", "level"))).over(W.partitionBy())["level"]
    return (caps.withColumn("at", F.coalesce(level, F.lit(float("inf"))))
            .select("source", "source_size", "rank", "weight", F.least("cap", F.col("at") * F.col("weight")).alias("target")))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MAX_PASSES, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, passes, taken): how often, and with how many words, the mix takes each document."""
    sizes = cut_lineage(only(docs, "doc_id", "source", "text").select("doc_id", "source", word_count(text_of()).alias("size")))
    stats = sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    buckets = max(1, stats.n // BUCKET_ROWS)
    targets = cut_lineage(source_targets(sizes, weights, share, most))
    placed = (sizes.join(targets.withColumnRenamed("source", "_source"), _same("source", "_source")).drop("_source")
              .withColumn("place", portable_hash("doc_id", seed))
              .withColumn("bucket", F.floor(F.coalesce("place", F.lit(0)) / F.lit(float(HASH_RANGE)) * buckets)))
    offsets = (placed.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
               .select("rank", "bucket", (F.sum("words").over(W.partitionBy("rank").orderBy("bucket")) - F.col("words")).alias("offset")))
    inside = W.partitionBy("rank", "bucket").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    queued = cut_lineage(placed.withColumn("inside", F.sum("size").over(inside)).join(offsets, ["rank", "bucket"])
                         .select("doc_id", "source", "size", "source_size", "target", "rank", "weight",
                                 (F.col("inside") + F.col("offset")).alias("queued")))
    finish = lambda turn: (F.col("queued") + F.col("source_size") * turn) / F.col("weight")
    turns = (queued.select("rank", "size", "doc_id", F.explode(F.array(*[F.struct(finish(k).alias("finish"), F.lit(k).alias("turn"))
                                                                       for k in range(most)])).alias("e"))
             .select("e.finish", "rank", "e.turn", "doc_id", "size").filter("size > 0")
             .repartitionByRange("finish", "rank", "doc_id").withColumn("part", F.spark_partition_id()))
    end = _truncate(cut_lineage(turns), int(stats.words * share))
    passes = sum((F.when((finish(k) < end[0]) | ((finish(k) == end[0]) & (F.col("rank") <= end[1])), 1).otherwise(0) for k in range(most)),
                 F.lit(0)).cast("int")
    return (queued.withColumn("passes", F.when(F.col("size") > 0, passes).otherwise(0))
            .select("doc_id", "source", "size", "source_size", "target", "passes", (F.col("size") * F.col("passes")).alias("taken")))


def _truncate(turns: DataFrame, budget: int) -> tuple[float, int]:
    """(finish, rank) of the last document in global finish order with which the mix stays within the budget.

    Within a source finish times of documents with words differ, so (finish, rank) names one document (or equal ones).
    """
    totals = sorted(turns.groupBy("part").agg(F.sum("size").alias("words")).collect())  # one row per range partition
    passed, at = 0, None
    for part, words in totals:
        if passed + words > budget:
            at = part
            break
        passed += words
    if at is None:
        return float("inf"), 0
    running = F.sum("size").over(W.partitionBy("part").orderBy("finish", "rank", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    last = (turns.filter(F.col("part") == at).withColumn("running", running).filter(F.col("running") <= budget - passed)
            .agg(F.max(F.struct("finish", "rank")).alias("m")).first().m)
    if last is None:
        last = turns.filter(F.col("part") < at).agg(F.max(F.struct("finish", "rank")).alias("m")).first().m
    return (last.finish, last.rank) if last else (float("-inf"), -1)


def take(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The mix itself: every document as often as `mix` takes it, with its own columns. Rows with equal id, source and size
    share the more generous decision."""
    chosen = (decisions.groupBy("doc_id", "source", "size").agg(F.max("passes").alias("passes")).filter("passes > 0"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("from"),
                       word_count(text_of()).alias("words"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & _same("from", "source") & (F.col("words") == F.col("size"))
    return rows.join(chosen, same).select("row", F.explode(F.sequence(F.lit(1), F.col("passes")))).select("row.*")
