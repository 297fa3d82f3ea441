"""Coverage of the encoded space: the exact range join, and the acquisition rules built on it.

"Within" means Euclidean distance strictly below delta; a row is within delta of itself.

Range join. Points with equal features are collapsed first (one point, a weight), so a group of copies never
meets itself. The index has two levels: each point goes to the cell of its nearest pivot (the number of pivots grows with
the cube root of the points) and to a ring of the distance to that pivot; the width of far rings grows with the distance.
Pairs of cells that the triangle inequality cannot rule out are a table, made by the tasks that hold the cells; joined with
the rings of both cells they give the pairs of entries (cell, ring), which are of three kinds:

* no pair of points can be within delta: not in the table;
* every pair is within delta: the count of the whole entry is added, without looking at its points;
* undecided: to be measured.

Entries in order are cut into strips of about `TILE_ROWS` points (a hot entry into several, by a hash), and a point travels
once to each strip of the other side that has an undecided entry for its own strip, so it is copied at most once per
`TILE_ROWS` points, however many entries there are. A pair of strips is one group, in which undecided pairs of entries only
are measured, in blocks of `BLOCK_ROWS`. The driver holds one row per cell; entries, their pairs and the pairs of strips are
tables.

Greedy selection keeps no edge table and no candidates on the driver. Candidates with their first gains are written once, in
blocks by score. What a pick newly covers is taken from the candidates within 2 delta of it, as rows (candidate, loss) of a
log; nothing else is written. Gains never grow, so a block's last known best is a bound, and a pick reads only those blocks
whose bound can still win.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import _c, array_sum, literal_array, to_matrix
from ..functions.hashing import portable_hash
from ..functions.session import cut_lineage, scratch_path

TILE_ROWS = 32768      # points per strip: what a task holds of one side
BLOCK_ROWS = 1024      # points per block: a pair of blocks is a 1024 x 1024 product
CLOSE_PAIRS = 16384    # pairs too close to call that are measured together
NEAR_RINGS = 8         # rings of a quarter of delta; further out a ring is twice as wide as the one before
GAIN_ROWS = 65536      # candidates per block of the gain log
BLOCKS_AT_ONCE = 8     # blocks of it that are read together
SLACK = 1e-9           # relative safety margin of the pruning limits; undecided pairs are always measured


# --- assigning points to centres -------------------------------------------------------------------

def nearest_center(df: DataFrame, centers: np.ndarray, features: str = "features") -> DataFrame:
    """Add `cell`, the index of the nearest centre, and `dist`, the distance to it."""
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(centers, dtype=float))
    schema = T.StructType(df.schema.fields + [T.StructField("cell", T.IntegerType()), T.StructField("dist", T.DoubleType())])

    def run(batches):
        c = shared.value
        for batch in batches:
            x = to_matrix(batch.column(features), c.shape[1])
            cell = ((c * c).sum(1) - 2 * x @ c.T).argmin(1) if len(x) else np.zeros(0, int)
            dist = np.sqrt(((x - c[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(list(batch.columns) + [pa.array(cell, pa.int32()), pa.array(dist)],
                                             names=schema.names)

    return df.mapInArrow(run, schema)


def coverage_radius(df: DataFrame, k: int, seed: int = 0, features: str = "features") -> float:
    """K-means on the encodings; the unweighted mean over clusters of the mean distance to the own centroid."""
    vec = df.select(features).withColumn("_v", array_to_vector(F.col(features))).persist()
    try:
        model = KMeans(k=k, seed=seed, featuresCol="_v").fit(vec)
        return mean_of_cluster_means(nearest_center(vec.select(features), np.array(model.clusterCenters()), features)).first()[0]
    finally:
        vec.unpersist()


def mean_of_cluster_means(assigned: DataFrame, cluster: str = "cell", dist: str = "dist") -> DataFrame:
    return assigned.groupBy(cluster).agg(F.avg(dist).alias("m")).agg(F.avg("m").alias("radius"))


# --- range join ------------------------------------------------------------------------------------

@dataclass(frozen=True)
class PointIndex:
    """Distinct points with their nearest pivot (`cell`), the distance to it, and its `ring`."""

    points: DataFrame
    pivots: np.ndarray
    delta: float
    size: int = 0


def digest(features: str = "features") -> tuple[Column, Column]:
    """128 bits that stand for the features as a key."""
    return F.xxhash64(features), F.xxhash64(F.lit(1), features)


def index_points(df: DataFrame, delta: float, keep: list[str] = (), extra: list[Column] = ()) -> PointIndex:
    """Collapse equal rows to (d1, d2, features, pid = lowest row id, weight = copies), combined map-side, and index them.

    The indexed table is written to the checkpoint folder once; everything else reads it from there.
    """
    one, two = digest()
    points = cut_lineage(df.groupBy(one.alias("d1"), two.alias("d2"), *keep)
                         .agg(F.first("features").alias("features"), F.min("row_id").alias("pid"), F.count("*").alias("weight"), *extra))
    size = points.count()
    pivot_count = max(1, round(size ** (1 / 3)))
    # Any points serve as pivots; the exactness does not depend on them.
    chosen = points.orderBy(portable_hash("pid", "pivot"), "pid").limit(pivot_count).select("features").collect()
    if not chosen:
        return PointIndex(points.withColumns({"cell": F.lit(0), "dist": F.lit(0.0), "ring": F.lit(0)}), np.zeros((1, 1)), delta)
    pivots = np.array([r["features"] for r in chosen], dtype=float)
    near, far = F.floor(F.col("dist") / (delta / 4)), F.floor(F.log2(F.col("dist") / (delta / 4 * NEAR_RINGS)))
    ring = F.when(near < NEAR_RINGS, near).otherwise(NEAR_RINGS + F.greatest(far, F.lit(0))).cast("int")
    return PointIndex(cut_lineage(nearest_center(points, pivots).withColumn("ring", ring)), pivots, delta, size)


@dataclass(frozen=True)
class _Plan:
    """What to do with the entries of the two sides."""

    left: DataFrame   # per entry (ec, er): distance limits, its first strip and the number of strips
    right: DataFrame
    strips: DataFrame  # (ls, rs) that have to meet
    sure: DataFrame   # per left entry, the summed weight of the right entries wholly within delta


def _limits(l_lo, l_hi, r_lo, r_hi, between, delta: float, most=lambda *v: np.maximum.reduce(v)):
    """(every pair is within delta, some pair may be) of entries with these distance limits to their pivots: arrays, or columns
    with `most` for their maximum."""
    margin = SLACK * (1 + delta + between + l_hi + r_hi)
    nearest = most(between - l_hi - r_hi, l_lo - between - r_hi, r_lo - between - l_hi)
    return between + l_hi + r_hi < delta - margin, nearest < delta + margin


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2))


def _entries(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, cell, ring, n, weight, lo, hi) of both sides, written once."""
    def of(df: DataFrame, side: int) -> DataFrame:
        return df.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).withColumn("side", F.lit(side))
    return cut_lineage(of(left, 0).unionByName(of(right, 1)))


def _first_strips(cells: pd.DataFrame) -> np.ndarray:
    """The first strip of each cell: cells that fit share one, others have as many as they need and one more."""
    first, strip, room = [], 0, TILE_ROWS
    for n in cells.n:
        if n > TILE_ROWS:
            first.append(strip + 1)
            strip, room = strip + 2 + n // TILE_ROWS, TILE_ROWS
        else:
            if n > room:
                strip, room = strip + 1, TILE_ROWS
            room -= n
            first.append(strip)
    return np.array(first, dtype=int)


def _cell_pairs(cells: DataFrame, others: pd.DataFrame, index: PointIndex) -> DataFrame:
    """(l_cell, r_cell, between): the pairs of cells that may hold points within delta, and the distance of their pivots."""
    shared = cells.sparkSession.sparkContext.broadcast((index.pivots, *[others[c].to_numpy() for c in ("cell", "lo", "hi")]))
    delta = index.delta

    def pairs(batches):
        pivots, cell, lo, hi = shared.value
        for batch in batches:
            for c, l_lo, l_hi in zip(*[batch.column(n).to_pylist() for n in ("cell", "lo", "hi")]):
                between = _distances(pivots[[c]], pivots[cell])[0]
                may = _limits(l_lo, l_hi, lo, hi, between, delta)[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(may.sum(), c, "int32")), pa.array(cell[may].astype("int32")), pa.array(between[may])],
                                                 names=["l_cell", "r_cell", "between"])

    return cells.mapInArrow(pairs, "l_cell int, r_cell int, between double")


def _plan(left: DataFrame, right: DataFrame, index: PointIndex, count_whole: bool) -> _Plan:
    """One row per cell comes to the driver, the cube root of the points. With `count_whole` entries wholly within delta are
    not measured, but summed as `sure`."""
    spark, delta = right.sparkSession, index.delta
    entries = _entries(left, right)
    cells = entries.groupBy("side", "cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    at_hand = cells.toPandas().sort_values("cell")
    before = F.sum("n").over(Window.partitionBy("side", "cell").orderBy("ring").rowsBetween(Window.unboundedPreceding, -1))

    def side(k: int) -> DataFrame:
        own = at_hand[at_hand.side == k]
        starts = spark.createDataFrame(list(zip(own.cell.tolist(), _first_strips(own).tolist())), "cell int, start int")
        inside = F.floor(F.coalesce(before, F.lit(0)) / TILE_ROWS)
        return (entries.where(F.col("side") == k).withColumn("inside", inside).join(starts, "cell")
                .select(F.col("cell").alias("ec"), F.col("ring").alias("er"), "lo", "hi", "weight", (F.col("start") + F.col("inside")).cast("int").alias("first"),
                        F.ceil(F.col("n") / TILE_ROWS).cast("int").alias("parts")))

    a, b = side(0), side(1)
    named = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    pairs = _cell_pairs(cells.where("side = 0"), at_hand[at_hand.side == 1], index)
    pairs = pairs.join(named(a, "l"), F.col("l_cell") == F.col("l_ec")).join(named(b, "r"), F.col("r_cell") == F.col("r_ec"))
    whole, may = _limits(*[F.col(c) for c in ("l_lo", "l_hi", "r_lo", "r_hi", "between")], delta, F.greatest)
    decided = cut_lineage(pairs.where(may).select("l_ec", "l_er", "l_first", "l_parts", "r_first", "r_parts", "r_weight", (whole if count_whole else F.lit(False)).alias("whole")))
    every = lambda p: F.explode(F.sequence(F.col(f"{p}_first"), F.col(f"{p}_first") + F.col(f"{p}_parts") - 1))
    strips = decided.where("not whole").select(every("l").alias("ls"), "r_first", "r_parts").distinct().select("ls", every("r").alias("rs")).distinct()
    sure = decided.where("whole").groupBy(F.col("l_ec").alias("ec"), F.col("l_er").alias("er")).agg(F.sum("r_weight").alias("sure"))
    return _Plan(a, b, cut_lineage(strips), sure)


def within(x: np.ndarray, y: np.ndarray, delta: float) -> np.ndarray:
    """Boolean matrix |x_i - y_j| < delta. Pairs too close to call by the product form are measured directly."""
    d2, limit = (x * x).sum(1)[:, None] + (y * y).sum(1)[None], delta * delta
    d2 -= 2 * x @ y.T
    hit = d2 < limit
    gap = d2 - limit
    np.abs(gap, out=gap)
    np.abs(d2, out=d2)  # from here on the margin, in place: two matrices of a block at a time
    d2 += 1 + limit
    d2 *= 1e-8
    close = np.nonzero(gap < d2)
    for s in range(0, len(close[0]), CLOSE_PAIRS):
        i, j = close[0][s:s + CLOSE_PAIRS], close[1][s:s + CLOSE_PAIRS]
        hit[i, j] = np.sqrt(((x[i] - y[j]) ** 2).sum(1)) < delta
    return hit


def _dealt(points: DataFrame, entries: DataFrame, strips: DataFrame, own: str, *cols: str) -> DataFrame:
    """The points with their strip and, a copy for each, the strips of the other side they have to meet."""
    part = F.pmod(F.xxhash64("pid"), F.col("parts")).cast("int")
    placed = points.join(entries, (F.col("cell") == F.col("ec")) & (F.col("ring") == F.col("er")))
    return placed.select((F.col("first") + part).alias(own), "cell", "ring", "dist", "lo", "hi", "pid", "features", *cols).join(strips, own)


class _Strip:
    """The rows of one side of a group: an Arrow array per column, the features as one matrix."""

    def __init__(self, parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts)
        self.features = to_matrix(table["features"].combine_chunks())
        self.columns = {c: table[c].combine_chunks() for c in table.column_names if c != "features"}

    def __len__(self) -> int:
        return len(self.features)

    def numpy(self, name: str) -> np.ndarray:
        return self.columns[name].to_numpy(zero_copy_only=False)

    def counted(self, total: np.ndarray, *names: str) -> pa.RecordBatch:
        """The named columns and `m` of the rows whose total is above 0."""
        some = pa.array(total > 0)
        return pa.RecordBatch.from_arrays([*[self.columns[c].filter(some) for c in names], pa.array(total[total > 0])], names=[*names, "m"])


def _two_sides(batches: Iterator[pa.RecordBatch]) -> tuple[_Strip, _Strip]:
    """The strips of a group, whose batches hold rows of both sides; a batch is let go when it has been dealt."""
    parts: tuple[list, list] = ([], [])
    for batch in batches:
        for k in (0, 1):
            parts[k].append(batch.filter(pc.equal(batch.column("side"), k)))
    return _Strip(parts[0]), _Strip(parts[1])


def _near_blocks(a: _Strip, b: _Strip, pivots: np.ndarray, delta: float, count_whole: bool):
    """(rows of a, rows of b, boolean matrix within delta) of the blocks of two strips that have to be measured."""
    def entries(side: _Strip):
        order = np.lexsort((side.numpy("ring"), side.numpy("cell")))
        cell, ring, dist, lo, hi = (side.numpy(c)[order] for c in ("cell", "ring", "dist", "lo", "hi"))
        ends = np.append(np.nonzero((np.diff(cell) != 0) | (np.diff(ring) != 0))[0] + 1, len(cell))
        starts = np.append(0, ends[:-1])
        return [(order[s:e], cell[s], lo[s], hi[s], dist[s:e].min(), dist[s:e].max()) for s, e in zip(starts, ends)]

    x, y = a.features, b.features
    right = entries(b)
    r_cell, r_lo, r_hi, here_lo, here_hi = (np.array([e[k] for e in right]) for k in range(1, 6))
    for rows, cell, lo, hi, own_lo, own_hi in entries(a):
        between = _distances(pivots[[cell]], pivots[r_cell])[0]
        may = _limits(own_lo, own_hi, here_lo, here_hi, between, delta)[1]  # by the points that are here
        if count_whole:
            may &= ~_limits(lo, hi, r_lo, r_hi, between, delta)[0]  # by all points of the entries, as the plan has it
        for k in np.nonzero(may)[0]:
            for s in range(0, len(rows), BLOCK_ROWS):
                for t in range(0, len(right[k][0]), BLOCK_ROWS):
                    i, j = rows[s:s + BLOCK_ROWS], right[k][0][t:t + BLOCK_ROWS]
                    yield i, j, within(x[i], y[j], delta)


def _paired(a: DataFrame, b: DataFrame):
    """The rows of both sides by their pair of strips, with `side`. `a` gets a weight of 0.

    One union and one grouping: a cogroup through pandas would hold each strip as Arrow batches, as an object for each row and
    as a matrix.
    """
    a = a.withColumns({"weight": F.lit(0).cast("bigint"), "side": F.lit(0)})
    return a.unionByName(b.withColumn("side", F.lit(1))).groupBy("ls", "rs")


def _strip_pairs(left: DataFrame, right: DataFrame, plan: _Plan):
    return _paired(_dealt(left, plan.left.drop("weight"), plan.strips, "ls"), _dealt(right, plan.right.drop("weight"), plan.strips, "rs", "weight"))


def neighbor_weights(left: DataFrame, right: DataFrame, index: PointIndex) -> DataFrame:
    """`left` with `n_within`, the summed weight of the `right` points within delta. Both are parts of the index."""
    plan, pivots, delta = _plan(left, right, index, True), index.pivots, index.delta

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _two_sides(batches)
        total = np.zeros(len(a), dtype="int64")
        if len(a) and len(b):
            weight = b.numpy("weight")
            for i, j, near in _near_blocks(a, b, pivots, delta, True):
                total[i] += near @ weight[j]
        yield a.counted(total, "pid")

    measured = _strip_pairs(left, right, plan).applyInArrow(count, "pid bigint, m bigint").groupBy("pid").agg(F.sum("m").alias("m"))
    return (left.join(plan.sure, (F.col("cell") == F.col("ec")) & (F.col("ring") == F.col("er")), "left").join(measured, "pid", "left")
            .select(*left.columns, (F.coalesce("sure", F.lit(0)) + F.coalesce("m", F.lit(0))).cast("bigint").alias("n_within")))


def neighbors(df: DataFrame, delta: float) -> DataFrame:
    """All pairs (i, j) of distinct points within delta, both directions and self pairs, with j's copies.

    The pair list is as large as the answer. The acquisition rules below never build it. A task holds two strips and the pairs
    of a block; those leave it before the next block is measured.
    """
    index = index_points(df, delta)
    points, pivots = index.points, index.pivots

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _two_sides(batches)
        if len(a) and len(b):
            left, right, copies = a.numpy("pid"), b.numpy("pid"), b.numpy("weight")
            for found in _gathered(_near_blocks(a, b, pivots, delta, False)):
                i, j = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(left[i]), pa.array(right[j]), pa.array(copies[j])], names=["i", "j", "copies"])

    return _strip_pairs(points, points, _plan(points, points, index, False)).applyInArrow(pairs, "i bigint, j bigint, copies bigint")


def _gathered(blocks) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """The rows of the pairs that are near, of as many blocks as together have about `BLOCK_ROWS` squared / 4 of them."""
    found, n = [], 0
    for i, j, near in blocks:
        r, c = np.nonzero(near)
        if len(r):
            found.append((i[r], j[c]))
            n += len(r)
        if n >= BLOCK_ROWS * BLOCK_ROWS // 4:
            yield found
            found, n = [], 0
    if found:
        yield found


def _with_digest(df: DataFrame, *names: str) -> DataFrame:
    one, two = digest()
    return df.select("row_id", *names, one.alias("d1"), two.alias("d2"))


def neighbor_counts(df: DataFrame, delta: float) -> DataFrame:
    """Per row, how many rows (itself and copies included) lie within delta."""
    index = index_points(df, delta)
    counts = neighbor_weights(index.points, index.points, index).select("d1", "d2", F.col("n_within").alias("n_neighbors"))
    return _with_digest(df).join(counts, ["d1", "d2"]).select("row_id", "n_neighbors")


# --- covered, gain ---------------------------------------------------------------------------------
# `df` below is (row_id, features, labelled BOOLEAN, ...).

def _labelled_index(df: DataFrame, delta: float, keep: list[str] = ()) -> PointIndex:
    """Index in which each point knows its labelled copies and its first unlabelled row."""
    waiting = F.when(~F.col("labelled"), F.col("row_id"))
    return index_points(df, delta, keep, [F.count_if("labelled").alias("n_labelled"), F.min(waiting).alias("pool_id"),
                                          F.count(waiting).alias("pool_copies")])


def _cover(index: PointIndex) -> DataFrame:
    """Every point with `n_within`, above 0 when a labelled row covers it."""
    return neighbor_weights(index.points, index.points.where("n_labelled > 0"), index)


def _uncovered(index: PointIndex) -> DataFrame:
    return cut_lineage(_cover(index).where("n_within = 0").drop("n_within"))


def _pool_gain(index: PointIndex, uncovered: DataFrame) -> DataFrame:
    return neighbor_weights(index.points.where("pool_copies > 0"), uncovered, index).withColumnRenamed("n_within", "gain")


def covered(df: DataFrame, delta: float) -> DataFrame:
    """Rows within delta of any labelled row."""
    hit = _cover(_labelled_index(df, delta)).where("n_within > 0").select("d1", "d2")
    return _with_digest(df).join(hit, ["d1", "d2"], "left_semi").select("row_id")


def gain(df: DataFrame, delta: float) -> DataFrame:
    """Per row, the number of uncovered rows within delta; 0 for labelled rows."""
    index = _labelled_index(df, delta)
    pool = _pool_gain(index, _uncovered(index)).select("d1", "d2", "gain")
    return (_with_digest(df, "labelled").join(pool, ["d1", "d2"], "left")
            .select("row_id", F.when(F.col("labelled"), 0).otherwise(F.coalesce("gain", F.lit(0))).cast("bigint").alias("gain")))


# --- greedy selection ------------------------------------------------------------------------------

def _ball(points: DataFrame, center: np.ndarray, radius: float, outside: np.ndarray, delta: float) -> DataFrame:
    """The points within `radius` of a centre that are not within delta of the `outside` points (at most a batch): one scan."""
    def run(batches):
        for batch in batches:
            x = to_matrix(batch.column("features"), len(center))
            keep = within(x, center[None], radius)[:, 0] if len(x) else np.zeros(0, bool)
            if len(outside) and keep.any():
                keep[keep] = ~within(x[keep], outside, delta).any(1)
            yield batch.filter(pa.array(keep))

    return points.mapInArrow(run, points.schema)


def _near(points: DataFrame, index: PointIndex, center: np.ndarray, radius: float) -> DataFrame:
    """The points that may be within `radius` of a centre, by their distances to the pivots."""
    to_pivots = literal_array(_distances(center[None], index.pivots)[0])
    return points.where(F.abs(F.get(to_pivots, "cell") - F.col("dist")) <= radius + SLACK * (1 + radius + F.col("dist")))


def _losses(near: DataFrame, newly: DataFrame, delta: float, tiles: int) -> DataFrame:
    """(block, pid, m): the summed weight of the newly covered points within delta of each candidate near the pick.

    All of them lie in one ball, so no index could rule out much: strips by hash, every candidate strip meets every other.
    """
    deal = lambda name: F.pmod(F.xxhash64(name), F.lit(tiles)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    a = near.select(deal("pid").alias("ls"), every.alias("rs"), "block", "pid", "features")
    b = newly.select(deal("pid").alias("rs"), every.alias("ls"), F.lit(0).alias("block"), "pid", "features", "weight")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _two_sides(batches)
        total = np.zeros(len(a), dtype="int64")
        if len(a) and len(b):
            x, y, weight = a.features, b.features, b.numpy("weight")
            for s in range(0, len(x), BLOCK_ROWS):
                for t in range(0, len(y), BLOCK_ROWS):
                    total[s:s + BLOCK_ROWS] += within(x[s:s + BLOCK_ROWS], y[t:t + BLOCK_ROWS], delta) @ weight[t:t + BLOCK_ROWS]
        yield a.counted(total, "block", "pid")

    counted = _paired(a, b).applyInArrow(count, "block int, pid bigint, m bigint")
    return counted.groupBy("block", "pid").agg(F.sum("m").alias("m"))


class GainLog:
    """Candidates with their first gains, written once in blocks by descending score, and the losses since, as small tables.

    A block's best score, when last read, bounds its present one: gains only fall.
    """

    def __init__(self, gains: DataFrame, rows: int):
        spark = gains.sparkSession
        path, blocks = scratch_path(spark, "gains"), max(1, -(-rows // GAIN_ROWS))
        score = F.col("bonus") + F.col("gain")
        # Equal scores are split by id, so that no block is larger than the others.
        dealt = gains.withColumn("score", score).repartitionByRange(blocks, F.desc("score"), "pid")
        dealt.withColumn("block", F.spark_partition_id()).write.parquet(path, partitionBy="block")
        schema = T.StructType([*gains.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("block", T.IntegerType())])
        self.base = spark.read.schema(schema).parquet(path)
        self.bounds = {r["block"]: r["s"] for r in self.base.where("pool_id IS NOT NULL").groupBy("block").agg(F.max("score").alias("s")).collect()}
        self.losses: list[DataFrame] = []
        self.next_row: dict[int, int | None] = {}  # candidates picked before -> their next unlabelled copy
        self.read = 0  # blocks read, for tests

    def _best_of(self, blocks: list[int]) -> list:
        rows = self.base.where(F.col("block").isin(blocks)).drop("score")
        gain = F.col("gain")
        if self.losses:
            lost = reduce(DataFrame.unionByName, self.losses).where(F.col("block").isin(blocks)).groupBy("pid").agg(F.sum("m").alias("m"))
            rows, gain = rows.join(lost, "pid", "left"), F.col("gain") - F.coalesce("m", F.lit(0))
        row = F.col("pool_id")
        for pid, following in self.next_row.items():
            row = F.when(F.col("pid") == pid, F.lit(following).cast("bigint")).otherwise(row)
        rows = rows.select("block", "pid", "d1", "d2", "features", "bonus", row.alias("pool_id"), gain.alias("gain"), (F.col("bonus") + gain).alias("score"))
        self.read += len(blocks)
        return (rows.where("pool_id IS NOT NULL").groupBy("block").agg(F.min_by(F.struct("score", "gain", "pool_id", "pid", "d1", "d2", "features", "bonus"), F.struct(-F.col("score"), "pool_id")).alias("b"))
                .collect())

    def best(self):
        """The candidate of highest score, lowest id on ties; None if there is none."""
        found, seen = None, set()
        while True:
            open_ = sorted((b for b, s in self.bounds.items() if b not in seen and (found is None or s >= found.score)), key=lambda b: -self.bounds[b])[:BLOCKS_AT_ONCE]
            if not open_:
                return found
            seen.update(open_)
            now = {r["block"]: r["b"] for r in self._best_of(open_)}
            for block in open_:
                if block not in now:
                    del self.bounds[block]
                    continue
                self.bounds[block] = now[block].score
                if found is None or (-now[block].score, now[block].pool_id) < (-found.score, found.pool_id):
                    found = now[block]


def _greedy(df: DataFrame, delta: float, batch: int, bonus: Column | None) -> DataFrame:
    """Gains are exact for every row that is looked at, so the best one is exact. A group of copies with equal bonus is one
    candidate that lasts for as many picks as it has unlabelled rows, lowest id first."""
    spark = df.sparkSession
    mixed = bonus is not None
    df = df.withColumn("bonus", bonus if mixed else F.lit(0.0))
    index = _labelled_index(df, delta, ["bonus"])
    uncovered = _uncovered(index)
    waiting = cut_lineage(_with_digest(df.where(~F.col("labelled")), "bonus")) if mixed else None
    log = GainLog(_pool_gain(index, uncovered).select("pid", "d1", "d2", "features", "cell", "dist", "bonus", "pool_id", "gain"), index.size)
    rows: list[tuple] = []
    picked: list[list] = []
    while len(rows) < batch:
        best = log.best()
        if best is None or (not mixed and best.gain == 0):
            break
        rows.append((len(rows) + 1, best.pool_id, best.gain, best.score))
        if len(rows) == batch:
            break
        following = None
        if mixed:
            same = (F.col("d1") == best.d1) & (F.col("d2") == best.d2) & F.col("bonus").eqNullSafe(F.lit(best.bonus)) & (F.col("row_id") > best.pool_id)
            following = waiting.where(same).agg(F.min("row_id")).first()[0]
        log.next_row[best.pid] = following
        if best.gain:
            center = np.array(best.features, dtype=float)
            newly = _ball(_near(uncovered, index, center, delta), center, delta, np.array(picked, dtype=float), delta)
            reach = 2 * delta * (1 + SLACK)
            near = cut_lineage(_ball(_near(log.base, index, center, reach).select("block", "pid", "features"), center, reach, np.zeros((0, 1)), delta))
            log.losses.append(cut_lineage(_losses(near, newly, delta, max(1, -(-near.count() // TILE_ROWS)))))
            picked.append(best.features)
    return spark.createDataFrame(rows, "pick bigint, row_id bigint, gain bigint, score double")


def greedy_cover(df: DataFrame, delta: float, batch: int) -> DataFrame:
    """Up to `batch` picks: largest gain, lowest id on ties, until nothing is left to cover."""
    return _greedy(df, delta, batch, None).drop("score")


def mixed_cover(df: DataFrame, delta: float, batch: int, bonus: Column) -> DataFrame:
    """As `greedy_cover` with a fixed bonus per row (its entropy) added to the gain; picked rows lose the bonus."""
    return _greedy(df, delta, batch, bonus)


# --- entropy ---------------------------------------------------------------------------------------

def entropy(q: Column | str) -> Column:
    """-sum q ln q; 0 ln 0 is 0."""
    return -array_sum(F.transform(_c(q), lambda p: F.when(p > 0, p * F.log(p)).otherwise(0.0)))


def entropy_score(q0: Column | str, q1: Column | str) -> Column:
    return entropy(q0) + entropy(q1)


def top_entropy(df: DataFrame, batch: int, score: str = "score") -> DataFrame:
    """The `batch` unlabelled rows of highest score, lowest id on ties."""
    return df.where(~F.col("labelled")).orderBy(F.desc(score), "row_id").limit(batch)
