"""Clusters of the known labels, soft targets, and the distributions the co-training compares."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import _c, array_sum, literal_array, normalised
from ..functions.selection import exact_rank

MAX_SPAN, MAX_TIGHTEST, MIN_SPAN = 5.0, 1.0, 3.0  # fixed values of the cluster-count search
MIN_WEIGHT = 1e-4
MAX_VALUES = 4096  # distinct labels that are cells of their own
GRID, CUTS, ROUNDS = 2048, 64, 20  # beyond: first cells, cuts of a cell around a border, and passes at most


@dataclass(frozen=True)
class LabelClusters:
    centroids: list[float]
    max_span: float
    min_span: float

    @property
    def fits(self) -> bool:
        return MIN_SPAN <= self.max_span <= MAX_SPAN and self.min_span <= MAX_TIGHTEST


def cluster_spans(assigned: DataFrame, cluster: str = "cluster", label: str = "y") -> DataFrame:
    """The widest and the narrowest label span over the clusters."""
    spans = assigned.groupBy(cluster).agg((F.max(label) - F.min(label)).alias("span"))
    return spans.agg(F.max("span").alias("max_span"), F.min("span").alias("min_span"))


@dataclass
class _Cells:
    """Ranges of labels in ascending order: how many labels, their sum and sum of squares (about `base`), the least and the greatest."""

    weight: np.ndarray
    total: np.ndarray
    square: np.ndarray
    low: np.ndarray
    high: np.ndarray
    base: float


def _distinct_cells(values: list[tuple[float, int]]) -> _Cells:
    y, w = np.array([v for v, _ in sorted(values)], dtype=float), np.array([n for _, n in sorted(values)], dtype=float)
    base = float((y * w).sum() / w.sum())
    return _Cells(w, w * (y - base), w * (y - base) ** 2, y, y, base)


def _histogram(labels: DataFrame, edges: list[float]) -> _Cells:
    """One pass: a cell from each edge to the next, those without labels left out."""
    base, y = edges[len(edges) // 2], F.col("y")
    cells = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="y", outputCol="cell").transform(labels)
    rows = cells.groupBy("cell").agg(F.count("*").alias("w"), F.sum(y - base).alias("s"), F.sum((y - base) * (y - base)).alias("q"), F.min("y").alias("lo"), F.max("y").alias("hi")).collect()
    column = lambda name: np.array([r[name] for r in sorted(rows, key=lambda r: r["cell"])], dtype=float)
    return _Cells(*[column(c) for c in ("w", "s", "q", "lo", "hi")], base)


class LabelSegmentation:
    """Exact k-means in one dimension: clusters of labels are ranges, so a dynamic programme over their borders is optimal.

    Layer k holds the least cost of the first j cells in k clusters; the best first cell of the last cluster grows with j, so a
    layer is filled by halving, all ranges of a level at once. Layers serve every k. Up to `MAX_VALUES` distinct labels are
    cells of their own. Beyond that cells start at quantiles, and as long as a border would rather lie inside a cell (the middle
    between two centroids does), the cells around are cut finer, a pass each.
    """

    def __init__(self, labelled: DataFrame, label: str):
        known = F.col(label).cast("double")
        self.labels = labelled.select(known.alias("y")).where(known.isNotNull() & ~F.isnan(known))
        values = self.labels.groupBy("y").agg(F.count("*").alias("n")).limit(MAX_VALUES + 1).collect()
        self.edges: list[float] = []
        if len(values) <= MAX_VALUES:
            self.cells = _distinct_cells([tuple(v) for v in values]) if values else None
            self.most = len(values)
        else:
            cuts = [i / GRID for i in range(1, GRID)]
            self.edges = sorted(set(self.labels.agg(F.percentile_approx("y", cuts, 10 * GRID)).first()[0]))
            self.cells = _histogram(self.labels, self.edges)
            self.most = MAX_VALUES
        self._restart()

    def _restart(self) -> None:
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        if self.cells is not None:
            self.sums = [np.append(0.0, np.cumsum(c)) for c in (self.cells.weight, self.cells.total, self.cells.square)]

    def _cost(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        w, s, q = (c[j + 1] - c[i] for c in self.sums)
        return np.maximum(q - s * s / w, 0)

    def _layer(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.cells.weight)
        if k == 1:
            return self._cost(np.zeros(n, dtype=int), np.arange(n)), np.zeros(n, dtype=int)
        before = self.layers[k - 2][0]
        best, start = np.full(n, np.inf), np.zeros(n, dtype=int)
        low = first = np.array([k - 1])
        high = last = np.array([n - 1])
        while len(low):
            middle = (low + high) // 2
            sizes = np.minimum(last, middle) - first + 1
            offsets = np.cumsum(sizes) - sizes
            i = np.arange(sizes.sum()) - np.repeat(offsets - first, sizes)
            cost = before[i - 1] + self._cost(i, np.repeat(middle, sizes))
            least = np.minimum.reduceat(cost, offsets)
            hits = np.flatnonzero(cost == np.repeat(least, sizes))
            _, at = np.unique(np.repeat(np.arange(len(low)), sizes)[hits], return_index=True)
            chosen = i[hits[at]]
            best[middle], start[middle] = least, chosen
            low, high, first, last = (np.concatenate(c) for c in ((low, middle + 1), (middle - 1, high), (first, chosen), (chosen, last)))
            some = low <= high
            low, high, first, last = low[some], high[some], first[some], last[some]
        return best, start

    def _borders(self, k: int) -> list[int]:
        """First cells of the k clusters, and the number of cells."""
        while len(self.layers) < k:
            self.layers.append(self._layer(len(self.layers) + 1))
        borders = [len(self.cells.weight)]
        for layer in range(k, 0, -1):
            borders.append(int(self.layers[layer - 1][1][borders[-1] - 1]))
        return borders[::-1]

    def _finer(self, borders: list[int], centroids: list[float]) -> bool:
        """Cut cells in which a border would rather lie; False if there are none."""
        new = set()
        for at, a, b in zip(borders[1:-1], centroids, centroids[1:]):
            middle = (a + b) / 2
            for cell in np.flatnonzero((self.cells.low < middle) & (middle < self.cells.high)):
                low, high = self.cells.low[cell], self.cells.high[cell]
                new.update(float(v) for v in np.linspace(low, high, CUTS + 2)[1:])
                new.add(float(middle))
        new -= set(self.edges)
        if new:
            self.edges = sorted(set(self.edges) | new)
            self.cells = _histogram(self.labels, self.edges)
            self._restart()
        return bool(new)

    def clusters(self, k: int) -> LabelClusters:
        """The k clusters of least summed squared distance."""
        for _ in range(ROUNDS):
            borders = self._borders(min(k, len(self.cells.weight)))
            w, s, _ = ([c[j] - c[i] for i, j in zip(borders, borders[1:])] for c in self.sums)
            centroids = [float(self.cells.base + t / n) for t, n in zip(s, w)]
            spans = [float(self.cells.high[j - 1] - self.cells.low[i]) for i, j in zip(borders, borders[1:])]
            if not self.edges or not self._finer(borders, centroids):
                break
        return LabelClusters(centroids, max(spans), min(spans))


def adaptive_label_kmeans(labelled: DataFrame, k0: int, label: str = "y") -> LabelClusters:
    """K-means on the labels, growing or shrinking k by 2 until the spans fit.

    Clusters are exact for each k, so there is no seed. k stays between 2 and the number of distinct labels, and a k seen
    before ends the search (the rule can oscillate), so it ends; `fits` of the result tells whether the spans do.
    """
    found = LabelSegmentation(labelled, label)
    if found.most < 2:
        return LabelClusters([float(y) for y in found.cells.low] if found.cells is not None else [], 0.0, 0.0)
    clamp = lambda k: max(2, min(k, found.most))
    k, fits = clamp(k0), {}
    while True:
        now = fits[k] = found.clusters(k)
        if now.max_span > MAX_SPAN or now.min_span > MAX_TIGHTEST:
            step = 2
        elif now.max_span < MIN_SPAN:
            step = -2
        else:
            return now
        if clamp(k + step) in fits:
            return fits[min((k, clamp(k + step)), key=lambda i: fits[i].max_span)]
        k = clamp(k + step)


def representatives(labelled: DataFrame, centroids: list[float], label: str = "y") -> DataFrame:
    """For each centroid, the nearest labelled row (lowest id on ties), as (centroid_no, row_id, y).

    Centroids are few; each row meets them as one literal array and the minimum is combined map-side.
    """
    pairs = F.posexplode(literal_array(centroids)).alias("centroid_no", "centroid")
    return (labelled.select("row_id", F.col(label).alias("y"), pairs)
            .groupBy("centroid_no")
            .agg(F.min_by(F.struct("row_id", "y"), F.struct(F.abs(F.col("y") - F.col("centroid")), "row_id")).alias("r"))
            .select("centroid_no", "r.row_id", "r.y"))


def soft_targets(labelled: DataFrame, rep_labels: list[float], label: str = "y", out: str = "target") -> DataFrame:
    """max(2 - (y - y_c)^2 / 100, 1e-4) per representative, normalised to sum 1."""
    y = F.col(label)
    weight = lambda c: F.greatest(2 - (y - c) * (y - c) / 100, F.lit(MIN_WEIGHT))
    raw = F.array(*[weight(F.lit(float(c))) for c in rep_labels])
    return labelled.withColumn("_w", raw).withColumn(out, normalised("_w")).drop("_w")


def assign_t(features: Column | str, centers: list) -> Column:
    """Student-t assignment: q_c proportional to 1 / (1 + |z - c|^2). The centres (few) travel with the function, not in the plan."""
    c = np.asarray(centers, dtype=float)

    @F.pandas_udf("array<double>")
    def q(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        x = np.stack(rows.to_numpy())
        near = 1.0 / (1.0 + np.stack([((x - row) ** 2).sum(1) for row in c], axis=1))
        return pd.Series(list(near / near.sum(1, keepdims=True)))

    return q(_c(features))


def sharpen(q: Column | str) -> Column:
    """q^2 / sum(q), divided by its total."""
    total = array_sum(q)
    return normalised(F.transform(_c(q), lambda x: x * x / total))


def kl(target: Column | str, q: Column | str) -> Column:
    """Sum of t * (log t - log q) over the clusters; 0 * log 0 is 0."""
    term = lambda t, p: F.when(t > 0, t * (F.log(t) - F.log(p))).otherwise(0.0)
    return array_sum(F.zip_with(_c(target), _c(q), term))


def kl_sum(df: DataFrame, target: str, q0: str, q1: str, lam: float = 1.0) -> DataFrame:
    """Both views' losses: labelled rows (non-null target) against the target, all rows against the other view."""
    own = lambda q: F.coalesce(kl(target, q), F.lit(0.0))
    return df.agg(F.sum(own(q0) + lam * kl(q1, q0)).alias("loss_0"), F.sum(own(q1) + lam * kl(q0, q1)).alias("loss_1"))


LOSS_BLOCK = 8192  # steps per task-side window


def converged(losses: DataFrame, min_len: int = 20, tol: float = 0.015, run: str = "run", step: Column | str = "step",
              tie: str = "step", loss: str = "loss") -> DataFrame:
    """Per run and step: has the mean of the last 10 losses moved less than `tol` against the 10 before?

    A run may be long, so it is cut into blocks of consecutive steps; each block also gets the 19 steps before it.
    """
    ranked = exact_rank(losses, _c(step).cast("double"), tie, "_n", [run])
    own, place = F.expr(f"_n div {LOSS_BLOCK}"), F.col("_n") % LOSS_BLOCK
    blocks = F.when(place >= LOSS_BLOCK - 19, F.array(own, own + 1)).otherwise(F.array(own))
    steps = Window.partitionBy(run, "_block").orderBy("_n")
    last, before = F.avg(loss).over(steps.rowsBetween(-9, 0)), F.avg(loss).over(steps.rowsBetween(-19, -10))
    settled = (F.col("n") >= min_len) & (F.abs(F.col("_l") - F.col("_p")) < F.col("_l") * tol)
    return (ranked.withColumn("_block", F.explode(blocks)).withColumns({"n": F.col("_n") + 1, "_l": last, "_p": before})
            .where(F.col("_block") == own).withColumn("converged", F.coalesce(settled, F.lit(False)))
            .drop("_l", "_p", "_n", "_block"))


def has_converged(losses: list[float], min_len: int = 20, tol: float = 0.015) -> bool:
    """The same rule for the loss list a training loop keeps on the driver."""
    if len(losses) < max(min_len, 20):
        return False
    last, before = sum(losses[-10:]) / 10, sum(losses[-20:-10]) / 10
    return abs(last - before) < last * tol
