"""Truncated SVD: an uncentered rank-k projection of a feature view.

`fit_svd` leaves the choice of the decomposition to MLlib. `fit_svd_wide` is for wide input: a randomized range finder with
a fixed number of passes over the rows and nothing on the driver that grows with the square of the width.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import to_matrix
from ..functions.session import cut_lineage
from ..functions.sums import summed, triangle
from .features import slots_to_vector


def map_matrix(df: DataFrame, inputs: list[str], fn, out: str, width_type: str = "array<double>") -> DataFrame:
    """Add `out`, one array per row, computed from whole Arrow batches of the input arrays with NumPy."""
    return map_matrices(df, inputs, lambda *xs: [fn(*xs)], [out], width_type)


def map_matrices(df: DataFrame, inputs: list[str], fn, outs: list[str], width_type: str = "array<double>") -> DataFrame:
    """As `map_matrix` for several columns at once, `fn` giving one matrix for each: one Python worker per task, where a chain of
    calls would start one per column."""
    kept = [f for f in df.schema.fields if f.name not in outs]
    schema = T.StructType(kept + [T.StructField(out, T._parse_datatype_string(width_type)) for out in outs])
    keep = [f.name for f in kept]

    def as_lists(z: np.ndarray) -> pa.Array:
        z = np.ascontiguousarray(z)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32)), pa.array(z.ravel()))

    def run(batches):
        for batch in batches:
            made = fn(*[to_matrix(batch.column(c)) for c in inputs]) if batch.num_rows else [np.zeros((0, 1)) for _ in outs]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [as_lists(z) for z in made], names=keep + outs)

    return df.mapInArrow(run, schema)


ROWS_AT_ONCE = 512  # rows that a task holds as a dense block
SPARSE_ROWS = 4096  # rows that a task holds as slots
GRAM_WIDTH = 1024   # slots up to which the matrix of their square is made
RANK_LIMIT = 1e-9   # as MLlib: singular values below this share of the first are none


@dataclass(frozen=True)
class _Sparse:
    """0/1 rows as their set slots one after another; `ends` is where each row ends."""

    slots: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(column: pa.Array) -> "_Sparse":
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return _Sparse(column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths))

    def times(self, w: np.ndarray) -> np.ndarray:
        """The rows times a matrix: sums of its rows, a group of equally long rows at a time."""
        starts = np.append(0, self.ends[:-1])
        lengths, out = self.ends - starts, np.zeros((len(self.ends), w.shape[1]))
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            for k in range(length):
                out[rows] += w[self.slots[starts[rows] + k]]
        return out

    def back(self, y: np.ndarray, total: np.ndarray) -> None:
        """Add the transpose of the rows times `y` to `total`: slots are put in order, and each adds up its rows of `y`."""
        order = np.argsort(self.slots, kind="stable")
        if len(order):
            slots = self.slots[order]
            first = np.append(0, np.flatnonzero(np.diff(slots)) + 1)
            row = np.repeat(np.arange(len(self.ends)), np.diff(np.append(0, self.ends)))
            total[slots[first]] += np.add.reduceat(y[row[order]], first)


def _blocks(batches, col: str, width: int, sparse: bool):
    """Dense blocks of rows: of arrays as they are, of 0/1 rows from their set slots."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            rows = batch.column(col).slice(start, ROWS_AT_ONCE)
            if sparse:
                x = np.zeros((len(rows), width))
                x[np.repeat(np.arange(len(rows)), rows.value_lengths().to_numpy(zero_copy_only=False)), rows.flatten().to_numpy(zero_copy_only=False)] = 1.0
                yield x
            else:
                yield to_matrix(rows, width)


@dataclass(frozen=True)
class SvdModel:
    components: np.ndarray  # columns x k: bounded by the feature width, never by the rows
    singular_values: np.ndarray

    def transform(self, df: DataFrame, col: str = "features") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.components)
        return map_matrix(df, [col], lambda x: x @ shared.value, col)

    def transform_slots(self, df: DataFrame, slots: str = "slots", out: str = "features") -> DataFrame:
        """Projection of sparse 0/1 rows: the sum of the component rows of the set slots."""
        shared = df.sparkSession.sparkContext.broadcast(self.components)

        def project(batches):
            for batch in batches:
                for start in range(0, batch.num_rows, SPARSE_ROWS):
                    part = batch.slice(start, SPARSE_ROWS)
                    z = _Sparse.of(part.column(slots)).times(shared.value)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [lists], names=[*kept, out])

        kept = [c for c in df.columns if c != out]
        return df.mapInArrow(project, T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.ArrayType(T.DoubleType()))]))


def fit_svd(df: DataFrame, k: int, col: str = "features") -> SvdModel:
    """Fit on every row of `df`; k is cut to what rows and columns allow.

    MLlib chooses between a local decomposition of the Gram matrix (narrow) and distributed
    Gram-times-vector products (wide).
    """
    df = cut_lineage(df.select(col))  # the iterative fit reads it many times
    width, rows = df.select(F.size(col)).first()[0], df.count()
    return _fit(df.select(array_to_vector(F.col(col)).alias("v")), rows, width, k)


def fit_svd_slots(df: DataFrame, width: int, k: int, slots: str = "slots") -> SvdModel:
    """As `fit_svd` for sparse 0/1 rows given by their set slots, without making them dense.

    Up to `GRAM_WIDTH` slots, one pass counts how often each pair of slots is set together: exact whole numbers, the Gram matrix,
    whose decomposition on the driver gives the components. Wider input is left to MLlib, which makes a pass per iteration.
    """
    df = cut_lineage(df.select(slots))
    if width > GRAM_WIDTH:
        return _fit(slots_to_vector(df, slots, width, "v").select("v"), df.count(), width, k)

    def gram(batches) -> np.ndarray | None:
        total = rows = None
        for x in _blocks(batches, slots, width, True):
            rows = (rows or 0) + len(x)
            part = x.T @ x
            total = part if total is None else np.add(total, part, out=total)
        return None if total is None else np.append(total.ravel(), rows)

    found = summed(df, gram)
    if found is None:
        raise ValueError("no rows to fit on")
    values, v = np.linalg.eigh(found[:-1].reshape(width, width))
    top = np.argsort(-values, kind="stable")[:min(k, int(found[-1]), width)]
    s = np.sqrt(np.maximum(values[top], 0))
    kept = s > RANK_LIMIT * s[0] if len(s) else np.zeros(0, bool)
    return SvdModel(_signed(v[:, top][:, kept]), s[kept])


def _signed(v: np.ndarray) -> np.ndarray:
    """A fixed sign per component."""
    return v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])


def _fit(vectors: DataFrame, rows: int, width: int, k: int) -> SvdModel:
    vectors = MLUtils.convertVectorColumnsFromML(vectors, "v")
    svd = RowMatrix(vectors, rows, width).computeSVD(min(k, rows, width))
    v = svd.V.toArray()
    return SvdModel(_signed(v), np.array(svd.s))


def _sparse_blocks(batches, col: str):
    for batch in batches:
        for start in range(0, batch.num_rows, SPARSE_ROWS):
            yield _Sparse.of(batch.column(col).slice(start, SPARSE_ROWS))


def fit_svd_wide(df: DataFrame, width: int, k: int, passes: int = 4, oversample: int = 32, seed: int = 0, col: str = "features", sparse: bool = False) -> SvdModel:
    """Rank-k SVD by a randomized range finder: `passes` jobs, each one pass over the rows, whatever the width.

    The first pass multiplies the rows with a sign sketch of k + oversample columns, which every task generates from the seed,
    and back with the rows' transpose; each further pass does so with an orthonormal basis of what came back (a power
    iteration). The last pass projects the rows on the basis; the tall-skinny QR of that, reduced in a tree, gives singular
    values and components. Exact if k + oversample reaches the rank; otherwise the error falls with every pass.
    With `sparse`, `col` holds the set slots of 0/1 rows; work grows with the slots set, not with the width.
    """
    if passes < 2:
        raise ValueError("a fit needs a pass that finds the range and one that projects on it")
    rows, size = cut_lineage(df.select(col)), min(width, k + oversample)
    read = lambda batches: _sparse_blocks(batches, col) if sparse else _blocks(batches, col, width, False)
    basis = None
    for _ in range(passes - 1):
        shared = df.sparkSession.sparkContext.broadcast(basis) if basis is not None else None

        def back(batches) -> np.ndarray | None:
            w = shared.value if shared is not None else np.random.default_rng(seed).integers(0, 2, (width, size)) * 2.0 - 1.0
            total = None
            for x in read(batches):
                total = np.zeros((width, size)) if total is None else total
                if sparse:
                    x.back(x.times(w), total)
                else:
                    total += x.T @ (x @ w)
            return None if total is None else total.ravel()

        image = summed(rows, back)
        if image is None:
            raise ValueError("no rows to fit on")
        basis = np.linalg.qr(image.reshape(width, size))[0]
        if shared is not None:
            shared.unpersist()
    final = df.sparkSession.sparkContext.broadcast(basis)
    r = triangle(rows, lambda batches: (x.times(final.value) if sparse else x @ final.value for x in read(batches)), size)
    _, s, v = np.linalg.svd(r, full_matrices=False)
    v = basis @ v[:k].T
    return SvdModel(_signed(v), s[:k])


def total_variance(col: Column) -> Column:
    """Sum of the population variances of the slots, as an aggregate over ARRAY<DOUBLE>."""
    return Summarizer.metrics("variance", "count").summary(array_to_vector(col))


def explained_variance_ratio(df: DataFrame, projected: str, original: str) -> DataFrame:
    """Summed variance of the projection over the summed variance of the input, in one pass."""
    s = df.agg(total_variance(F.col(projected)).alias("p"), total_variance(F.col(original)).alias("o"))
    total = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, x: a + x)
    return s.select((total("p.variance") / total("o.variance")).alias("explained_variance_ratio"))


def truncated_svd(df: DataFrame, k: int, fit_on: DataFrame | None = None, col: str = "features") -> tuple[DataFrame, float]:
    """Projected rows and the explained-variance ratio; `fit_on` widens the fit beyond the rows projected."""
    fit_rows = df if fit_on is None else fit_on
    model = fit_svd(fit_rows, k, col)
    both = cut_lineage(model.transform(fit_rows.withColumn("_original", F.col(col)), col))
    ratio = explained_variance_ratio(both, col, "_original").first()[0]
    return both.select(*df.columns) if fit_on is None else model.transform(df, col), ratio
