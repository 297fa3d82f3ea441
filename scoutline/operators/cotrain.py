"""Co-training of one encoder per view.

Each view has a small network (linear, ReLU, linear) whose soft cluster assignment is pulled towards the label
targets and towards the other view's assignment. The loss is a sum over rows, so one epoch is one Spark job over a
table in the checkpoint folder: each core adds up gradients over Arrow batches with NumPy, the sums of the cores are
reduced chunk by chunk on the executors, and the driver only sees one gradient of the size of the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import literal_array, to_matrix
from ..functions.session import cut_lineage
from ..functions.sums import CHUNK, summed
from .reduce import map_matrices, map_matrix
from .targets import has_converged


@dataclass
class Encoder:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @staticmethod
    def create(width: int, hidden: int = 128, out: int = 64, seed: int = 0) -> "Encoder":
        rng = np.random.default_rng(seed)
        layer = lambda n, m: (rng.uniform(-1, 1, (n, m)) / np.sqrt(n), rng.uniform(-1, 1, m) / np.sqrt(n))
        w1, b1 = layer(width, hidden)
        w2, b2 = layer(hidden, out)
        return Encoder(w1, b1, w2, b2)

    def parts(self) -> list[np.ndarray]:
        return [self.w1, self.b1, self.w2, self.b2]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.w1 + self.b1, 0)
        return h, h @ self.w2 + self.b2

    def backward(self, x: np.ndarray, h: np.ndarray, dz: np.ndarray) -> list[np.ndarray]:
        dh = (dz @ self.w2.T) * (h > 0)
        return [x.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0)]


def assignment(z: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kernel values n_ik = 1 / (1 + |z_i - c_k|^2) and their row-normalised form q."""
    d2 = np.maximum((z * z).sum(1)[:, None] + (centers * centers).sum(1)[None] - 2 * z @ centers.T, 0)
    n = 1 / (1 + d2)
    return n, n / n.sum(1, keepdims=True)


def _divergence(t: np.ndarray, q: np.ndarray) -> float:
    """Sum of t (log t - log q), 0 log 0 being 0."""
    safe = np.where(t > 0, t, 1.0)
    return float((t * (np.log(safe) - np.log(q))).sum())


def row_gradients(encoders: list[Encoder], reps: list[np.ndarray], xs: list[np.ndarray], target: np.ndarray,
                  lam: float) -> list[tuple[float, list[np.ndarray], np.ndarray]]:
    """Per view: loss, parameter gradients through the rows, and the gradient with respect to the centres.

    A row without a label has a zero target. The other view's assignment is held fixed.
    """
    state = []
    for enc, rep, x in zip(encoders, reps, xs):
        h, z = enc.forward(x)
        centers = enc.forward(rep)[1]
        state.append((h, z, centers, *assignment(z, centers)))
    out = []
    for v, (enc, x) in enumerate(zip(encoders, xs)):
        h, z, centers, n, q = state[v]
        other = state[1 - v][4]
        t = target + lam * other
        a = n * (t - t.sum(1, keepdims=True) * q)
        dz = 2 * (a.sum(1, keepdims=True) * z - a @ centers)
        dc = -2 * (a.T @ z - a.sum(0)[:, None] * centers)
        loss = _divergence(target, q) + lam * _divergence(other, q)
        out.append((loss, enc.backward(x, h, dz), dc))
    return out


def full_gradients(encoders: list[Encoder], reps: list[np.ndarray], sums) -> list[tuple[float, list[np.ndarray]]]:
    """Add the part that flows through the centres: they are encodings of the representative rows."""
    out = []
    for enc, rep, (loss, grads, dc) in zip(encoders, reps, sums):
        h, _ = enc.forward(rep)
        out.append((loss, [g + c for g, c in zip(grads, enc.backward(rep, h, dc))]))
    return out


def _pack(views) -> np.ndarray:
    return np.concatenate([np.concatenate([[loss], *[g.ravel() for g in grads], dc.ravel()]) for loss, grads, dc in views])


def _unpack(flat: np.ndarray, encoders: list[Encoder], k: int):
    out, at = [], 0
    for enc in encoders:
        loss, at = float(flat[at]), at + 1
        shapes = [p.shape for p in enc.parts()] + [(k, enc.b2.size)]
        parts = []
        for shape in shapes:
            size = int(np.prod(shape))
            parts.append(flat[at:at + size].reshape(shape))
            at += size
        out.append((loss, parts[:-1], parts[-1]))
    return out


def _epoch_sums(rows: DataFrame, encoders: list[Encoder], reps: list[np.ndarray], lam: float):
    k = len(reps[0])
    shared = rows.sparkSession.sparkContext.broadcast((encoders, reps))

    def gradients(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        nets, centres = shared.value
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            xs = [to_matrix(batch.column("x0")), to_matrix(batch.column("x1"))]
            part = _pack(row_gradients(nets, centres, xs, to_matrix(batch.column("target")), lam))
            total = part if total is None else np.add(total, part, out=total)
        return total

    flat = summed(rows.select("x0", "x1", "target"), gradients, CHUNK)
    shared.unpersist()
    return _unpack(flat, encoders, k)


@dataclass
class Adam:
    lr: float = 1e-3
    step_no: int = 0
    m: list = field(default_factory=list)
    v: list = field(default_factory=list)

    def step(self, params: list[np.ndarray], grads: list[np.ndarray]) -> None:
        if not self.m:
            self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        self.step_no += 1
        for p, g, m, v in zip(params, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.lr * (m / (1 - 0.9 ** self.step_no)) / (np.sqrt(v / (1 - 0.999 ** self.step_no)) + 1e-8)


def training_rows(aligned: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(row_id, x0, x1, target): the aligned views with the soft target, zeros where there is no label."""
    zeros = literal_array([0.0] * k)
    return (aligned.select("row_id", "x0", "x1").join(targets.select("row_id", "target"), "row_id", "left")
            .withColumn("target", F.coalesce("target", zeros)))


def cotrain(rows: DataFrame, reps: list[np.ndarray], encoders: list[Encoder], epochs: int, lr: float = 1e-3,
            lam: float = 1.0, min_len: int = 20, tol: float = 0.015) -> tuple[list[Encoder], list[tuple[float, float]]]:
    """Full-batch Adam on both views; stops when both losses have settled. Returns the encoders and the losses.

    The optimizer starts afresh at every call, the weights go on from the ones given.
    """
    encoders = [Encoder(*[p.copy() for p in enc.parts()]) for enc in encoders]
    optimizers = [Adam(lr), Adam(lr)]
    losses: list[tuple[float, float]] = []
    rows = cut_lineage(rows.select("x0", "x1", "target"))
    for _ in range(epochs):
        grads = full_gradients(encoders, reps, _epoch_sums(rows, encoders, reps, lam))
        for enc, opt, (_, g) in zip(encoders, optimizers, grads):
            opt.step(enc.parts(), g)
        losses.append((grads[0][0], grads[1][0]))
        if all(has_converged([pair[v] for pair in losses], min_len, tol) for v in (0, 1)):
            break
    return encoders, losses


def encode(df: DataFrame, encoder: Encoder, col: str = "features", out: str = "z") -> DataFrame:
    """The encoding of every row."""
    shared = df.sparkSession.sparkContext.broadcast(encoder)
    return map_matrix(df, [col], lambda x: shared.value.forward(x)[1], out)


def cluster_view(df: DataFrame, encoder: Encoder, reps: np.ndarray, col: str = "features", out: str = "q") -> DataFrame:
    """The cluster assignment of every row, against the present encodings of the representatives."""
    shared = df.sparkSession.sparkContext.broadcast((encoder, encoder.forward(reps)[1]))

    def q(x: np.ndarray) -> np.ndarray:
        enc, centers = shared.value
        return assignment(enc.forward(x)[1], centers)[1]

    return map_matrix(df, [col], q, out)


def encode_views(df: DataFrame, encoders: list[Encoder], reps: list[np.ndarray]) -> DataFrame:
    """z0, z1, q0, q1: encodings and cluster assignments of x0 and x1, as `encode` and `cluster_view` give them, in one pass."""
    shared = df.sparkSession.sparkContext.broadcast([(enc, enc.forward(rep)[1]) for enc, rep in zip(encoders, reps)])

    def both(*xs: np.ndarray) -> list[np.ndarray]:
        z = [enc.forward(x)[1] for (enc, _), x in zip(shared.value, xs)]
        return z + [assignment(encoded, centers)[1] for (_, centers), encoded in zip(shared.value, z)]

    return map_matrices(df, ["x0", "x1"], both, ["z0", "z1", "q0", "q1"])
