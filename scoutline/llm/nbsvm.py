"""Quality classifier: a linear SVM over naive Bayes features.

A text is the set of its byte n-grams (pairs as they are, runs of four hashed), whole texts, read in windows. Each present
n-gram counts with its class log-count ratio, the naive Bayes weight learnt from the training rows, scaled to unit length
per text. A hinge-loss linear model on these features is fitted by dual coordinate descent. Its margin becomes a
probability by a logistic curve fitted on training rows that the SVM did not see.

The training rows are a bounded sample, `max_rows` labelled rows chosen by a hash of their id, so the fit (one task) has a
fixed size; the sample's ids are the only thing broadcast. Scoring is one pass over all documents, without a shuffle.

Only texts enter a score. Rows whose label is null or whose id is null train nothing; of several labels of one document
the largest counts. Without labels of both classes the score is the smoothed share of label 1. Null and empty texts have
no n-grams and get the score of the bias. Null ids are carried and not held out. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage
from .common import only, text_of

MAX_ROWS = 10_000
HASH_BITS = 17
PAIRS = 1 << 16
FEATURES = PAIRS + (1 << HASH_BITS)
WINDOW = 1 << 20  # bytes of a text looked at at a time
ALPHA, COST, EPOCHS, SEED = 1.0, 1.0, 15, 5
CALIBRATION_SHARE = 5  # one row in five is kept for the logistic curve


def ngrams(text: str, seen: np.ndarray) -> np.ndarray:
    """Ids of the distinct n-grams of the text, in order. `seen`: FEATURES False values, left as they were."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    for at in range(0, len(raw), WINDOW):
        b = raw[at:at + WINDOW + 3].astype(np.uint32)
        pair = (b[:-1] << np.uint32(8)) | b[1:]
        seen[pair] = True
        four = (pair[:-2] << np.uint32(16)) | pair[2:]
        seen[PAIRS + ((four * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS))] = True
    ids = np.flatnonzero(seen).astype(np.int32)
    seen[ids] = False
    return ids


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of the smoothed document counts p and q of each n-gram in the two classes."""
    counts = []
    for c in (1, 0):
        ids = [r for r, label in zip(rows, y, strict=True) if label == c]
        n = ALPHA + np.bincount(np.concatenate(ids) if ids else np.zeros(0, np.int32), minlength=FEATURES)
        counts.append(np.log(n) - np.log(n.sum()))
    return counts[0] - counts[1]


def fit_hinge(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Dual coordinate descent for 1/2 |w|^2 + C sum of hinge losses; the bias is the last weight. Rows have unit length."""
    w, alpha = np.zeros(FEATURES + 1), np.zeros(len(rows))
    sign = np.where(y == 1, 1.0, -1.0)
    # both classes weigh the same in total
    limit = cost * np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    norm = np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(SEED)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = sign[i] * (w[rows[i]] @ values[i] + w[-1]) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), limit[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[rows[i]] += step * values[i]
                w[-1] += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def fit_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a margin + b))), by Newton steps with a little ridge; targets smoothed as Platt does."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    c = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - t) + 1e-3 * (c - [1.0, 0.0]))
        c = c - step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(c[0]), 1e-6), float(c[1])


def fit(texts: list[str], labels: list[int]) -> np.ndarray:
    """The model: one weight per n-gram (log-count ratio times SVM weight), bias, a, b."""
    y = np.asarray(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return np.concatenate([np.zeros(FEATURES + 1), [1.0, np.log(share / (1 - share))]])
    seen = np.zeros(FEATURES, dtype=bool)
    rows = [ngrams(t, seen) for t in texts]
    held = np.arange(len(rows)) % CALIBRATION_SHARE == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    inner = [r for r, h in zip(rows, held, strict=True) if not h]
    ratio = log_count_ratios(inner, y[~held])
    w = fit_hinge(inner, [_unit(ratio[r]).astype(np.float32) for r in inner], y[~held])
    weights = np.append(ratio * w[:-1], w[-1])
    lengths = ratio**2
    judge = held if held.any() else ~held
    margins = np.array([_margin(r, weights, lengths) for r, h in zip(rows, judge, strict=True) if h])
    return np.concatenate([weights, fit_curve(margins, y[judge]), ratio])


def _unit(v: np.ndarray) -> np.ndarray:
    return v / max(np.sqrt(v @ v), 1e-12)


def _margin(ids: np.ndarray, weights: np.ndarray, squares: np.ndarray) -> float:
    return float(weights[ids].sum() / max(np.sqrt(squares[ids].sum()), 1e-12) + weights[-1])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, train: str, max_rows: int) -> DataFrame:
    """(text, y, place) of at most `max_rows` labelled documents for which the SQL condition `train` on doc_id holds."""
    known = labels.select("doc_id", F.col(f"`{label}`").cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & F.expr(train))
    sample = cut_lineage(known.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(max_rows))
    return only(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").select(text_of().alias("text"), "y", "place")  # at most max_rows ids


def train_model(docs: DataFrame, labels: DataFrame, label: str = "quality", train: str = "true", max_rows: int = MAX_ROWS) -> np.ndarray:
    """Fit in one task on the bounded sample; the driver gets the model, whose size is fixed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for batch in batches for r in zip(batch["place"], batch["text"], batch["y"], strict=True)]
        rows.sort()
        model = fit([r[1] for r in rows], [int(r[2]) for r in rows])
        yield pd.DataFrame({"model": [model.astype("<f8").tobytes()]})

    rows = training_rows(docs, labels, label, train, max_rows)
    made = rows.repartition(1).mapInPandas(run, "model binary").first()
    return np.frombuffer(made.model, "<f8") if made else fit([], [])


def score(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """(doc_id, score) of every document."""
    weights, (a, b), ratio = model[:FEATURES + 1].copy(), model[FEATURES + 1:FEATURES + 3], model[FEATURES + 3:]
    squares = ratio**2 if len(ratio) else np.ones(FEATURES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(FEATURES, dtype=bool)
        for batch in batches:
            margins = np.array([_margin(ngrams(t, seen), weights, squares) for t in batch["text"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))})

    return (only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
            .mapInPandas(run, "doc_id bigint, score double"))
