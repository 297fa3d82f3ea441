"""The whole loop: targets, co-training, evaluation, acquisition, until enough rows are labelled.

A round leaves its picks, encoders and metrics below a folder of the loop and, last, a line that says it is done. Another driver
goes on after the last round that is done; what a lost driver left of the next one is overwritten.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import concurrently, cut_lineage, scratch_path
from ..operators import coverage, cotrain, evaluate, targets
from ..operators.features import align_views, assemble
from ..operators.splits import initial_set
from .recommend import recommend


@dataclass
class LoopSettings:
    start: int = 99
    step: int = 25
    total: int = 199
    method: str = "prob"
    hidden: int = 128
    out: int = 64
    clusters: int = 24
    epochs: int = 100
    final_clusters: int = 30
    final_epochs: int = 300
    lr: float = 1e-3
    lam: float = 1.0
    delta: float | None = None  # None: from k-means on the encodings, each round
    trees: int = 100
    seed: int = 0
    kinds: tuple[str, ...] = ("original", "encoded", "cluster")  # features that each round is evaluated on
    settle: tuple[float, int] = (0.0, 20)  # losses may settle after share * labelled rows + base epochs
    final_only: bool = False  # no acquisition: the start set is labelled and the final round is the only one


@dataclass
class RoundResult:
    metrics: list[dict]
    picks: DataFrame | None
    encoders: list[cotrain.Encoder]
    losses: list[tuple[float, float]] = field(default_factory=list)
    encoded: DataFrame | None = None  # (row_id, x0, x1, y, labelled, z0, z1, q0, q1), a table


def _feature_rows(aligned: DataFrame, ids: list[int], col: str) -> np.ndarray:
    """The feature rows of the representatives (one per cluster), in the order of `ids`."""
    rows = {r["row_id"]: r[col] for r in aligned.where(F.col("row_id").isin(ids)).select("row_id", col).collect()}
    return np.array([rows[i] for i in ids], dtype=float)


def one_round(aligned: DataFrame, labelled_ids: DataFrame, encoders: list[cotrain.Encoder], settings: LoopSettings,
              clusters: int, epochs: int, acquire: bool = True, evaluate_model: bool = True) -> RoundResult:
    """One round over (row_id, x0, x1, y) and the ids labelled so far."""
    s = settings
    flag = labelled_ids.select("row_id", F.lit(True).alias("labelled"))
    df = aligned.join(flag, "row_id", "left").withColumn("labelled", F.coalesce("labelled", F.lit(False)))
    known = df.where("labelled").select("row_id", "y").persist()
    found = targets.adaptive_label_kmeans(known, clusters)
    reps = targets.representatives(known, found.centroids).orderBy("centroid_no").collect()
    rep_ids = [r["row_id"] for r in reps]
    rep_x = [_feature_rows(aligned, rep_ids, col) for col in ("x0", "x1")]
    soft = targets.soft_targets(known, [r["y"] for r in reps])
    rows = cotrain.training_rows(aligned, soft, len(reps))
    min_len = int(s.settle[0] * known.count() + s.settle[1])
    encoders, losses = cotrain.cotrain(rows, rep_x, encoders, epochs, s.lr, s.lam, min_len)
    encoded = cut_lineage(cotrain.encode_views(df, encoders, rep_x))
    known.unpersist()
    metrics = _evaluate(encoded, s) if evaluate_model else []
    picks = None
    if acquire:
        space = assemble(encoded, ["z0", "z1"]).withColumn("bonus", coverage.entropy_score("q0", "q1"))
        delta = s.delta or coverage.coverage_radius(space, len(found.centroids), s.seed)
        picks = recommend(space.select("row_id", "features", "labelled", "bonus"), s.method, s.step, delta, F.col("bonus"))
    for m in metrics:
        m["n_clusters"], m["epochs"] = len(found.centroids), len(losses)
    return RoundResult(metrics, picks, encoders, losses, encoded)


def _evaluate(encoded: DataFrame, s: LoopSettings) -> list[dict]:
    """Metrics on the unlabelled rows, for the original, encoded and cluster features of both views."""
    kinds = [(f"view_{v}", kind, f"{col}{v}") for v in (0, 1)
             for kind, col in (("original", "x"), ("encoded", "z"), ("cluster", "q")) if kind in s.kinds]

    def predict(item: tuple) -> DataFrame:
        view, kind, col = item
        return (evaluate.fit_predict_rf(encoded, F.col("labelled"), col, "y", s.seed, s.trees).where(~F.col("labelled"))
                .select(F.lit(view).alias("view"), F.lit(kind).alias("kind"), "row_id", "y", "pred"))

    preds = reduce(DataFrame.unionByName, concurrently(encoded.sparkSession, predict, kinds, 3))
    return [r.asDict() for r in evaluate.evaluate_representations(preds).collect()]


METRICS = "n_labelled bigint, method string, view string, kind string, r2 double, mae double, rmse double, n_clusters int, epochs int"
WEIGHTS = "view int, part int, rows int, weights array<double>"


class LoopLog:
    """Tables of a loop below `root`, one folder per round each. Only rounds with a line in `done` count."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def done(self) -> list:
        """(round, final) of the finished rounds, in order."""
        try:
            return self.read("done", "final boolean").orderBy("round").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def read(self, name: str, schema: str, last: int | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{schema}, round int").parquet(f"{self.root}/{name}")
        return rows if last is None else rows.where(F.col("round") <= last)

    def write(self, name: str, round_no: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/round={round_no}")

    def encoders(self, round_no: int) -> list[cotrain.Encoder]:
        rows = self.read("encoders", WEIGHTS).where(F.col("round") == round_no).orderBy("view", "part").collect()
        parts = [np.array(r["weights"]).reshape(r["rows"], -1) if r["rows"] else np.array(r["weights"]) for r in rows]
        return [cotrain.Encoder(*parts[i:i + 4]) for i in range(0, len(parts), 4)]

    def commit(self, round_no: int, result: RoundResult, have: int, method: str, final: bool) -> None:
        weights = [(v, p, len(w) if w.ndim == 2 else 0, w.ravel().tolist()) for v, e in enumerate(result.encoders) for p, w in enumerate(e.parts())]
        self.write("encoders", round_no, self.spark.createDataFrame(weights, WEIGHTS).coalesce(1))
        metrics = [{"n_labelled": have, "method": method, **m} for m in result.metrics]
        self.write("metrics", round_no, self.spark.createDataFrame(metrics, METRICS).coalesce(1))
        if result.picks is not None:
            self.write("picks", round_no, result.picks.select("row_id"))
        self.write("done", round_no, self.spark.createDataFrame([(final,)], "final boolean").coalesce(1))


def active_loop(v0: DataFrame, v1: DataFrame, settings: LoopSettings, root: str | None = None) -> DataFrame:
    """Rounds until `total` rows are labelled, and a last one for evaluation only. One metric row per view and kind, by round.

    Labels of the picked rows are revealed from `y`, as when a method is tested on known data. A call with the `root` of an
    earlier one, of the same views and settings, goes on where that ended; a finished loop only returns its metrics.
    """
    s = settings
    spark = v0.sparkSession
    log = LoopLog(spark, root or scratch_path(spark, "loop"))
    aligned = cut_lineage(align_views(v0, v1))
    start = cut_lineage(initial_set(aligned.select("row_id"), n=s.start, seed=s.seed))
    widths = aligned.select(F.size("x0").alias("a"), F.size("x1").alias("b")).first()
    encoders = [cotrain.Encoder.create(w, s.hidden, s.out, s.seed + i) for i, w in enumerate((widths["a"], widths["b"]))]
    done = log.done()
    round_no = len(done)
    if done:
        encoders = log.encoders(round_no - 1)
    before, ended = None, bool(done) and done[-1]["final"]
    if round_no > 1:
        before = _labelled(log, start, round_no - 2).count()
    while not ended:
        labelled = _labelled(log, start, round_no - 1)
        have = labelled.count()
        ended = s.final_only or have >= s.total or have == before  # nothing picked: everything is covered, the last round comes early
        result = one_round(aligned, labelled, encoders, s, s.final_clusters if ended else s.clusters,
                           s.final_epochs if ended else s.epochs, acquire=not ended)
        log.commit(round_no, result, have, s.method, ended)
        encoders, before, round_no = result.encoders, have, round_no + 1
    rows = log.read("metrics", METRICS, round_no - 1)
    return rows.select("round", *[c for c in rows.columns if c != "round"]).orderBy("round")


def _labelled(log: LoopLog, start: DataFrame, last: int) -> DataFrame:
    """The start set and the picks of the rounds up to `last`."""
    picked = start.select("row_id")
    return picked if last < 0 else picked.unionByName(log.read("picks", "row_id bigint", last).select("row_id"))
