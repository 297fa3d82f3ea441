"""Prediction with MLlib, and the regression metrics of a prediction table (row_id, y, pred)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.selection import group_thresholds, thresholds
from ..functions.session import concurrently, cut_lineage
from .features import binarize

RATIOS = [0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50]  # fixed values of the metric report
FOREST_ROWS = 1024    # labelled rows up to which one fit grows the whole forest
TREES_AT_ONCE = 10    # trees that a fit grows beyond that
ROWS_A_TASK = 32768   # labelled rows that a task of such a fit reads
SEED_STEP = 1_000_003  # between the seeds of two fits; MLlib adds the number of the partition


def fit_predict_rf(df: DataFrame, labelled: Column, features: str = "features", label: str = "y", seed: int = 0,
                   trees: int = 100) -> DataFrame:
    """Random forest fitted on the labelled rows, predicting every row as `pred`.

    MLlib keeps statistics of every feature and bin for each node in each partition, however few rows the node has, and makes a
    pass for each group of nodes that fits its memory: in one fit these passes follow one another, each on few cores. Trees do not
    depend on each other, so a forest on many rows is grown by several fits at once, of `TREES_AT_ONCE` trees and a seed each,
    over one written table; `pred` is the mean over all trees. MLlib draws by place, so there rows are placed by their hash:
    the same rows give the same forest, whatever the files and cores.
    """
    vec = df.withColumn("_v", array_to_vector(F.col(features)))
    train, parts = vec.where(labelled), 1
    if trees > TREES_AT_ONCE and (rows := train.count()) > FOREST_ROWS:
        key = F.xxhash64(*[c for c in ("row_id",) if c in df.columns], features, label)
        train = cut_lineage(train.select("_v", label, key.alias("_key"))).repartition(-(-rows // ROWS_A_TASK), "_key").sortWithinPartitions("_key")
        parts = -(-trees // TREES_AT_ONCE)
    sizes = [trees // parts + (i < trees % parts) for i in range(parts)]
    names = ["pred"] if parts == 1 else [f"_pred_{i}" for i in range(parts)]

    def fit(i: int):
        forest = RandomForestRegressor(featuresCol="_v", labelCol=label, predictionCol=names[i], numTrees=sizes[i], maxDepth=30,
                                       featureSubsetStrategy="all", seed=seed + i * SEED_STEP)
        return forest.fit(train)

    out = vec
    for model in concurrently(df.sparkSession, fit, range(parts), parts):
        out = model.transform(out)
    if parts > 1:
        out = out.withColumn("pred", reduce(add, [F.col(c) * n for c, n in zip(names, sizes)]) / trees).drop(*names)
    return out.drop("_v")


def regression_metrics(df: DataFrame, by: list[str] = (), label: str = "y", pred: str = "pred") -> DataFrame:
    """R2, MAE and RMSE; R2 is null when the labels do not vary. One aggregate, no second pass for the mean."""
    y, err = F.col(label), F.col(label) - F.col(pred)
    ss_tot = F.count(y) * F.var_pop(y)
    r2 = F.when(F.min(y) < F.max(y), 1 - F.sum(err * err) / ss_tot)
    aggs = [r2.alias("r2"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)



def top_ratio_mae(df: DataFrame, ratios: list[float] = RATIOS, label: str = "y", pred: str = "pred") -> DataFrame:
    """MAE over the int(n * ratio) rows with the highest true labels (lowest id first on ties); null for none.

    The cut of each ratio comes from `thresholds`; all ratios are then conditional sums of one scan.
    """
    ks: dict[float, int] = {}

    def wanted(n: int) -> list[int]:
        ks.update({r: int(n * r) for r in ratios})
        return sorted({k for k in ks.values() if k})

    found = thresholds(df, -F.col(label), "row_id", wanted)
    cuts = dict(zip(sorted({k for k in ks.values() if k}), found))
    err, key = F.abs(F.col(label) - F.col(pred)), -F.col(label)

    def mae(k: int) -> Column:
        if k == 0:
            return F.lit(None).cast("double")
        top, last = cuts[k]
        return F.avg(F.when((key < top) | ((key == top) & (F.col("row_id") <= last)), err))

    named = [F.struct(F.lit(r).alias("ratio"), F.lit(ks[r]).cast("bigint").alias("k"), mae(ks[r]).alias("mae")) for r in ratios]
    return df.agg(F.array(*named).alias("_a")).select(F.explode("_a").alias("m")).select("m.*")


def rank_threshold_confusion(df: DataFrame, ratios: list[float] = RATIOS, label: str = "y",
                             pred: str = "pred") -> DataFrame:
    """Counts and F1 against the label at ascending index int(n * ratio).

    Comparisons are strict: a label or prediction equal to the threshold is counted nowhere. A zero
    denominator gives null.
    """
    cuts = thresholds(df, F.col(label), "row_id", lambda n: [int(r * n) + 1 for r in ratios])
    y, p = F.col(label), F.col(pred)
    counts = [F.struct(F.lit(r).alias("ratio"), F.lit(c).alias("threshold"),
                       F.count_if((y > c) & (p > c)).alias("tp"), F.count_if((y < c) & (p < c)).alias("tn"),
                       F.count_if((y > c) & (p < c)).alias("fn"), F.count_if((y < c) & (p > c)).alias("fp"))
              for r, (c, _) in zip(ratios, cuts)]
    rows = df.agg(F.array(*counts).alias("_a")).select(F.explode("_a").alias("m")).select("m.*")
    return with_f1(rows)


def with_f1(rows: DataFrame) -> DataFrame:
    tp = F.col("tp")
    precision = F.when(tp + F.col("fp") > 0, tp / (tp + F.col("fp")))
    recall = F.when(tp + F.col("fn") > 0, tp / (tp + F.col("fn")))
    return (rows.withColumns({"_p": precision, "_r": recall})
            .withColumn("f1", F.when(F.col("_p") + F.col("_r") > 0, 2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r"))))
            .drop("_p", "_r"))


def error_curve(df: DataFrame, ratios: list[float] = RATIOS, label: str = "y", pred: str = "pred") -> DataFrame:
    """(ratio, MAE of the top rows, 1 / F1), the data of the error plot."""
    df = cut_lineage(df.select("row_id", label, pred))  # read by both searches and both reports
    mae = top_ratio_mae(df, ratios, label, pred).select("ratio", "mae")
    f1 = rank_threshold_confusion(df, ratios, label, pred).select("ratio", (1 / F.col("f1")).alias("inverse_f1"))
    return mae.join(f1, "ratio")


def evaluate_representations(preds: DataFrame) -> DataFrame:
    """R2, MAE and RMSE per view and kind of features (original, encoded, cluster)."""
    return regression_metrics(preds, ["view", "kind"])


def representation_report(preds: DataFrame, by: list[str] = ("view", "kind"), ratios: list[float] = RATIOS, label: str = "y",
                          pred: str = "pred") -> DataFrame:
    """R2, MAE and RMSE of each group with, per ratio, the MAE of its top rows and the counts and F1 at its label threshold.

    No row is sorted: both cuts of every group and ratio come from `group_thresholds`, and all ratios are then conditional
    aggregates of one scan. Groups with a null in `by` are left out.
    """
    by = list(by)
    base = cut_lineage(preds.select(*by, "row_id", F.col(label).alias("y"), F.col(pred).alias("pred")))
    place = lambda r: F.floor(F.col("n") * F.lit(r)).cast("bigint")
    ways = F.explode(F.array(F.struct(F.lit(0).alias("_way"), F.col("y").alias("_v")), F.struct(F.lit(1).alias("_way"), (-F.col("y")).alias("_v"))))
    both = base.select(*by, "row_id", ways.alias("w")).select(*by, "row_id", "w.*")
    found = cut_lineage(group_thresholds(both, [*by, "_way"], F.col("_v"), F.col("row_id"), {
        str(i): place(r) + F.when(F.col("_way") == 0, 1).otherwise(0) for i, r in enumerate(ratios)}))
    up, down = F.col("_way") == 0, F.col("_way") == 1
    of = lambda way, i, c: F.max(F.when(way & (F.col("target") == str(i)), F.col(c)))
    cuts = found.groupBy(*by).agg(*[F.struct(of(up, i, "key").alias("threshold"), of(down, i, "key").alias("top"), of(down, i, "tie").alias("last")).alias(f"_c{i}")
                                    for i in range(len(ratios))])
    y, p, err = F.col("y"), F.col("pred"), F.abs(F.col("y") - F.col("pred"))

    def row(i: int, r: float) -> Column:
        c, top, last = F.col(f"_c{i}.threshold"), F.col(f"_c{i}.top"), F.col(f"_c{i}.last")
        best = (-y < top) | ((-y == top) & (F.col("row_id") <= last))
        return F.struct(F.lit(r).alias("ratio"), F.floor(F.count("y") * F.lit(r)).cast("bigint").alias("k"), F.max(c).alias("threshold"),
                        F.avg(F.when(best, err)).alias("top_mae"), F.count_if((y > c) & (p > c)).alias("tp"), F.count_if((y < c) & (p < c)).alias("tn"),
                        F.count_if((y > c) & (p < c)).alias("fn"), F.count_if((y < c) & (p > c)).alias("fp"))

    counts = (base.join(cuts, by).groupBy(*by).agg(F.array(*[row(i, r) for i, r in enumerate(ratios)]).alias("rows"))
              .select(*by, F.explode("rows").alias("c")).select(*by, "c.*"))
    return with_f1(counts).join(regression_metrics(base, by, "y", "pred"), by)


def prediction_matrix(preds: DataFrame, series: list[str]) -> DataFrame:
    """One row per row id, one column per series (view, kind and round joined by `_`)."""
    name = F.concat_ws("_", "view", "kind", "round")
    return preds.withColumn("_series", name).groupBy("row_id").pivot("_series", series).agg(F.first("pred"))


def threshold_models(df: DataFrame, boundaries: list[float], features: str = "features", label: str = "y",
                     labelled: Column | None = None) -> dict[float, object]:
    """One scaler + logistic model per label boundary; other classifiers take the same place in the pipeline."""
    train = df if labelled is None else df.where(labelled)
    train = train.withColumn("_v", array_to_vector(F.col(features))).persist()
    try:
        def fit(boundary: float):
            stages = [StandardScaler(inputCol="_v", outputCol="_z", withMean=True),
                      LogisticRegression(featuresCol="_z", labelCol="_l", predictionCol="above")]
            return Pipeline(stages=stages).fit(train.withColumn("_l", binarize(label, boundary).cast("double")))

        return dict(zip(boundaries, concurrently(df.sparkSession, fit, boundaries)))
    finally:
        train.unpersist()


def apply_threshold_models(df: DataFrame, models: dict[float, object], features: str = "features") -> DataFrame:
    """Which boundaries each row is predicted to exceed, in long form (row_id, boundary, above)."""
    vec = df.withColumn("_v", array_to_vector(F.col(features)))
    parts = [m.transform(vec).select("row_id", F.lit(b).alias("boundary"), F.col("above").cast("int").alias("above"))
             for b, m in models.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


