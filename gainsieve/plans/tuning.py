"""Scorers, cross-validation over stratified folds, grid search, and result summaries."""

from __future__ import annotations

from itertools import product

from pyspark.ml.evaluation import Evaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gainsieve.functions.names import free
from gainsieve.operators import metrics, prep
from gainsieve.operators.running import numbered
from gainsieve.plans.classifier import PatternClassifier
from gainsieve.sources.local import local_frame
from gainsieve.sources.workspace import Workspace

BINARY_SCORERS = ["accuracy", "precision", "recall", "f1", "auc", "log_loss", "h"]
REGRESSION_SCORERS = ["r2", "mae", "mse", "rmse", "mape"]
SUMMARY = ["accuracy", "f1", "auc", "h", "log_loss"]


class MetricEvaluator(Evaluator):
    """One metric of the metric vector, for Spark's CrossValidator."""

    def __init__(self, metric: str, n_classes: int):
        super().__init__()
        self.metric, self.n_classes = metric, n_classes

    def _evaluate(self, dataset: DataFrame) -> float:
        with Workspace(dataset.sparkSession) as ws:
            return float(metrics.metric_vector(dataset, ws, "label_code", n_classes=self.n_classes).first()[self.metric])

    def isLargerBetter(self) -> bool:
        return self.metric != "log_loss"


class RegressionEvaluator(Evaluator):
    """One of REGRESSION_SCORERS, for Spark's CrossValidator."""

    def __init__(self, metric: str, labelCol: str = "y", predictionCol: str = "prediction"):
        super().__init__()
        if metric not in REGRESSION_SCORERS:
            raise ValueError(f"unknown metric {metric}; one of {REGRESSION_SCORERS}")
        self.metric, self.label, self.prediction = metric, labelCol, predictionCol

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(metrics.regression_scores(dataset, self.label, self.prediction).first()[self.metric])

    def isLargerBetter(self) -> bool:
        return self.metric == "r2"


def regression_scorers(labelCol: str = "y", predictionCol: str = "prediction") -> dict[str, RegressionEvaluator]:
    return {m: RegressionEvaluator(m, labelCol, predictionCol) for m in REGRESSION_SCORERS}


def scorers(n_classes: int) -> dict[str, MetricEvaluator]:
    """The scorer set; precision, recall and F1 are macro averages for more than two classes."""
    return {m: MetricEvaluator(m, n_classes) for m in BINARY_SCORERS}


def stratified_folds(df: DataFrame, y: str, keys: list[str], ws: Workspace, folds: int, seed: int = 0) -> DataFrame:
    """Add ``fold`` 0..folds-1, dealt out inside each class in seeded hash order."""
    h, rn = free(df.columns, "_h", "_rn")
    hashed = df.withColumn(h, F.xxhash64(*[prep.q(k) for k in keys], F.lit(seed)))
    ranked = numbered(hashed, [F.col(h), *[prep.q(k) for k in keys]], ws, rn, groups=[y])
    return ranked.withColumn("fold", ((F.col(rn) - 1) % folds).cast("int")).drop(h, rn)


def cross_validate(
    estimator: PatternClassifier, df: DataFrame, keys: list[str], folds: int = 5, seed: int = 0, fold_col: str | None = None
) -> DataFrame:
    """(fold, metric, value) of the metric vector on each held-out fold; ``fold_col`` holds folds 0..folds-1 that are given."""
    ws = Workspace(df.sparkSession)
    label = estimator.getOrDefault(estimator.labelCol)
    given = df if fold_col is None else df.withColumnRenamed(fold_col, "fold")
    dealt = ws.table(stratified_folds(df, label, keys, ws, folds, seed) if fold_col is None else given, "folds")
    rows = []
    for f in range(folds):
        model = estimator.fit(dealt.filter(F.col("fold") != f).drop("fold"))
        scored = ws.table(
            model.transform(dealt.filter(F.col("fold") == f).drop("fold")).select("label_code", "prediction", "probability"),
            "scored",
        )
        vector = metrics.metric_vector(scored, ws, "label_code", n_classes=len(model.patterns.totals)).first()
        rows += [(f, name, value) for name, value in vector.asDict().items()]
    ws.close()
    return local_frame(df.sparkSession, rows, "fold int, metric string, value double")


def summarize(folds: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(metric, value): mean over the folds, rounded to 2."""
    chosen = folds.filter(F.col("metric").isin(names or SUMMARY))
    return chosen.groupBy("metric").agg(F.round(F.avg("value"), 2).alias("value"))


def grid_search(
    estimator: PatternClassifier, df: DataFrame, keys: list[str], grid: dict[str, list], metric: str = "f1", folds: int = 3,
    fold_col: str | None = None,
) -> DataFrame:
    """(bins, length, gain, metric, value) for every combination, best first.

    The folds are dealt once. Each is coded and mined once for each number of bins, for all lengths and gains whose budgets cannot
    bind; their patterns are derived from that run (see PatternMiner.fit_grid).
    """
    ws = Workspace(df.sparkSession)
    label = estimator.getOrDefault(estimator.labelCol)
    given = df if fold_col is None else df.withColumnRenamed(fold_col, "fold")
    dealt = ws.table(stratified_folds(df, label, keys, ws, folds) if fold_col is None else given, "folds")
    points = list(product(grid.get("bins", [5]), grid.get("length", [1]), grid.get("gain", [1e-4])))
    rows = []
    for f in range(folds):
        held_out = dealt.filter(F.col("fold") == f).drop("fold")
        for (bins, length, gain), model in estimator.fit_grid(dealt.filter(F.col("fold") != f).drop("fold"), points):
            scored = ws.table(model.transform(held_out).select("label_code", "prediction", "probability"), "scored")
            vector = metrics.metric_vector(scored, ws, "label_code", n_classes=len(model.patterns.totals)).first()
            rows.append((bins, length, float(gain), float(vector[metric])))
    ws.close()
    table = local_frame(df.sparkSession, rows, "bins int, length int, gain double, value double")
    table = table.groupBy("bins", "length", "gain").agg(F.avg("value").alias("value"))
    table = table.select("bins", "length", "gain", F.lit(metric).alias("metric"), "value")
    return table.orderBy(F.asc("value") if metric == "log_loss" else F.desc("value"), "bins", "length", "gain")
