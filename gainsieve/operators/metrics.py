"""Classification and regression metrics as aggregates over scored rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gainsieve.operators.running import running_sums
from gainsieve.sources.local import local_frame
from gainsieve.sources.workspace import Workspace

LOG_LOSS_EPS = 1e-15  # fixed value
TINY = 2.220446049250313e-16  # fixed value: smallest divisor of the percentage error


def confusion(df: DataFrame, y: str = "y", prediction: str = "prediction") -> DataFrame:
    """(y, prediction, n): at most classes x classes rows; accuracy, precision, recall, F1 follow from it."""
    pair = df.select(F.col(y).cast("int").alias("y"), F.col(prediction).cast("int").alias("prediction"))
    return pair.groupBy("y", "prediction").agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, y: str = "y", prediction: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(prediction)).cast("double")).alias("accuracy"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def class_scores(cells: DataFrame) -> DataFrame:
    """(cls, tp, n_true, n_pred, precision, recall, f1) of every class in y or prediction; 0/0 is 0."""
    sides = cells.select(F.col("y").alias("cls"), F.col("n").alias("n_true"), F.lit(0).alias("n_pred"), _hit()).unionByName(
        cells.select(F.col("prediction").alias("cls"), F.lit(0).alias("n_true"), F.col("n").alias("n_pred"), F.lit(0).alias("tp"))
    )
    per = sides.groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("n_true").alias("n_true"), F.sum("n_pred").alias("n_pred"))
    tp, pos, pred = F.col("tp"), F.col("n_true"), F.col("n_pred")
    return per.select(
        "cls",
        "tp",
        "n_true",
        "n_pred",
        _ratio(tp, pred).alias("precision"),
        _ratio(tp, pos).alias("recall"),
        _ratio(2 * tp, pos + pred).alias("f1"),
    )


def _hit() -> Column:
    return F.when(F.col("y") == F.col("prediction"), F.col("n")).otherwise(F.lit(0)).alias("tp")


def binary_scores(df: DataFrame, y: str = "y", prediction: str = "prediction", positive: int = 1) -> DataFrame:
    """Precision, recall and F1 of one class; one row also when the class does not occur."""
    tp = F.count_if((F.col(y) == positive) & (F.col(prediction) == positive)).alias("tp")
    counts = df.agg(tp, F.count_if(F.col(y) == positive).alias("p"), F.count_if(F.col(prediction) == positive).alias("q"))
    a, p, q = F.col("tp"), F.col("p"), F.col("q")
    return counts.select(_ratio(a, q).alias("precision"), _ratio(a, p).alias("recall"), _ratio(2 * a, p + q).alias("f1"))


def macro_scores(df: DataFrame, y: str = "y", prediction: str = "prediction") -> DataFrame:
    per = class_scores(confusion(df, y, prediction))
    return per.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def one_hot(y: str, n_classes: int) -> Column:
    return F.expr(f"transform(sequence(0, {n_classes - 1}), k -> if(k = {y}, 1, 0))")


def score_counts(df: DataFrame, y: str, score: str, positive: int = 1) -> DataFrame:
    """(cls, score, n1, n0): positives and negatives per score value."""
    return (
        df.groupBy(F.lit(positive).alias("cls"), F.col(score).cast("double").alias("score"))
        .agg(F.count_if(F.col(y) == positive).alias("n1"), F.count_if(F.col(y) != positive).alias("n0"))
    )


def score_counts_ovr(df: DataFrame, y: str, probability: str) -> DataFrame:
    """The same per class, one against the rest; ``probability`` is an array with one entry per class."""
    cells = df.select(F.col(y).alias("_y"), F.posexplode(probability).alias("cls", "score"))
    return cells.groupBy("cls", "score").agg(
        F.count_if(F.col("_y") == F.col("cls")).alias("n1"), F.count_if(F.col("_y") != F.col("cls")).alias("n0")
    )


def roc_points(counts: DataFrame, ws: Workspace, **options) -> DataFrame:
    """Add cum1, cum0: positives and negatives with a score at or below this one."""
    return running_sums(counts, [F.col("score")], {"cum1": "n1", "cum0": "n0"}, ws, groups=["cls"], **options)


def auc_by_class(points: DataFrame) -> DataFrame:
    """(cls, n1, n0, auc): rank-sum area, tied scores count half."""
    below = F.col("cum0") - F.col("n0")
    wins = F.col("n1").cast("double") * (below.cast("double") + F.col("n0") / F.lit(2.0))
    per = points.groupBy("cls").agg(F.sum(wins).alias("wins"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    area = F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("wins") / F.col("n1") / F.col("n0"))
    return per.select("cls", "n1", "n0", area.alias("auc"))


def auc(df: DataFrame, ws: Workspace, y: str = "y", score: str = "score", **options) -> DataFrame:
    return auc_by_class(roc_points(score_counts(df, y, score), ws, **options)).select("auc")


def auc_ovr(df: DataFrame, ws: Workspace, y: str = "y", probability: str = "probability", **options) -> DataFrame:
    points = roc_points(score_counts_ovr(df, y, probability), ws, **options)
    return auc_by_class(points).agg(F.avg("auc").alias("auc"))


def log_loss(df: DataFrame, y: str = "y", probability: str = "probability") -> DataFrame:
    """Mean negative log of the clipped, renormalised probability of the true class."""
    return df.agg((-F.avg(_true_log(y, probability))).alias("log_loss"))


def _true_log(y: str, probability: str) -> Column:
    clipped = f"transform({probability}, p -> greatest(least(p, 1D - {LOG_LOSS_EPS}D), {LOG_LOSS_EPS}D))"
    return F.expr(f"ln(element_at({clipped}, int({y}) + 1) / aggregate({clipped}, 0D, (s, p) -> s + p))")


# H-measure ---------------------------------------------------------------------------------


def _hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Upper hull of (cum1, cum0) points given in ascending order."""
    hull: list[tuple[int, int]] = []
    for x, y in points:
        while len(hull) > 1:
            (ax, ay), (bx, by) = hull[-2], hull[-1]
            if (bx - ax) * (y - ay) >= (by - ay) * (x - ax):
                hull.pop()
            else:
                break
        hull.append((x, y))
    return hull


def _hull_of_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keep the hull of each class's run of points in a sorted partition."""
    kept: dict[int, list[tuple[int, int]]] = {}
    for batch in batches:
        for cls, part in batch.groupby("cls"):
            points = list(zip(part["cum1"].tolist(), part["cum0"].tolist()))
            kept[cls] = _hull(kept.get(cls, []) + points)
    rows = [(cls, x, y) for cls, hull in kept.items() for x, y in hull]
    yield pd.DataFrame(rows, columns=["cls", "cum1", "cum0"]).astype("int64")


def _beta_cdf(x: float, a: int, b: float) -> float:
    """Regularised incomplete beta function for a whole first shape."""
    total, term = 0.0, 1.0
    for i in range(a):
        total += term
        term *= (b + i) * x / (i + 1)
    return 1.0 - (1.0 - x) ** b * total


def h_from_hull(points: list[tuple[int, int]], n1: int, n0: int, severity_ratio: float | None = None) -> float:
    """H-measure from hull points (positives, negatives at or below a threshold).

    Cost weights follow Beta(2, 1 + 1/severity); the severity ratio defaults to n1/n0.
    """
    hull = _hull(sorted({(0, 0), (n1, n0), *points}))
    severity = severity_ratio if severity_ratio is not None else n1 / n0
    b = 1.0 + 1.0 / severity
    share1, share0 = n1 / (n1 + n0), n0 / (n1 + n0)

    def mass(c: float) -> tuple[float, float]:
        return _beta_cdf(c, 3, b) * 2.0 / (2.0 + b), _beta_cdf(c, 2, b + 1.0) * b / (2.0 + b)

    edges = [0.0]
    for (ax, ay), (bx, by) in zip(hull, hull[1:]):
        edges.append((bx - ax) / ((bx - ax) + (by - ay)))
    edges.append(1.0)
    loss = 0.0
    for (x, y), lo, hi in zip(hull, edges, edges[1:]):
        (u0, u1), (v0, v1) = mass(lo), mass(hi)
        loss += share0 * (1.0 - y / n0) * (v0 - u0) + share1 * (x / n1) * (v1 - u1)
    top0, top1 = mass(share1)
    end1 = mass(1.0)[1]
    return 1.0 - loss / (share0 * top0 + share1 * (end1 - top1))


#: Rounds of dropping points under chords; each drops half or more of those of a noisy curve.
CHORD_ROUNDS = 4


def above_chords(points: DataFrame) -> DataFrame:
    """(cls, _part, cum1, cum0) without the points on or under the chord from the one before to the one after: none is on the hull."""
    w = Window.partitionBy("cls", "_part").orderBy("cum1", "cum0")
    sides = {f"_{c}{k}": fn(c).over(w) for c in ("cum1", "cum0") for k, fn in (("a", F.lag), ("b", F.lead))}
    d = {k: F.col(k).cast("decimal(20,0)") for k in ("_cum1a", "_cum0a", "_cum1b", "_cum0b", "cum1", "cum0")}
    turn = (d["_cum1b"] - d["_cum1a"]) * (d["cum0"] - d["_cum0a"]) > (d["_cum0b"] - d["_cum0a"]) * (d["cum1"] - d["_cum1a"])
    end = F.col("_cum1a").isNull() | F.col("_cum1b").isNull()
    return points.withColumns(sides).filter(end | turn).drop(*sides)


def h_by_class(points: DataFrame, severity_ratio: float | None = None) -> DataFrame:
    """(cls, h) from ROC points: hull per range of points, then the hull of those hulls.

    Points on or under the chord of their neighbours go before Python sees any, in a few rounds on one layout; only hull points
    leave the second step, so the last one handles a thin table.
    """
    parts = points.select(F.col("cls").cast("bigint").alias("cls"), "cum1", "cum0").repartitionByRange("cls", "cum1", "cum0")
    left = parts.withColumn("_part", F.spark_partition_id())
    for _ in range(CHORD_ROUNDS):
        left = above_chords(left)
    thin = left.repartition("cls", "_part").sortWithinPartitions("cls", "cum1", "cum0").drop("_part").mapInPandas(_hull_of_partition, "cls bigint, cum1 bigint, cum0 bigint")

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        n1, n0 = int(part["cum1"].max()), int(part["cum0"].max())
        xy = list(zip(part["cum1"].tolist(), part["cum0"].tolist()))
        h = h_from_hull(xy, n1, n0, severity_ratio) if n1 and n0 else None
        return pd.DataFrame({"cls": [int(part["cls"].iloc[0])], "h": [h]})

    return thin.groupBy("cls").applyInPandas(finish, "cls bigint, h double")


def h_measure(df: DataFrame, ws: Workspace, y: str = "y", score: str = "score", severity_ratio: float | None = None) -> DataFrame:
    return h_by_class(roc_points(score_counts(df, y, score), ws), severity_ratio).select("h")


def h_measure_ovr(
    df: DataFrame, ws: Workspace, y: str = "y", probability: str = "probability", severity_ratio: float | None = None
) -> DataFrame:
    """Mean one-against-rest H-measure over the classes that occur, rounded to 4."""
    counts = score_counts_ovr(df, y, probability)
    per = h_by_class(roc_points(counts, ws), severity_ratio).filter(F.col("h").isNotNull())
    return per.agg(F.round(F.avg("h"), 4).alias("h"))


def metric_vector(
    df: DataFrame, ws: Workspace, y: str = "y", prediction: str = "prediction", probability: str = "probability",
    n_classes: int = 2, severity_ratio: float | None = None,
) -> DataFrame:
    """One row accuracy, f1, auc, h, log_loss, precision, recall, rounded to 4; binary or macro."""
    # One pass gives accuracy, precision, recall, F1 and log loss; at most classes x classes rows.
    coded = df.select(F.col(y).cast("int").alias("y"), F.col(prediction).cast("int").alias("prediction"), probability)
    cells = coded.groupBy("y", "prediction").agg(F.count("*").alias("n"), F.sum(_true_log("y", probability)).alias("log"))
    cells = local_frame(df.sparkSession, [tuple(r) for r in cells.collect()], "y int, prediction int, n bigint, log double")
    whole = cells.agg((F.sum(F.expr("if(y = prediction, n, 0)")) / F.sum("n")).alias("a"), (-F.sum("log") / F.sum("n")).alias("l")).first()
    acc, loss = whole["a"], whole["l"]
    per = class_scores(cells.select("y", "prediction", "n"))
    if n_classes > 2:
        prf = per.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1")).first()
        counts = score_counts_ovr(df, y, probability)
    else:
        prf = per.filter("cls = 1").select("precision", "recall", "f1").first() or {"precision": 0.0, "recall": 0.0, "f1": 0.0}
        counts = score_counts(df.withColumn("_s", F.element_at(probability, 2)), y, "_s")
    points = ws.table(roc_points(counts, ws), "roc-points")
    area = auc_by_class(points).agg(F.avg("auc")).first()[0]
    h = h_by_class(points, severity_ratio).agg(F.avg("h")).first()[0]
    row = (acc, prf["f1"], area, h, loss, prf["precision"], prf["recall"])
    names = ["accuracy", "f1", "auc", "h", "log_loss", "precision", "recall"]
    raw = local_frame(df.sparkSession, [row], ", ".join(f"{n} double" for n in names))
    return raw.select(*[F.round(n, 4).alias(n) for n in names])


def rmsle(df: DataFrame, y: str = "y", prediction: str = "prediction") -> DataFrame:
    gap = F.log1p(F.col(y)) - F.log1p(F.col(prediction))
    return df.agg(F.sqrt(F.avg(gap * gap)).alias("rmsle"))


def regression_scores(df: DataFrame, y: str = "y", prediction: str = "prediction") -> DataFrame:
    """r2, mae, mse, rmse, mape in one pass."""
    a, p = F.col(y).cast("double"), F.col(prediction).cast("double")
    err = a - p
    sums = df.agg(
        F.avg(F.abs(err)).alias("mae"),
        F.avg(err * err).alias("mse"),
        F.avg(F.abs(err) / F.greatest(F.abs(a), F.lit(TINY))).alias("mape"),
        F.var_pop(a).alias("_var"),
    )
    r2 = F.when(F.col("_var") > 0, 1 - F.col("mse") / F.col("_var")).otherwise(F.when(F.col("mse") == 0, 1.0).otherwise(0.0))
    return sums.select(r2.alias("r2"), "mae", "mse", F.sqrt("mse").alias("rmse"), "mape")
