"""Classifiers on pattern features: fits proved by their gradient, and scorers. Fits with a closed form are in g_closed.py."""

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from catalog.chain import fit_sql
from catalog.h_metrics import _BIN, _h
from catalog.registry import query, r6, s6
from catalog.scored import BINARY_SQL, REGRESSION_SQL, THREE_SQL, binary, regression, three
from catalog.views import P1, P2, P4
from gainsieve.operators import metrics
from gainsieve.plans.classifier import PatternClassifier, PatternClassifierModel
from gainsieve.plans.tuning import cross_validate, grid_search, regression_scorers, scorers, summarize
from gainsieve.sources.local import local_frame
from gainsieve.sources.workspace import Workspace

_TRAINED: dict[tuple, PatternClassifierModel] = {}


def trained(view, spark, sf, base=None, **params) -> PatternClassifierModel:
    kind = base and (type(base).__name__, tuple(sorted((p.name, str(v)) for p, v in base.extractParamMap().items())))
    key = (spark.sparkContext.applicationId, sf, view.name, kind, repr(sorted(params.items())))
    if key not in _TRAINED:
        est = PatternClassifier(labelCol="lab", features=view.features, keys=[], base_estimator=base, **params)
        _TRAINED[key] = est.fit(view.frame(spark, sf).select(*view.features, "lab"))
    return _TRAINED[key]


@query("g01_logistic_regression")
def g01(spark, sf):
    m = trained(P2, spark, sf, length=2)
    return local_frame(spark, [(i, c) for i, c in enumerate(m.coefficients())], "pid int, coefficient double")


def _certified(model, rows):
    """A row for each class and pattern (-1: the intercept): whether the derivative of the loss there is zero, to the optimizer's tolerance."""
    return model.optimality(rows).select("cls", "pid", (F.abs("gradient") < 1e-4).alias("optimal"))


@query(
    "g01_gradient_is_zero",
    fit_sql(P2, "SELECT 1 AS cls, pid, true AS optimal FROM patterns UNION ALL SELECT 1, -1, true", length=2),
)
def g01_gradient(spark, sf):
    return _certified(trained(P2, spark, sf, length=2), P2.frame(spark, sf))


@query(
    "g01_gradient_is_zero_with_class_weights",
    fit_sql(P2, "SELECT 1 AS cls, pid, true AS optimal FROM patterns UNION ALL SELECT 1, -1, true", length=2, weights=[1, 5]),
)
def g01_weights(spark, sf):
    return _certified(trained(P2, spark, sf, length=2, classWeights=[1, 5]), P2.frame(spark, sf))


@query(
    "g02_gradients_are_zero",
    fit_sql(P1, "SELECT y AS cls, pid, true AS optimal FROM (SELECT pid FROM patterns UNION ALL SELECT -1), codes", length=2),
)
def g02_gradients(spark, sf):
    return _certified(trained(P1, spark, sf, length=2), P1.frame(spark, sf))


@query("g02_one_against_the_rest")
def g02(spark, sf):
    out = trained(P1, spark, sf, length=2).transform(P1.frame(spark, sf))
    return out.groupBy("label_code", "prediction").agg(F.count("*").alias("n"))


@query("g03_other_classifier")
def g03(spark, sf):
    forest = RandomForestClassifier(numTrees=10, maxDepth=4, seed=1)
    est = PatternClassifier(labelCol="lab", features=P2.features, length=2, base_estimator=forest)
    model = est.fit(P2.frame(spark, sf).select(*P2.features, "lab"))
    out = model.transform(P2.frame(spark, sf))
    return out.groupBy("label_code", "prediction").agg(F.count("*").alias("n"))


@query("g04_probabilities")
def g04(spark, sf):
    out = trained(P2, spark, sf, length=2).transform(P2.frame(spark, sf))
    return out.select("o_orderkey", F.element_at("probability", 1).alias("p0"), F.element_at("probability", 2).alias("p1"))


@query("g05_predicted_labels")
def g05(spark, sf):
    return trained(P2, spark, sf, length=2).predict(P2.frame(spark, sf)).select("o_orderkey", "predicted_label")


@query(
    "g06_metric_per_scorer",
    f"WITH {BINARY_SQL} SELECT 'accuracy' AS metric, {s6('avg((y = prediction)::INTEGER)', 'value')} FROM sc UNION ALL"
    f" SELECT 'recall', {s6('sum((y = 1 AND prediction = 1)::INTEGER) / sum(y)', 'value')} FROM sc",
)
def g06(spark, sf):
    rows = binary(spark, sf)
    a = metrics.accuracy(rows).select(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
    r = metrics.binary_scores(rows).select(F.lit("recall").alias("metric"), F.col("recall").alias("value"))
    return a.unionByName(r).select("metric", r6("value"))


@query(
    "g07_regression_scorers",
    f"WITH {REGRESSION_SQL} SELECT {s6('1 - sum((y - p) ** 2) / (var_pop(y) * count(*))', 'r2')}, {s6('avg(abs(y - p))', 'mae')} FROM r",
)
def g07(spark, sf):
    return metrics.regression_scores(regression(spark, sf)).select(r6("r2"), r6("mae"))


_POINT = (
    "c AS (SELECT sum((y = 1 AND prediction = 1)::INTEGER)::DOUBLE AS tp, sum(y)::DOUBLE AS pos, sum(prediction)::DOUBLE AS pred,"
    " avg((y = prediction)::INTEGER) AS acc, -avg(ln(CASE WHEN y = 1 THEN p1 ELSE p0 END)) AS ll FROM sc)"
)


@query(
    "g06_all_scorers",
    f"WITH {BINARY_SQL}, {_BIN}, {_h('n1 / n0')}, {_POINT} SELECT metric, round(value, 4) AS value FROM (UNPIVOT (SELECT acc AS accuracy, tp / pred AS precision,"
    " tp / pos AS recall, 2 * tp / (pos + pred) AS f1, auc, ll AS log_loss, h FROM c, area, hm) ON COLUMNS(*) INTO NAME metric VALUE value)",
)
def g06_all(spark, sf):
    rows = binary(spark, sf).withColumnRenamed("y", "label_code")
    return local_frame(spark, [(name, scorer.evaluate(rows)) for name, scorer in scorers(2).items()], "metric string, value double")


@query(
    "g07_all_regression_scorers",
    f"WITH {REGRESSION_SQL} SELECT metric, value FROM (UNPIVOT (SELECT {s6('1 - avg((y - p) ** 2) / var_pop(y)', 'r2')}, round(avg(abs(y - p)), 3) AS mae,"
    " round(avg((y - p) ** 2) / 1e6, 3) AS mse, round(sqrt(avg((y - p) ** 2)), 3) AS rmse,"
    f" {s6('avg(abs(y - p) / abs(y))', 'mape')} FROM r) ON COLUMNS(*) INTO NAME metric VALUE value)",
)
def g07_all(spark, sf):
    rows, digits = regression(spark, sf), {"r2": 6, "mae": 3, "mse": 3, "rmse": 3, "mape": 6}
    values = [(name, scorer.evaluate(rows) / (1e6 if name == "mse" else 1.0), digits[name]) for name, scorer in regression_scorers().items()]
    table = local_frame(spark, values, "metric string, value double, digits int")
    return table.select("metric", F.when(F.col("digits") == 6, F.round("value", 6)).otherwise(F.round("value", 3)).alias("value"))


@query(
    "g08_summary_of_groups",
    f"WITH {THREE_SQL} SELECT 'accuracy' AS metric, round(avg(a), 2) AS value FROM (SELECT avg((y = prediction)::INTEGER) AS a FROM sc GROUP BY y)",
)
def g08(spark, sf):
    folds = three(spark, sf).groupBy("y").agg(F.avg((F.col("y") == F.col("prediction")).cast("double")).alias("value"))
    return summarize(folds.select(F.col("y").alias("fold"), F.lit("accuracy").alias("metric"), "value"))


@query("g08_cross_validation")
def g08_cv(spark, sf):
    est = PatternClassifier(labelCol="lab", features=P4.features, keys=["doc_id"])
    return summarize(cross_validate(est, P4.frame(spark, sf), ["doc_id"], folds=2))


@query("g09_grid_search")
def g09(spark, sf):
    est = PatternClassifier(labelCol="lab", features=P4.features, keys=["doc_id"])
    return grid_search(est, P4.frame(spark, sf), ["doc_id"], {"bins": [3, 5]}, folds=2)


@query("g10_metrics_of_model")
def g10(spark, sf):
    ws = Workspace(spark)
    out = trained(P2, spark, sf, length=2).transform(P2.frame(spark, sf)).select("label_code", "prediction", "probability")
    return metrics.metric_vector(ws.table(out, "scored"), ws, "label_code")
