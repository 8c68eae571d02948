"""Metrics on scored rows."""

from pyspark.sql import functions as F

from catalog.registry import query, r6, s6
from catalog.scored import BINARY_SQL, REGRESSION_SQL, THREE_SQL, binary, regression, three
from gainsieve.operators import metrics
from gainsieve.sources.workspace import Workspace

_PER_CLASS = (
    "k AS (SELECT unnest([0, 1, 2]) AS cls), per AS (SELECT cls, sum((y = cls AND prediction = cls)::INTEGER)::DOUBLE AS tp,"
    " sum((y = cls)::INTEGER)::DOUBLE AS pos, sum((prediction = cls)::INTEGER)::DOUBLE AS pred FROM sc, k GROUP BY cls),"
    " prf AS (SELECT CASE WHEN pred > 0 THEN tp / pred ELSE 0 END AS p, CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS r,"
    " CASE WHEN pos + pred > 0 THEN 2 * tp / (pos + pred) ELSE 0 END AS f FROM per WHERE pos + pred > 0)"
)


def _hist(classes: str) -> str:
    """ROC points per class (cls, score, n1, n0, cum1, cum0)."""
    return (
        f"long AS ({classes}), hist AS (SELECT cls, score, sum((y = cls)::INTEGER)::DOUBLE AS n1, sum((y <> cls)::INTEGER)::DOUBLE AS n0"
        " FROM long GROUP BY cls, score), roc AS (SELECT *, sum(n1) OVER w AS cum1, sum(n0) OVER w AS cum0 FROM hist"
        " WINDOW w AS (PARTITION BY cls ORDER BY score)),"
        " area AS (SELECT cls, sum(n1 * (cum0 - n0 + n0 / 2)) / sum(n1) / sum(n0) AS auc FROM roc GROUP BY cls)"
    )


_BIN = _hist("SELECT y, 1 AS cls, p1 AS score FROM sc")
_OVR = _hist("SELECT y, 0 AS cls, p0 AS score FROM sc UNION ALL SELECT y, 1, p1 FROM sc UNION ALL SELECT y, 2, p2 FROM sc")


def _h(severity: str) -> str:
    """H-measure by testing every ROC point against all others for the upper hull."""
    i3 = "(1 - (1 - {c}) ** b * (1 + b * {c} + b * (b + 1) / 2 * {c} ** 2)) * 2 / (2 + b)"
    i2 = "(1 - (1 - {c}) ** (b + 1) * (1 + (b + 1) * {c})) * b / (2 + b)"
    return (
        "pt AS (SELECT cls, cum1 AS x, cum0 AS y FROM roc UNION SELECT DISTINCT cls, 0, 0 FROM roc),"
        " sz AS (SELECT cls, max(x) AS n1, max(y) AS n0 FROM pt GROUP BY cls),"
        f" par AS (SELECT *, 1 + 1 / ({severity}) AS b, n1 / (n1 + n0) AS s1, n0 / (n1 + n0) AS s0 FROM sz),"
        " fwd AS (SELECT a.cls, a.x, a.y, min(atan2(a.y - c.y, a.x - c.x)) FILTER (c.x + c.y < a.x + a.y) AS l,"
        " max(atan2(c.y - a.y, c.x - a.x)) FILTER (c.x + c.y > a.x + a.y) AS r FROM pt a JOIN pt c ON a.cls = c.cls GROUP BY a.cls, a.x, a.y),"
        " hull AS (SELECT cls, x, y FROM fwd WHERE l IS NULL OR r IS NULL OR l >= r),"
        " seg AS (SELECT cls, x, y, coalesce((x - lag(x) OVER w) / ((x - lag(x) OVER w) + (y - lag(y) OVER w)), 0) AS lo,"
        " coalesce((lead(x) OVER w - x) / ((lead(x) OVER w - x) + (lead(y) OVER w - y)), 1) AS hi FROM hull"
        " WINDOW w AS (PARTITION BY cls ORDER BY x + y)),"
        f" lossc AS (SELECT cls, sum(s0 * (1 - y / n0) * ({i3.format(c='hi')} - {i3.format(c='lo')})"
        f" + s1 * x / n1 * ({i2.format(c='hi')} - {i2.format(c='lo')})) AS loss FROM seg JOIN par USING (cls) GROUP BY cls),"
        f" hm AS (SELECT cls, 1 - loss / (s0 * {i3.format(c='s1')} + s1 * ({i2.format(c='1')} - {i2.format(c='s1')})) AS h"
        " FROM lossc JOIN par USING (cls))"
    )


@query("h01_accuracy", f"WITH {THREE_SQL} SELECT {s6('avg((y = prediction)::INTEGER)', 'accuracy')} FROM sc")
def h01(spark, sf):
    return metrics.accuracy(three(spark, sf)).select(r6("accuracy"))


@query(
    "h02_binary_precision_recall_f1",
    f"WITH {BINARY_SQL}, c AS (SELECT sum((y = 1 AND prediction = 1)::INTEGER)::DOUBLE AS tp, sum(y)::DOUBLE AS pos, sum(prediction)::DOUBLE AS pred FROM sc)"
    f" SELECT {s6('tp / pred', 'precision')}, {s6('tp / pos', 'recall')}, {s6('2 * tp / (pos + pred)', 'f1')} FROM c",
)
def h02(spark, sf):
    return metrics.binary_scores(binary(spark, sf)).select(r6("precision"), r6("recall"), r6("f1"))


@query("h03_macro_precision_recall_f1", f"WITH {THREE_SQL}, {_PER_CLASS} SELECT {s6('avg(p)', 'precision')}, {s6('avg(r)', 'recall')}, {s6('avg(f)', 'f1')} FROM prf")
def h03(spark, sf):
    return metrics.macro_scores(three(spark, sf)).select(r6("precision"), r6("recall"), r6("f1"))


@query("h03_class_scores", f"WITH {THREE_SQL}, {_PER_CLASS} SELECT cls, tp::BIGINT AS tp, pos::BIGINT AS n_true, pred::BIGINT AS n_pred FROM per")
def h03_class(spark, sf):
    return metrics.class_scores(metrics.confusion(three(spark, sf))).select("cls", "tp", "n_true", "n_pred")


@query("h04_roc_auc", f"WITH {BINARY_SQL}, {_BIN} SELECT {s6('auc', 'auc')} FROM area")
def h04(spark, sf):
    return metrics.auc(binary(spark, sf), Workspace(spark)).select(r6("auc"))


@query("h04_roc_auc_ranged", f"WITH {BINARY_SQL}, {_BIN} SELECT {s6('auc', 'auc')} FROM area")
def h04_ranged(spark, sf):
    # No one-task shortcut: running sums over range partitions with offsets.
    return metrics.auc(binary(spark, sf), Workspace(spark), one_task_rows=0).select(r6("auc"))


@query("h05_one_against_rest_auc", f"WITH {THREE_SQL}, {_OVR} SELECT {s6('avg(auc)', 'auc')} FROM area")
def h05(spark, sf):
    return metrics.auc_ovr(three(spark, sf), Workspace(spark)).select(r6("auc"))


@query("h06_log_loss_binary", f"WITH {BINARY_SQL} SELECT {s6('-avg(ln(CASE WHEN y = 1 THEN p1 ELSE p0 END))', 'log_loss')} FROM sc")
def h06(spark, sf):
    return metrics.log_loss(binary(spark, sf)).select(r6("log_loss"))


@query("h06_log_loss_three_classes", f"WITH {THREE_SQL} SELECT {s6('-avg(ln([p0, p1, p2][y + 1] / (p0 + p1 + p2)))', 'log_loss')} FROM sc")
def h06_three(spark, sf):
    return metrics.log_loss(three(spark, sf)).select(r6("log_loss"))


@query("h07_h_measure", f"WITH {BINARY_SQL}, {_BIN}, {_h('n1 / n0')} SELECT {s6('h', 'h')} FROM hm")
def h07(spark, sf):
    return metrics.h_measure(binary(spark, sf), Workspace(spark)).select(r6("h"))


@query("h07_h_measure_severity", f"WITH {BINARY_SQL}, {_BIN}, {_h('3')} SELECT {s6('h', 'h')} FROM hm")
def h07_severity(spark, sf):
    return metrics.h_measure(binary(spark, sf), Workspace(spark), severity_ratio=3.0).select(r6("h"))


@query("h08_h_measure_three_classes", f"WITH {THREE_SQL}, {_OVR}, {_h('n1 / n0')} SELECT round(avg(h), 4) AS h FROM hm")
def h08(spark, sf):
    return metrics.h_measure_ovr(three(spark, sf), Workspace(spark))


@query("h09_one_hot", f"WITH {BINARY_SQL} SELECT o_orderkey, (y = 0)::INTEGER AS is_0, (y = 1)::INTEGER AS is_1 FROM sc")
def h09(spark, sf):
    rows = binary(spark, sf).select("o_orderkey", metrics.one_hot("y", 2).alias("v"))
    return rows.select("o_orderkey", F.col("v")[0].alias("is_0"), F.col("v")[1].alias("is_1"))


@query(
    "h10_metric_vector_binary",
    f"WITH {BINARY_SQL}, {_BIN}, {_h('n1 / n0')}, c AS (SELECT sum((y = 1 AND prediction = 1)::INTEGER)::DOUBLE AS tp, sum(y)::DOUBLE AS pos,"
    " sum(prediction)::DOUBLE AS pred, avg((y = prediction)::INTEGER) AS acc, -avg(ln(CASE WHEN y = 1 THEN p1 ELSE p0 END)) AS ll FROM sc)"
    " SELECT round(acc, 4) AS accuracy, round(2 * tp / (pos + pred), 4) AS f1, round(auc, 4) AS auc, round(h, 4) AS h, round(ll, 4) AS log_loss,"
    " round(tp / pred, 4) AS precision, round(tp / pos, 4) AS recall FROM c, area, hm",
)
def h10(spark, sf):
    return metrics.metric_vector(binary(spark, sf), Workspace(spark))


@query(
    "h10_metric_vector_three_classes",
    f"WITH {THREE_SQL}, {_PER_CLASS}, {_OVR}, {_h('n1 / n0')}, a AS (SELECT avg((y = prediction)::INTEGER) AS acc,"
    " -avg(ln([p0, p1, p2][y + 1] / (p0 + p1 + p2))) AS ll FROM sc), m AS (SELECT avg(p) AS p, avg(r) AS r, avg(f) AS f FROM prf),"
    " u AS (SELECT avg(auc) AS auc FROM area), z AS (SELECT avg(h) AS h FROM hm)"
    " SELECT round(acc, 4) AS accuracy, round(f, 4) AS f1, round(auc, 4) AS auc, round(h, 4) AS h, round(ll, 4) AS log_loss,"
    " round(p, 4) AS precision, round(r, 4) AS recall FROM a, m, u, z",
)
def h10_three(spark, sf):
    return metrics.metric_vector(three(spark, sf), Workspace(spark), n_classes=3)


@query("h11_rmsle", f"WITH {REGRESSION_SQL} SELECT {s6('sqrt(avg((ln(y + 1) - ln(p + 1)) ** 2))', 'rmsle')} FROM r")
def h11(spark, sf):
    return metrics.rmsle(regression(spark, sf)).select(r6("rmsle"))


@query(
    "h12_regression_scores",
    f"WITH {REGRESSION_SQL} SELECT {s6('1 - avg((y - p) ** 2) / var_pop(y)', 'r2')}, round(avg(abs(y - p)), 4) AS mae,"
    f" round(sqrt(avg((y - p) ** 2)), 4) AS rmse, {s6('avg(abs(y - p) / abs(y))', 'mape')} FROM r",
)
def h12(spark, sf):
    out = metrics.regression_scores(regression(spark, sf))
    return out.select(r6("r2"), F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), r6("mape"))
