"""The documented run with a classifier that has a closed form (naive Bayes over patterns), so that SQL can repeat all of it: fit on
the training rows, score held-out rows, metrics, cross-validation, grid search and importances."""

from dataclasses import replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from catalog.chain import COVER, apply_ctes, fit_sql
from catalog.g_learn import _POINT, trained
from catalog.h_metrics import _BIN, _h
from catalog.registry import query, r6, table
from catalog.views import P2, View
from gainsieve.operators import explain, metrics, prep
from gainsieve.plans.classifier import PatternClassifier
from gainsieve.plans.tuning import cross_validate, grid_search, summarize
from gainsieve.sources.workspace import Workspace

KEYS = ["o_orderkey"]
HELD_OUT = "o_orderkey % 5 = 0"
TRAIN = replace(P2, name="p2train", where="o_orderkey % 5 <> 0")
TEST = replace(P2, name="p2test", where=HELD_OUT)


def bayes():
    return NaiveBayes(modelType="bernoulli", smoothing=1.0)


#: Log of the share of rows with (t) and without (f) a pattern in each class, both with one row added.
LEARNT = [
    "seen AS (SELECT tid, y, pid FROM (SELECT pid, unnest(items) AS item, len(items) AS size FROM patterns) JOIN tx USING (item)"
    " GROUP BY tid, y, pid, size HAVING count(*) = size)",
    "held AS (SELECT p.pid, codes.y, coalesce(c, 0) AS c, ny FROM patterns p CROSS JOIN codes LEFT JOIN"
    " (SELECT pid, y, count(*) AS c FROM seen GROUP BY ALL) s ON s.pid = p.pid AND s.y = codes.y)",
    "theta AS (SELECT pid, y, ln(c + 1) - ln(ny + 2) AS t, ln(1 - (c + 1) / (ny + 2)::DOUBLE) AS f FROM held)",
    "prior AS (SELECT y, ln(ny + 1) - ln(n + k) + (SELECT sum(f) FROM theta WHERE theta.y = codes.y) AS b FROM codes, tot)",
]
SCORED = [
    COVER,
    "logit AS (SELECT un.tid, prior.y, any_value(b) + coalesce(sum(t - f), 0) AS m FROM un CROSS JOIN prior LEFT JOIN cover ON cover.tid = un.tid"
    " LEFT JOIN theta ON theta.pid = cover.pid AND theta.y = prior.y GROUP BY un.tid, prior.y)",
    "chance AS (SELECT tid, y, exp(m - top) / sum(exp(m - top)) OVER (PARTITION BY tid) AS p FROM (SELECT *, max(m) OVER (PARTITION BY tid) AS top FROM logit))",
    "guess AS (SELECT tid, arg_max(y, p) AS prediction, max(p) FILTER (y = 0) AS p0, max(p) FILTER (y = 1) AS p1 FROM chance GROUP BY tid)",
]


def run_sql(train: View, test: View, final: str, *extra: str, **params) -> str:
    """SQL over what is fitted on train, and ho: (tid, y, prediction, p0, p1) of the rows of test."""
    rows = apply_ctes(train, test.sql())
    truth = "ho AS (SELECT un.tid, codes.y, prediction, p0, p1 FROM un JOIN codes USING (lab) JOIN guess USING (tid))"
    return fit_sql(train, final, length=2, extra=[*rows, *LEARNT, *SCORED, truth, *extra], **params)


def model(spark, sf):
    return trained(TRAIN, spark, sf, base=bayes(), length=2)


def held_out(spark, sf):
    return model(spark, sf).transform(TEST.frame(spark, sf))


@query("g03_confusion_of_held_out_rows", run_sql(TRAIN, TEST, "SELECT y AS label_code, prediction, count(*) AS n FROM ho GROUP BY ALL"))
def g03(spark, sf):
    return held_out(spark, sf).groupBy(F.col("label_code").cast("int").alias("label_code"), F.col("prediction").cast("int").alias("prediction")).agg(F.count("*").alias("n"))


@query("g04_probabilities_of_held_out_rows", run_sql(TRAIN, TEST, "SELECT tid AS o_orderkey, round(p0, 6) + 0.0::DOUBLE AS p0, round(p1, 6) + 0.0::DOUBLE AS p1 FROM ho"))
def g04(spark, sf):
    return held_out(spark, sf).select("o_orderkey", r6(F.element_at("probability", 1), "p0"), r6(F.element_at("probability", 2), "p1"))


@query("g05_predicted_labels_of_held_out_rows", run_sql(TRAIN, TEST, "SELECT ho.tid AS o_orderkey, lab AS predicted_label FROM ho JOIN codes ON codes.y = prediction"))
def g05(spark, sf):
    return model(spark, sf).predict(TEST.frame(spark, sf)).select("o_orderkey", "predicted_label")


@query(
    "g05_held_out_rows_by_a_reloaded_pipeline",
    run_sql(TRAIN, TEST, "SELECT ho.tid AS o_orderkey, lab AS predicted_label, round(p1, 6) + 0.0::DOUBLE AS p1 FROM ho JOIN codes ON codes.y = prediction"),
)
def g05_reloaded(spark, sf):
    """Label and patterns as stages of a Spark pipeline: the estimator is saved, read back and fitted, and so is the fitted model."""
    label = SQLTransformer(statement=f"SELECT *, {P2.label} AS lab FROM __THIS__")
    est = PatternClassifier(labelCol="lab", features=P2.features, keys=KEYS, length=2, base_estimator=bayes())
    ws = Workspace(spark)
    Pipeline(stages=[label, est]).save(path := ws.new_path("pipeline"))
    orders = table(spark, sf, "orders")
    Pipeline.load(path).fit(orders.where(f"not ({HELD_OUT})")).save(path := ws.new_path("pipeline-model"))
    both = PipelineModel.load(path)
    scored = both.transform(orders.where(HELD_OUT))
    return prep.decode_label(scored, "prediction", both.stages[-1].patterns.codes, "predicted_label").select(
        "o_orderkey", "predicted_label", r6(F.element_at("probability", 2), "p1")
    )


@query(
    "g10_metrics_of_held_out_rows",
    run_sql(TRAIN, TEST, f"SELECT * FROM (WITH sc AS (SELECT * FROM ho), {_BIN}, {_h('n1 / n0')}, {_POINT} SELECT round(acc, 4) AS accuracy, round(2 * tp / (pos + pred), 4) AS f1,"
            " round(auc, 4) AS auc, round(h, 4) AS h, round(ll, 4) AS log_loss, round(tp / pred, 4) AS precision, round(tp / pos, 4) AS recall FROM c, area, hm)"),
)
def g10(spark, sf):
    ws = Workspace(spark)
    scored = held_out(spark, sf).select("label_code", "prediction", "probability")
    return metrics.metric_vector(ws.table(scored, "scored"), ws, "label_code")


def _accuracy_sql(fold: int, bins: int) -> str:
    train, test = (replace(P2, name=f"p2f{fold}{op}", where=f"o_orderkey % 2 {op} {fold}") for op in ("<>", "="))
    return f"(SELECT a FROM ({run_sql(train, test, 'SELECT round(avg((y = prediction)::INTEGER), 4) AS a FROM ho', bins=bins)}))"


def _mean_accuracy_sql(bins: int) -> str:
    return f"({_accuracy_sql(0, bins)} + {_accuracy_sql(1, bins)}) / 2"


def _folded(spark, sf):
    return P2.frame(spark, sf).withColumn("half", (F.col("o_orderkey") % 2).cast("int"))


@query("g08_cross_validation_of_given_folds", f"SELECT 'accuracy' AS metric, round({_mean_accuracy_sql(5)}, 2) AS value")
def g08(spark, sf):
    est = PatternClassifier(labelCol="lab", features=P2.features, keys=KEYS, length=2, base_estimator=bayes())
    return summarize(cross_validate(est, _folded(spark, sf), KEYS, folds=2, fold_col="half"), ["accuracy"])


@query(
    "g09_grid_search_of_given_folds",
    " UNION ALL ".join(f"SELECT {b} AS bins, 2 AS length, 0.0001::DOUBLE AS gain, 'accuracy' AS metric, round({_mean_accuracy_sql(b)}, 6) AS value" for b in (3, 5)),
)
def g09(spark, sf):
    est = PatternClassifier(labelCol="lab", features=P2.features, keys=KEYS, base_estimator=bayes())
    found = grid_search(est, _folded(spark, sf), KEYS, {"bins": [3, 5], "length": [2]}, "accuracy", folds=2, fold_col="half")
    return found.select("bins", "length", "gain", "metric", r6("value"))


@query(
    "i15_importance_of_log_odds",
    run_sql(TRAIN, TEST, "SELECT pid, array_to_string(names, ', ') AS name, round(w, 6) + 0.0::DOUBLE AS coefficient, round(abs(w), 6) AS importance FROM patterns JOIN"
            " (SELECT pid, sum(CASE WHEN y = 1 THEN t - f ELSE f - t END) AS w FROM theta GROUP BY pid) USING (pid)"),
)
def i15(spark, sf):
    m = model(spark, sf)
    found = explain.coefficient_importance(m.coefficients(), m.patterns.patterns, m.patterns.n_patterns)
    return found.select("pid", "name", r6("coefficient"), r6("importance"))


def _importance_sql(test: View, seed: int, repeats: int) -> str:
    """Rows take the pattern of the row that follows in the order of a seeded hash; only rows where that changes something count."""
    return run_sql(
        TRAIN, test,
        f"SELECT pid, array_to_string(names, ', ') AS name, round(avg(coalesce(loss, 0)), 6) + 0.0::DOUBLE AS mean, round(stddev_pop(coalesce(loss, 0)), 6) AS sd FROM patterns"
        f" CROSS JOIN (SELECT unnest(range(1, {repeats + 1})) AS rep) LEFT JOIN lost USING (pid, rep) GROUP BY pid, names",
        f"turn AS (SELECT tid, y, prediction, rep, coalesce(lead(tid) OVER r, first(tid) OVER r) AS other FROM ho CROSS JOIN (SELECT unnest(range(1, {repeats + 1})) AS rep)"
        f" WINDOW r AS (PARTITION BY rep ORDER BY md5(tid || ':' || rep || ':{seed}'), tid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))",
        "swap AS (SELECT rep, tid, pid, CASE WHEN mine THEN -1 ELSE 1 END AS sign FROM (SELECT rep, t.tid, pid, bool_or(own) AS mine, count(*) AS c FROM turn t JOIN"
        " (SELECT a.tid AS row_tid, a.rep AS row_rep, cover.pid, own FROM (SELECT tid, rep, tid AS look, true AS own FROM turn UNION ALL SELECT tid, rep, other, false FROM turn) a"
        " JOIN cover ON cover.tid = a.look) x ON x.row_tid = t.tid AND x.row_rep = t.rep GROUP BY rep, t.tid, pid) WHERE c = 1)",
        "after AS (SELECT rep, swap.tid, swap.pid, arg_max(logit.y, m + sign * (t - f)) AS now FROM swap JOIN logit ON logit.tid = swap.tid JOIN theta ON theta.pid = swap.pid"
        " AND theta.y = logit.y GROUP BY rep, swap.tid, swap.pid)",
        "lost AS (SELECT pid, rep, sum((prediction = y)::INTEGER - (now = y)::INTEGER) / (SELECT count(*) FROM ho) AS loss FROM after JOIN ho USING (tid) GROUP BY pid, rep)",
    )


def _importance(spark, sf, rows: View, seed: int, repeats: int):
    m = model(spark, sf)
    matched = m.transform(rows.frame(spark, sf)).withColumnRenamed("label_code", "y")
    found = explain.permutation_importance(
        matched, m.classifier, m.patterns.patterns, KEYS, Workspace(spark), m.patterns.n_patterns, repeats=repeats, seed=seed, top=m.patterns.n_patterns
    )
    return found.select("pid", "name", r6("mean"), r6("sd"))


@query("i16_permutation_importance_held_out", _importance_sql(TEST, 0, 3))
def i16(spark, sf):
    return _importance(spark, sf, TEST, 0, 3)


@query("i17_permutation_importance_training", _importance_sql(TRAIN, 1, 2))
def i17(spark, sf):
    return _importance(spark, sf, TRAIN, 1, 2)
