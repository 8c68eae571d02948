"""Association measures, item utilities, transactions."""

from pyspark.sql import functions as F

from catalog.c_encode import contingency
from catalog.chain import fit_sql, mine_ctes, score_sql
from catalog.registry import query, r6, s6
from catalog.views import P1, P2, P3, P3_VALUE, P4, View, fitted
from gainsieve.functions import scores
from gainsieve.operators import utility
from gainsieve.sources.local import local_frame


@query("d01_numeric_correlation", score_sql(P1, f"SELECT ci::INTEGER AS col_idx, {s6('r', 'corr')} FROM corrs"))
def d01(spark, sf):
    ct, totals, *_ = contingency(P1, spark, sf)
    return utility.numeric_correlation(ct, totals).select("col_idx", r6("corr"))


@query("d02_category_correlation", score_sql(P2, f"SELECT ci::INTEGER AS col_idx, label, {s6('r', 'corr')} FROM assoc"))
def d02(spark, sf):
    ct, totals, *_ = contingency(P2, spark, sf)
    return utility.category_association(ct, totals).select("col_idx", "label", r6("corr"))


@query("d03_category_nmi", score_sql(P4, f"SELECT ci::INTEGER AS col_idx, label, {s6('nmi', 'nmi')} FROM assoc"))
def d03(spark, sf):
    ct, totals, *_ = contingency(P4, spark, sf)
    return utility.category_association(ct, totals).select("col_idx", "label", r6("nmi"))


@query("d03_category_nmi_three_classes", score_sql(P1, f"SELECT label, {s6('nmi', 'nmi')} FROM assoc"))
def d03_three(spark, sf):
    ct, totals, *_ = contingency(P1, spark, sf)
    return utility.category_association(ct, totals).select("label", r6("nmi"))


def scored(view, spark, sf):
    ct, totals, numeric, _, ws = contingency(view, spark, sf)
    return utility.score_items(ct, numeric, view.cats, totals, 1.0, ws)


@query("d04_external_utility", score_sql(P1, f"SELECT name, {s6('external', 'external')} FROM scored"))
def d04(spark, sf):
    return scored(P1, spark, sf)[0].select("name", r6("external"))


@query(
    "d05_right_edges",
    score_sql(
        P3,
        "SELECT col, bin::INTEGER AS bin, "
        + s6("CASE WHEN kind = 'int' THEN es[bin + 1] / es[len(es)] ELSE (es[bin + 1] - mn) / (es[len(es)] - mn) END", "right_edge")
        + " FROM (SELECT *, unnest(range(1, len(es))) AS bin FROM edges)",
    ),
)
def d05(spark, sf):
    numeric = contingency(P3, spark, sf)[2]
    rows = [(c.name, i + 1, e) for c in numeric for i, e in enumerate(c.right_edges())]
    return local_frame(spark, rows, "col string, bin int, right_edge double").select("col", "bin", r6("right_edge"))


@query("d06_internal_utility", score_sql(P2, f"SELECT name, {s6('internal', 'internal')} FROM scored"))
def d06(spark, sf):
    return scored(P2, spark, sf)[0].select("name", r6("internal"))


_ITEMS = "SELECT item, name, " + s6("external * internal", "raw") + ", u FROM items"


@query("d07_items", score_sql(P1, _ITEMS))
def d07(spark, sf):
    return scored(P1, spark, sf)[1].select("item", "name", r6("raw"), "u")


@query("d08_items_minority_weight", score_sql(P4, _ITEMS))
def d08(spark, sf):
    ct, totals, numeric, _, ws = contingency(P4, spark, sf)
    items = utility.score_items(ct, numeric, P4.cats, totals, 3.0, ws)[1]
    return items.select("item", "name", r6("raw"), "u")


WEIGHTS = [1, 5]


@query(
    "d08_items_class_weights",
    fit_sql(P4, "SELECT item, name, round((external * internal)::DOUBLE, 6) + 0.0::DOUBLE AS raw, u, support FROM items JOIN sums USING (item)", weights=WEIGHTS),
)
def d08_weights(spark, sf):
    m = fitted(P4, spark, sf, class_weights=WEIGHTS)
    return m.ranked.select("item", "name", r6("raw"), "u", "support")


@query(
    "d09_normalised_utility",
    score_sql(P3, f"SELECT name, {s6('external * internal / (SELECT max(external * internal) FROM scored)', 'share')} FROM scored"),
)
def d09(spark, sf):
    return utility.normalised(scored(P3, spark, sf)[0]).select("name", r6("share"))


def rows_with_items(view, spark, sf, **params):
    m = fitted(view, spark, sf, **params)
    encoded = utility.encode_rows(view.frame(spark, sf), m.numeric, view.cats)
    return utility.with_items(encoded, m.numeric, len(view.cats), utility.item_lookup(m.items)), m


@query("d10_transactions", score_sql(P2, "SELECT tid AS o_orderkey, item, u FROM tx"))
def d10(spark, sf):
    m = fitted(P2, spark, sf, length=2)
    encoded = utility.encode_rows(P2.frame(spark, sf), m.numeric, P2.cats)
    return utility.item_transactions(encoded, m.numeric, len(P2.cats), utility.item_lookup(m.items), ["o_orderkey"])


P2_LABELS = View("p2labels", P2.keys, [], ["o_totalprice"], ["o_orderstatus", "customer", "priority"], P2.label, "orders",
                 (("customer", "'c' || o_custkey"), ("priority", "o_orderpriority || '-' || (o_custkey % 97)")))


@query("d10_transactions_of_many_labels", score_sql(P2_LABELS, "SELECT tid AS o_orderkey, item, u FROM tx"))
def d10_many(spark, sf):
    """Two columns of many labels, joined at once, and one whose labels are all heavy."""
    m = fitted(P2_LABELS, spark, sf)
    encoded = utility.encode_rows(P2_LABELS.frame(spark, sf), m.numeric, P2_LABELS.cats)
    return utility.item_transactions(encoded, m.numeric, len(P2_LABELS.cats), utility.item_lookup(m.items), ["o_orderkey"])


@query("d10_items_of_many_labels", score_sql(P2_LABELS, "SELECT tid AS o_orderkey, item, u FROM tx"))
def d10_items(spark, sf):
    """The same items, looked up row by row as a stream would."""
    return utility.transactions(rows_with_items(P2_LABELS, spark, sf)[0], ["o_orderkey"])


@query("d11_transaction_utility", score_sql(P2, "SELECT tid AS o_orderkey, tu::BIGINT AS tu FROM tus"))
def d11(spark, sf):
    return rows_with_items(P2, spark, sf, length=2)[0].select("o_orderkey", utility.transaction_utility().alias("tu"))


@query(
    "d12_rows_without_items",
    score_sql(P3_VALUE, "SELECT tid AS event_id, (tx.tid IS NOT NULL)::INTEGER AS n_items FROM d LEFT JOIN tx USING (tid)"),
)
def d12(spark, sf):
    return rows_with_items(P3_VALUE, spark, sf)[0].select("event_id", F.size("items").alias("n_items"))


def item_sums(view, spark, sf):
    ct, totals, numeric, shapes, ws = contingency(view, spark, sf)
    items = utility.score_items(ct, numeric, view.cats, totals, 1.0, ws)[1]
    shape_items = utility.with_items(shapes, numeric, len(view.cats), utility.item_lookup(items))
    return utility.item_sums(shape_items, len(totals)), items


def _sums_sql(view, final):
    return score_sql(view, final, extra=[mine_ctes(1, 1e-4, 100, 100)[0]])


@query("d13_transaction_weighted_utility", _sums_sql(P1, f"SELECT item, support, {s6('twu / 1e6', 'twu')} FROM sums"))
def d13(spark, sf):
    sums, _ = item_sums(P1, spark, sf)
    return sums.select("item", "support", r6(scores.from_micros(F.col("twu")), "twu"))


@query("d14_item_utility", _sums_sql(P1, f"SELECT item, {s6('riu / 1e6', 'riu')} FROM sums"))
def d14(spark, sf):
    sums, _ = item_sums(P1, spark, sf)
    return sums.select("item", r6(scores.from_micros(F.col("riu")), "riu"))


@query("d15_start_threshold", fit_sql(P1, f"SELECT {s6('t / 1e6', 'threshold')} FROM t0", top_k=7))
def d15(spark, sf):
    sums, items = item_sums(P1, spark, sf)
    t = utility.start_threshold(sums, 7)
    return local_frame(spark, [(float(t) / 1e6,)], "threshold double").select(r6("threshold"))


@query(
    "d16_fit_items",
    fit_sql(P4, f"SELECT item, name, u, support, {s6('twu / 1e6', 'twu')}, {s6('riu / 1e6', 'riu')} FROM ranked"),
)
def d16(spark, sf):
    ranked = fitted(P4, spark, sf).ranked
    return ranked.select(
        "item", "name", "u", "support", r6(scores.from_micros(F.col("twu")), "twu"), r6(scores.from_micros(F.col("riu")), "riu")
    )
