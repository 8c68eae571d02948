"""Mining: item order, remaining utility, itemset statistics, thresholds, levels, selection."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.c_encode import contingency
from catalog.chain import fit_sql
from catalog.registry import query, r6, s6
from catalog.views import P1, P2, P2_TWIN, P3, P3_VALUE, P4, P5, fitted
from gainsieve.functions import scores
from gainsieve.operators import apply as matching
from gainsieve.operators import mine, utility
from gainsieve.plans.miner import PatternMiner
from gainsieve.sources.local import local_frame
from gainsieve.sources.workspace import Workspace


def parts(view, spark, sf, top_k=100):
    """(ranked items, mining base, class totals, start threshold, numeric parameters)."""
    ct, totals, numeric, shapes, ws = contingency(view, spark, sf)
    items = utility.score_items(ct, numeric, view.cats, totals, 1.0, ws)[1]
    shape_items = utility.with_items(shapes, numeric, len(view.cats), utility.item_lookup(items))
    sums = ws.table(utility.item_sums(shape_items, len(totals)), "sums")
    t = utility.start_threshold(sums, top_k)
    ranked = mine.ranked_items(items, sums, t, ws)
    base = ws.table(mine.mining_base(shapes, numeric, len(view.cats), ranked, len(totals)), "base")
    return ranked, base, totals, t, numeric


def gained(sums, totals):
    return mine.with_gain(sums, scores.bigint_array_sql(totals))


@query("e01_kept_items", fit_sql(P1, "SELECT item, name FROM ranked", top_k=3))
def e01(spark, sf):
    return parts(P1, spark, sf, 3)[0].select("item", "name")


@query("e02_item_order", fit_sql(P1, "SELECT rk AS rank, item, name FROM ranked"))
def e02(spark, sf):
    return parts(P1, spark, sf)[0].select("rank", "item", "name")


def ranked_orders(spark, sf):
    ranked, _, _, _, numeric = parts(P2, spark, sf)
    encoded = utility.encode_rows(P2.frame(spark, sf), numeric, P2.cats)
    return mine.ranked_rows(encoded, numeric, len(P2.cats), ranked)


@query(
    "e03_remaining_utility",
    fit_sql(P2, "SELECT tid AS o_orderkey, rk AS rank, w AS u, coalesce(sum(w) OVER (PARTITION BY tid ORDER BY rk ROWS BETWEEN 1 FOLLOWING"
            " AND UNBOUNDED FOLLOWING), 0)::BIGINT AS remaining FROM rtx"),
)
def e03(spark, sf):
    occ = mine.item_occurrences(ranked_orders(spark, sf), ["o_orderkey"])
    return occ.select("o_orderkey", F.col("last").alias("rank"), "u", F.col("r").alias("remaining"))


_REMAINING = (
    "rest AS (SELECT rk, sum(r) AS rutil FROM (SELECT rk, coalesce(sum(w) OVER (PARTITION BY tid ORDER BY rk ROWS BETWEEN 1 FOLLOWING"
    " AND UNBOUNDED FOLLOWING), 0) AS r FROM rtx) GROUP BY rk)"
)


@query(
    "e04_itemset_totals",
    fit_sql(P1, f"SELECT rk AS rank, support, {s6('util / 1e6', 'utility')}, {s6('rutil / 1e6', 'remaining')} FROM l1 JOIN rest USING (rk)", extra=[_REMAINING]),
)
def e04(spark, sf):
    _, base, totals, _, _ = parts(P1, spark, sf)
    sums = mine.single_sums(base, len(totals))
    return sums.select(F.col("last").alias("rank"), "support", r6(scores.from_micros(F.col("util")), "utility"), r6(F.col("rutil") / 1e6, "remaining"))


@query(
    "e05_class_counts",
    fit_sql(P3, "SELECT x, z, sum(c) FILTER (y = 0)::BIGINT AS n_0, sum(c) FILTER (y = 1)::BIGINT AS n_1 FROM pr_p GROUP BY x, z", length=2),
)
def e05(spark, sf):
    _, base, totals, _, _ = parts(P3, spark, sf)
    sums = mine.pair_sums(base, len(totals))
    return sums.select(F.col("prefix")[0].alias("x"), F.col("last").alias("z"), F.col("cls")[0].alias("n_0"), F.col("cls")[1].alias("n_1"))


@query("e06_itemset_entropy", fit_sql(P1, f"SELECT x, z, {s6('entropy', 'entropy')} FROM pr", length=2))
def e06(spark, sf):
    _, base, totals, _, _ = parts(P1, spark, sf)
    return gained(mine.pair_sums(base, len(totals)), totals).select(F.col("prefix")[0].alias("x"), F.col("last").alias("z"), r6("entropy"))


@query("e07_information_gain", fit_sql(P1, f"SELECT rk AS rank, {s6('ig', 'ig')} FROM l1"))
def e07(spark, sf):
    _, base, totals, _, _ = parts(P1, spark, sf)
    return gained(mine.single_sums(base, len(totals)), totals).select(F.col("last").alias("rank"), r6("ig"))


def _patterns_sql(where="true", limit_names=True):
    return (
        f"SELECT pid, array_to_string(names, ', ') AS name, len(items)::INTEGER AS len, support, {s6('util / 1e6', 'utility')},"
        f" {s6('ig', 'ig')}, pure_class FROM patterns WHERE {where}"
    )


def shown(model):
    return model.patterns.select("pid", "name", "len", "support", r6("utility"), r6("ig"), "pure_class")


@query("e07_gain_within_prefix", fit_sql(P1, _patterns_sql("len(items) = 3"), length=3))
def e07_prefix(spark, sf):
    return shown(fitted(P1, spark, sf, length=3)).filter("len = 3")


@query("e08_pure_class", fit_sql(P2, "SELECT x, z, pure_class FROM pr", length=2))
def e08(spark, sf):
    _, base, totals, _, _ = parts(P2, spark, sf)
    return gained(mine.pair_sums(base, len(totals)), totals).select(F.col("prefix")[0].alias("x"), F.col("last").alias("z"), "pure_class")


@query("e09_pair_utility", fit_sql(P1, f"SELECT x, z, support, {s6('util / 1e6', 'utility')} FROM pr", length=2))
def e09(spark, sf):
    _, base, totals, _, _ = parts(P1, spark, sf)
    sums = mine.pair_sums(base, len(totals))
    return sums.select(F.col("prefix")[0].alias("x"), F.col("last").alias("z"), "support", r6(scores.from_micros(F.col("util")), "utility"))


@query("e10_raised_threshold", fit_sql(P3, f"SELECT {s6('t0.t / 1e6', 'start')}, {s6('t1.t / 1e6', 'raised')} FROM t0, t1", length=2, top_k=8))
def e10(spark, sf):
    _, base, totals, t, _ = parts(P3, spark, sf, 8)
    raised = mine.raised_by_pairs(mine.pair_sums(base, len(totals)), t, 8)
    return local_frame(spark, [(float(t) / 1e6, float(raised) / 1e6)], "start double, raised double").select(r6("start"), r6("raised"))


@query("e11_emitted_items", fit_sql(P1, "SELECT rk AS rank, support FROM l1, t1 WHERE util >= t AND util > 0 AND ig > 0.01::DOUBLE", top_k=9))
def e11(spark, sf):
    _, base, totals, t, _ = parts(P1, spark, sf, 9)
    level = gained(mine.single_sums(base, len(totals)), totals)
    return mine.emitted(level, t, 0.01).select(F.col("last").alias("rank"), "support")


@query("e12_extended_patterns", fit_sql(P3, _patterns_sql("len(items) > 1"), length=3))
def e12(spark, sf):
    return shown(fitted(P3, spark, sf, length=3)).filter("len > 1")


@query("e13_pair_rows", fit_sql(P2, "SELECT tid AS o_orderkey, x, z, w AS u FROM occ2", length=2))
def e13(spark, sf):
    occ = mine.pair_occurrences(ranked_orders(spark, sf), ["o_orderkey"])
    return occ.select("o_orderkey", "x", F.col("last").alias("z"), "u")


@query("e14_bound_filter", fit_sql(P1, "SELECT rk AS rank FROM l1 JOIN rest USING (rk), t1 WHERE util > 0 AND util + rutil >= t", top_k=5, extra=[_REMAINING]))
def e14(spark, sf):
    _, base, totals, t, _ = parts(P1, spark, sf, 5)
    return mine.single_sums(base, len(totals)).filter(mine.extendable(t)).select(F.col("last").alias("rank"))


@query("e15_sibling_dedupe", fit_sql(P2_TWIN, "SELECT x, z, support FROM l2", length=2))
def e15(spark, sf):
    _, base, totals, t, _ = parts(P2_TWIN, spark, sf)
    singles = gained(mine.single_sums(base, len(totals)), totals).filter("ig > 1e-4").select("last")
    pairs = gained(mine.pair_sums(base, len(totals)), totals).filter("ig > 1e-4").join(singles, "last", "left_semi")
    pairs = pairs.join(singles.select(F.array("last").alias("prefix")), "prefix", "left_semi")
    return mine.drop_sibling_duplicates(pairs, base, Workspace(spark))[0].select(F.col("prefix")[0].alias("x"), F.col("last").alias("z"), "support")


@query("e16_gain_filter", fit_sql(P3, _patterns_sql(), length=2, gain=0.02))
def e16(spark, sf):
    return shown(fitted(P3, spark, sf, length=2, gain=0.02))


@query("e17_patterns_per_length", fit_sql(P1, "SELECT len(items)::INTEGER AS len, count(*) AS n FROM patterns GROUP BY 1", length=3))
def e17(spark, sf):
    return fitted(P1, spark, sf, length=3).patterns.groupBy("len").agg(F.count("*").alias("n"))


@query("e18_top_k_by_utility", fit_sql(P3, _patterns_sql(), length=2, top_k=12))
def e18(spark, sf):
    return shown(fitted(P3, spark, sf, length=2, top_k=12))


@query("e19_ranked_patterns", fit_sql(P1, _patterns_sql(), length=2))
def e19(spark, sf):
    return shown(fitted(P1, spark, sf, length=2))


@query("e20_one_pattern_per_row_set", fit_sql(P2_TWIN, _patterns_sql(), length=3))
def e20(spark, sf):
    return shown(fitted(P2_TWIN, spark, sf, length=3, exact_dedupe=True))


@query("e20_keep_highest_gain", fit_sql(P2_TWIN, _patterns_sql(), length=2, keep="highest"))
def e20_highest(spark, sf):
    return shown(fitted(P2_TWIN, spark, sf, length=2, keep_duplicate="highest"))


@query("e21_top_by_gain", fit_sql(P1, _patterns_sql(), length=2, fs_k=17))
def e21(spark, sf):
    return shown(fitted(P1, spark, sf, length=2, fs_k=17))


@query("e22_pattern_rows", fit_sql(P3, "SELECT tid AS event_id, pid FROM (SELECT pid, unnest(tids) AS tid FROM patterns)", length=3))
def e22(spark, sf):
    return fitted(P3, spark, sf, length=3).coordinates(P3.frame(spark, sf), ["event_id"])


@query(
    "e23_density",
    fit_sql(P3, f"SELECT (SELECT count(*) FROM d) AS n_rows, count(*) AS n_patterns, sum(support)::BIGINT AS nnz,"
            f" {s6('100.0::DOUBLE * sum(support) / ((SELECT count(*) FROM d) * count(*))', 'density')} FROM patterns", length=3),
)
def e23(spark, sf):
    out = fitted(P3, spark, sf, length=3).density(P3.frame(spark, sf), ["event_id"])
    return out.select("n_rows", "n_patterns", "nnz", r6("density"))


@query("e24_pattern_names", fit_sql(P2, "SELECT pid, array_to_string(names, ', ') AS name FROM patterns", length=2))
def e24(spark, sf):
    return fitted(P2, spark, sf, length=2).pattern_names()


@query(
    "e26_mining_report",
    fit_sql(P1, "SELECT 'patterns_found' AS metric, (SELECT count(*) FROM found)::DOUBLE AS value UNION ALL"
            " SELECT 'patterns_distinct', (SELECT count(*) FROM uniq) UNION ALL SELECT 'patterns_selected', (SELECT count(*) FROM patterns)"
            " UNION ALL SELECT 'level_1_candidates', (SELECT count(*) FROM l1) UNION ALL SELECT 'threshold_raised', (SELECT t / 1e6 FROM t1)"
            " UNION ALL SELECT 'patterns_same_rows', (SELECT count(*) FROM topk) - (SELECT count(*) FROM uniq)"
            " UNION ALL SELECT 'least_utility', (SELECT min(util)::DOUBLE / 1e6 FROM found) UNION ALL SELECT 'least_gain', (SELECT round(min(ig), 9) FROM found)"
            " UNION ALL SELECT 'most_gain', (SELECT round(max(ig), 9) FROM found) UNION ALL SELECT 'level_2_survivors', (SELECT count(*) FROM l2)"
            " UNION ALL SELECT 'level_2_passed_gain', (SELECT count(*) FROM l2p)"
            " UNION ALL SELECT 'level_2_siblings_dropped', (SELECT count(*) FROM l2p) - (SELECT count(*) FROM l2)"
            " UNION ALL SELECT 'level_3_survivors', (SELECT count(*) FROM l3)",
            length=3, extra=["l2p AS (SELECT x, z FROM pr WHERE ig > 0.0001::DOUBLE AND x IN (FROM ok1) AND z IN (FROM ok1))"]),
)
def e26(spark, sf):
    wanted = ["patterns_found", "patterns_distinct", "patterns_selected", "level_1_candidates", "threshold_raised", "patterns_same_rows"]
    wanted += ["least_utility", "least_gain", "most_gain", "level_2_survivors", "level_2_passed_gain", "level_2_siblings_dropped", "level_3_survivors"]
    report = fitted(P1, spark, sf, length=3).report_frame().filter(F.col("metric").isin(wanted))
    # gains rest on sums of logarithms
    return report.withColumn("value", F.when(F.col("metric").endswith("_gain") & ~F.col("metric").startswith("level"), F.round("value", 9)).otherwise(F.col("value")))


@query("e27_mine_auto_bins", fit_sql(P4, _patterns_sql(), bins=-1))
def e27_auto(spark, sf):
    return shown(fitted(P4, spark, sf, bins=-1))


@query("e27_mine_auto_bins_pairs", fit_sql(P3, _patterns_sql(), bins=-1, length=2))
def e27_auto_pairs(spark, sf):
    return shown(fitted(P3, spark, sf, bins=-1, length=2))


@query("e27_mine_three_classes", fit_sql(P1, _patterns_sql(), length=3))
def e27_three(spark, sf):
    return shown(fitted(P1, spark, sf, length=3))


@query("e27_mine_class_weights", fit_sql(P2, _patterns_sql(), length=2, weights=[1, 5]))
def e27_weights(spark, sf):
    return shown(fitted(P2, spark, sf, length=2, class_weights=[1, 5]))


@query("e27_mine_unrelated_label", fit_sql(P5, _patterns_sql(), gain=0.0))
def e27_unrelated(spark, sf):
    return shown(fitted(P5, spark, sf, gain=0.0))


@query("e27_mine_thresholds_bind", fit_sql(P1, _patterns_sql(), length=3, top_k=40))
def e27_binding(spark, sf):
    return shown(fitted(P1, spark, sf, length=3, top_k=40))


@query("e27_mine_one_feature", fit_sql(P3_VALUE, _patterns_sql()))
def e27_one(spark, sf):
    return shown(fitted(P3_VALUE, spark, sf))


_GRID = [(1, 0.001), (2, 0.001), (2, 0.02), (3, 0.001), (3, 0.02)]


@query(
    "e27_patterns_of_a_grid",
    " UNION ALL ".join(
        f"SELECT {length} AS length, {gain}::DOUBLE AS gain, * FROM ({fit_sql(P2_TWIN, _patterns_sql(), length=length, gain=gain, top_k=100_000)})" for length, gain in _GRID
    ),
)
def e27_grid(spark, sf):
    """Mined once at length 3 and gain 0.001; the other four are derived from that run."""
    frame = P2_TWIN.frame(spark, sf).select(*P2_TWIN.features, "lab")
    models = PatternMiner(label="lab", features=P2_TWIN.features, top_k=100_000).fit_grid(frame, _GRID)
    shows = [shown(m).select(F.lit(length).alias("length"), F.lit(gain).alias("gain"), "*") for (length, gain), m in models.items()]
    return reduce(DataFrame.unionByName, shows)


@query("e28_feature_names", fit_sql(P4, "SELECT array_to_string(names, ', ') AS name FROM patterns"))
def e28(spark, sf):
    return fitted(P4, spark, sf).pattern_names().select("name")


@query("e22_rows_by_inline_match", fit_sql(P1, "SELECT pid, count(*) AS n, sum(y)::BIGINT AS sum_y FROM (SELECT pid, unnest(tids) AS tid FROM patterns) JOIN d USING (tid) GROUP BY pid", length=2))
def e22_inline(spark, sf):
    matched = fitted(P1, spark, sf, length=2).match(P1.frame(spark, sf))
    hits = matching.coordinates(matched, ["lab"])
    return hits.groupBy("pid").agg(F.count("*").alias("n"), F.sum("lab").alias("sum_y"))
