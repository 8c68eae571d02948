"""Explanation tables on the matches of view P2 and the plain scores of the same rows."""

from pyspark.sql import functions as F

from catalog.chain import fit_sql
from catalog.g_learn import trained
from catalog.registry import query, r6, s6
from catalog.scored import BINARY_SQL, binary
from catalog.views import P1, P2, P3, fitted
from gainsieve.operators import explain
from gainsieve.sources.workspace import Workspace

KEYS = ["o_orderkey"]
_CO = "co AS (SELECT tid AS o_orderkey, pid FROM (SELECT pid, unnest(tids) AS tid FROM patterns))"
_SC = f"sc AS (WITH {BINARY_SQL} SELECT * FROM sc)"


def _sql(final: str, *extra: str) -> str:
    return fit_sql(P2, final, length=2, extra=[_CO, _SC, *extra])


def matches(spark, sf):
    m = fitted(P2, spark, sf, length=2)
    return m.coordinates(P2.frame(spark, sf), KEYS), m.patterns


@query("i01_matches_with_prediction", _sql("SELECT o_orderkey, pid, prediction AS label FROM co JOIN sc USING (o_orderkey)"))
def i01(spark, sf):
    return explain.attach_prediction(matches(spark, sf)[0], binary(spark, sf), KEYS)


_TOP = (
    "top AS (SELECT * FROM (SELECT o_orderkey, prediction AS label, cls, row_number() OVER (PARTITION BY cls ORDER BY p DESC, o_orderkey) AS rn FROM"
    " (SELECT *, 0 AS cls, p0 AS p FROM sc UNION ALL SELECT *, 1, p1 FROM sc)) WHERE rn <= 15)"
)


@query("i02_top_rows_per_class", _sql("SELECT o_orderkey, cls, label FROM top", _TOP))
def i02(spark, sf):
    return explain.top_rows_per_class(binary(spark, sf), KEYS, 30)


_COUNTS = "cnt AS (SELECT pid, sum((prediction = 0)::INTEGER)::BIGINT AS n_0, sum((prediction = 1)::INTEGER)::BIGINT AS n_1 FROM co JOIN sc USING (o_orderkey) GROUP BY pid)"


@query("i03_pattern_counts_by_label", _sql("SELECT pid, n_0, n_1 FROM cnt", _COUNTS))
def i03(spark, sf):
    labelled = explain.attach_prediction(matches(spark, sf)[0], binary(spark, sf), KEYS)
    return explain.pattern_counts_by_label(labelled, [0, 1])


@query("i04_counts_long", _sql("SELECT pid, 0 AS label, n_0 AS n FROM cnt WHERE n_0 > 0 UNION ALL SELECT pid, 1, n_1 FROM cnt WHERE n_1 > 0", _COUNTS))
def i04(spark, sf):
    labelled = explain.attach_prediction(matches(spark, sf)[0], binary(spark, sf), KEYS)
    return explain.counts_long(explain.pattern_counts_by_label(labelled, [0, 1]), [0, 1])


_BEST = "best AS (SELECT o_orderkey, p1 FROM sc WHERE prediction = 1 ORDER BY p1 DESC, o_orderkey LIMIT 40)"


@query("i05_top_rows_of_class", _sql(f"SELECT o_orderkey, {s6('p1', 'prob')} FROM best", _BEST))
def i05(spark, sf):
    return explain.top_rows_of_class(binary(spark, sf), KEYS, 1, 40).select("o_orderkey", r6("prob"))


@query("i06_rows_of_class_above", _sql(f"SELECT o_orderkey, {s6('p0', 'prob')} FROM sc WHERE prediction = 0 AND p0 >= 0.75::DOUBLE"))
def i06(spark, sf):
    return explain.rows_of_class_above(binary(spark, sf), KEYS, 0, 0.75).select("o_orderkey", r6("prob"))


@query("i07_patterns_of_rows", _sql("SELECT pid, count(*) AS n FROM co JOIN best USING (o_orderkey) GROUP BY pid", _BEST))
def i07(spark, sf):
    rows = explain.top_rows_of_class(binary(spark, sf), KEYS, 1, 40)
    return explain.pattern_support(explain.patterns_of_rows(matches(spark, sf)[0], rows, KEYS))


@query(
    "i08_item_pairs",
    _sql(
        "SELECT names[1] AS c1, names[2] AS c2, o_orderkey, 1 AS class FROM hit JOIN"
        " (SELECT DISTINCT o_orderkey FROM hit ORDER BY o_orderkey LIMIT 10) USING (o_orderkey)",
        "hit AS (SELECT names, o_orderkey FROM co JOIN patterns USING (pid) JOIN sc USING (o_orderkey) WHERE len(items) >= 2 AND p1 > 0.6::DOUBLE)",
    ),
)
def i08(spark, sf):
    coords, patterns = matches(spark, sf)
    return explain.item_pairs(coords, binary(spark, sf), patterns, KEYS, 1, 0.6, 10)


_HIT = (
    "hit AS (SELECT names, o_orderkey, cls FROM co JOIN patterns USING (pid) JOIN (SELECT o_orderkey, 0 AS cls, p0 AS p FROM sc UNION ALL"
    " SELECT o_orderkey, 1, p1 FROM sc) USING (o_orderkey) WHERE len(items) >= 2 AND p > 0.6::DOUBLE AND cls IN (SELECT prediction FROM sc))"
)


@query(
    "i08_item_pairs_of_all_classes",
    _sql("SELECT names[1] AS c1, names[2] AS c2, o_orderkey, cls AS class FROM hit JOIN (SELECT cls, o_orderkey FROM (SELECT DISTINCT cls, o_orderkey FROM hit)"
         " QUALIFY row_number() OVER (PARTITION BY cls ORDER BY o_orderkey) <= 10) USING (cls, o_orderkey)", _HIT),
)
def i08_all(spark, sf):
    coords, patterns = matches(spark, sf)
    return explain.item_pairs(coords, binary(spark, sf), patterns, KEYS, None, 0.6, 10)


@query(
    "i09_patterns_by_class",
    _sql("SELECT DISTINCT pid, array_to_string(names, ', ') AS name, len(items)::INTEGER AS len FROM co JOIN patterns USING (pid) JOIN sc USING (o_orderkey) WHERE p1 > 0.9::DOUBLE"),
)
def i09(spark, sf):
    coords, patterns = matches(spark, sf)
    return explain.patterns_by_class(coords, binary(spark, sf), patterns, KEYS, 1, 0.9)


@query(
    "i10_patterns_by_first_item",
    fit_sql(P1, "SELECT len(items)::INTEGER AS len, names[1] AS first, string_agg(array_to_string(names[2:], ', '), '; ' ORDER BY array_to_string(names[2:], ', ')) AS rest"
            " FROM patterns GROUP BY 1, 2", length=3),
)
def i10(spark, sf):
    groups = explain.group_patterns(fitted(P1, spark, sf, length=3).patterns)
    return groups.select("len", "first", F.array_join("rest", "; ").alias("rest"))


@query(
    "i11_condensed_names",
    fit_sql(P3, "SELECT prefix, string_agg(vals, ', ' ORDER BY name) AS ranges FROM (SELECT array_to_string(names, ', ') AS name,"
            " array_to_string(list_transform(names, lambda n: split_part(n, '=', 1)), ':') AS prefix,"
            " array_to_string(list_transform(names, lambda n: replace(replace(split_part(n, '=', 2), '[', ''), ']', '')), ', ') AS vals FROM patterns) GROUP BY prefix",
            length=2),
)
def i11(spark, sf):
    cond = explain.condense_names(fitted(P3, spark, sf, length=2).patterns)
    return cond.select("prefix", F.array_join("ranges", ", ").alias("ranges"))


@query(
    "i12_explain_row",
    _sql("SELECT o_orderkey, prediction, pid, array_to_string(names, ', ') AS name FROM co JOIN patterns USING (pid) JOIN sc USING (o_orderkey)"
         " WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)"),
)
def i12(spark, sf):
    coords, patterns = matches(spark, sf)
    scored = binary(spark, sf)
    last = scored.agg(F.max("o_orderkey")).first()[0]
    return explain.explain_row(coords, patterns, scored, {"o_orderkey": last})


@query(
    "i13_explain_random_row",
    _sql("SELECT o_orderkey, prediction, y AS actual, pid, array_to_string(names, ', ') AS name FROM co JOIN patterns USING (pid) JOIN sc USING (o_orderkey)"
         " WHERE o_orderkey = (SELECT o_orderkey FROM sc WHERE p1 > 0.5::DOUBLE ORDER BY md5(o_orderkey || ':3'), o_orderkey LIMIT 1)"),
)
def i13(spark, sf):
    coords, patterns = matches(spark, sf)
    scored = binary(spark, sf)
    row = explain.random_row(scored, KEYS, 1, 0.5, seed=3)
    return explain.explain_rows(coords, patterns, scored, KEYS, row, actual="y")


@query(
    "i14_probability_histogram",
    f"WITH {BINARY_SQL}, l AS (SELECT 0 AS cls, p0 AS p FROM sc UNION ALL SELECT 1, p1 FROM sc)"
    " SELECT cls, least(floor(p * 20::DOUBLE) + 1, 20)::INTEGER AS bucket, count(*) AS n FROM l GROUP BY 1, 2",
)
def i14(spark, sf):
    return explain.probability_histogram(binary(spark, sf), [0, 1], 20)


@query("i15_coefficient_importance")
def i15(spark, sf):
    m = trained(P2, spark, sf, length=2)
    return explain.coefficient_importance(m.coefficients(), m.patterns.patterns, 10)


def _importance(spark, sf, seed):
    m = trained(P2, spark, sf, length=2)
    matched = m.transform(P2.frame(spark, sf)).withColumnRenamed("label_code", "y")
    return explain.permutation_importance(
        matched, m.classifier, m.patterns.patterns, KEYS, Workspace(spark), m.patterns.n_patterns, repeats=10, seed=seed
    )


@query("i16_permutation_importance")
def i16(spark, sf):
    return _importance(spark, sf, 0)


@query("i17_permutation_importance_other_seed")
def i17(spark, sf):
    return _importance(spark, sf, 1)
