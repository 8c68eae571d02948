"""Scaling, quantile bins, automatic bin counts, category dictionaries."""

from pyspark.sql import functions as F

from catalog.chain import encode_sql, score_sql
from catalog.registry import query, r6, s6, table
from catalog.views import P1, P2, P3, P4, P5
from gainsieve.operators import encode, prep, utility
from gainsieve.operators.order_stats import profile_numeric
from gainsieve.sources.workspace import Workspace

_MM = "m AS (SELECT min(c_acctbal) AS mn, max(c_acctbal) AS mx FROM customer)"


def coded(view, spark, sf):
    """The view with its class code y, and the number of classes."""
    frame = view.frame(spark, sf)
    codes = prep.label_codes(frame, "lab")
    return prep.encode_label(frame, "lab", codes), codes


@query("c01_minmax_fit", f"WITH {_MM} SELECT 'c_acctbal' AS col, mn AS min, mx AS max FROM m")
def c01(spark, sf):
    return encode.minmax_scale(table(spark, sf, "customer"), ["c_acctbal"])[1]


@query("c02_minmax_transform", f"WITH {_MM} SELECT c_custkey, {s6('(c_acctbal - mn) / (mx - mn)', 'c_acctbal')} FROM customer, m")
def c02(spark, sf):
    scaled, _ = encode.minmax_scale(table(spark, sf, "customer"), ["c_acctbal"])
    return scaled.select("c_custkey", r6("c_acctbal"))


@query("c03_minmax_inverse", "SELECT c_custkey, round(c_acctbal, 4) AS c_acctbal FROM customer")
def c03(spark, sf):
    scaled, params = encode.minmax_scale(table(spark, sf, "customer"), ["c_acctbal"])
    p = params.first()
    back = encode.minmax_inverse(F.col("c_acctbal"), p["min"], p["max"])
    return scaled.select("c_custkey", F.round(back, 4).alias("c_acctbal"))


@query(
    "c04_distinct_counts",
    " UNION ALL ".join(f"SELECT '{c}' AS col, count(DISTINCT {c}) AS n_distinct FROM lineitem" for c in [*P1.ints, *P1.floats]),
)
def c04(spark, sf):
    return encode.exact_distinct(table(spark, sf, "lineitem"), [*P1.ints, *P1.floats])


def _edge_rows(spark, edges):
    from gainsieve.sources.local import local_frame

    rows = [(c, i, e) for c, es in edges.items() for i, e in enumerate(es)]
    return local_frame(spark, rows, "col string, pos int, edge double").select("col", "pos", r6("edge"))


_EDGES = f"SELECT col, pos::INTEGER AS pos, {s6('edge', 'edge')} FROM (SELECT col, unnest(es) AS edge, generate_subscripts(es, 1) - 1 AS pos FROM edges)"


@query("c05_quantile_edges", encode_sql(P1, _EDGES))
def c05(spark, sf):
    frame = P1.frame(spark, sf)
    return _edge_rows(spark, encode.quantile_edges(frame, [*P1.ints, *P1.floats], 5, Workspace(spark)))


@query("c05_quantile_edges_bracketed", encode_sql(P1, _EDGES, bins=13).replace("greatest(least(nd - 1, 13), 2)", "13"))
def c05_bracketed(spark, sf):
    # Small limits make the search sketch, count and sketch again, as it would on very large columns.
    frame = P1.frame(spark, sf)
    edges = encode.quantile_edges(frame, [*P1.ints, *P1.floats], 13, Workspace(spark), max_distinct=60, cells=100)
    return _edge_rows(spark, edges)


@query("c06_distinct_edges", encode_sql(P1, "SELECT col, len(es)::INTEGER AS n_edges FROM edges", bins=20).replace("greatest(least(nd - 1, 20), 2)", "20"))
def c06(spark, sf):
    rows = _edge_rows(spark, encode.quantile_edges(P1.frame(spark, sf), [*P1.ints, *P1.floats], 20, Workspace(spark)))
    return rows.groupBy("col").agg(F.count("*").cast("int").alias("n_edges"))


@query("c07_constant_columns", "SELECT CASE WHEN min(l_linenumber * 0) = max(l_linenumber * 0) THEN 0 END::INTEGER AS n_bins, 'const' AS col FROM lineitem")
def c07(spark, sf):
    data, codes = coded(P1, spark, sf)
    data = data.select("y", (F.col("l_linenumber") * 0).alias("const"))
    numeric = encode.fit_numeric(data, ["const"], [], 5, "y", codes.count(), Workspace(spark))
    return data.select(F.lit(numeric[0].bins).alias("n_bins"), F.lit(numeric[0].name).alias("col")).distinct()


def binned(view, spark, sf, bins=5):
    data, codes = coded(view, spark, sf)
    ws = Workspace(spark)
    k = codes.count()
    numeric = encode.fit_numeric(data, view.ints, view.floats, bins, "y", k, ws)
    return data, codes, numeric, k, ws


@query("c08_assign_bins", encode_sql(P3, "SELECT tid AS event_id, max(bin) FILTER (ci = 0)::INTEGER AS b_0, max(bin) FILTER (ci = 1)::INTEGER AS b_1 FROM binned GROUP BY tid"))
def c08(spark, sf):
    data, _, numeric, _, _ = binned(P3, spark, sf)
    return encode.assign_bins(data, numeric).select("event_id", "b_0", "b_1")


@query("c09_clamped_bins", encode_sql(P1, "SELECT col, nb::INTEGER AS nb FROM nbs", bins=9))
def c09(spark, sf):
    return encode.clamped_bins(P1.frame(spark, sf), [*P1.ints, *P1.floats], 9)


@query("c10_auto_bin_gains", encode_sql(P1, f"SELECT col, nb::INTEGER AS nb, {s6('gain', 'gain')} FROM gains JOIN rng USING (ci)", bins=-1))
def c10(spark, sf):
    data, codes = coded(P1, spark, sf)
    gains = encode.auto_bin_scores(data, [*P1.ints, *P1.floats], "y", codes.count(), Workspace(spark))
    return gains.select("col", "nb", r6("gain"))


@query("c10_auto_bins_chosen", encode_sql(P3, "SELECT col, bb::INTEGER AS nb FROM best JOIN rng USING (ci)", bins=-1))
def c10_chosen(spark, sf):
    data, codes = coded(P3, spark, sf)
    return encode.choose_bins(encode.auto_bin_scores(data, ["user_id", "value"], "y", codes.count(), Workspace(spark)))


def contingency(view, spark, sf, bins=5):
    data, codes, numeric, k, ws = binned(view, spark, sf, bins)
    encoded = utility.encode_rows(data, numeric, view.cats)
    shapes = ws.table(utility.row_shapes(encoded, len(numeric), len(view.cats), "y", k), "shapes")
    ct = ws.table(utility.contingency(shapes, len(numeric), len(view.cats), k), "contingency")
    totals = [r["n"] for r in codes.orderBy("y").collect()]
    return ct, totals, numeric, shapes, ws


_CODED = (
    "allc AS (SELECT ci, bin, NULL::VARCHAR AS label, y FROM binned UNION ALL SELECT ci, NULL, label, y FROM cat),"
    " cnt AS (SELECT ci, bin, label, y, count(*)::DOUBLE AS c FROM allc GROUP BY ALL),"
    " grp AS (SELECT ci, bin, label, sum(c) AS m, count(*) FILTER (y = 0) AS z, -sum(c / t * ln(c / t)) / ln(any_value(k)) AS h FROM"
    " (SELECT *, sum(c) OVER (PARTITION BY ci, bin, label) AS t FROM cnt), tot GROUP BY ci, bin, label)"
)


@query(
    "c11_class_counts",
    score_sql(P1, "SELECT ci::INTEGER AS col_idx, bin::INTEGER AS bin, label, sum(c) FILTER (y = 0)::BIGINT AS c0, sum(c) FILTER (y = 1)::BIGINT AS c1,"
    " sum(c) FILTER (y = 2)::BIGINT AS c2 FROM cnt GROUP BY ci, bin, label", extra=[_CODED]),
)
def c11(spark, sf):
    ct = contingency(P1, spark, sf)[0]
    return ct.select("col_idx", "bin", "label", *[F.when(F.col(c) > 0, F.col(c)).alias(c) for c in ("c0", "c1", "c2")])


@query("c12_code_entropy", score_sql(P1, f"SELECT ci::INTEGER AS col_idx, bin::INTEGER AS bin, label, m::BIGINT AS rows, {s6('h', 'entropy')} FROM grp", extra=[_CODED]))
def c12(spark, sf):
    ct, totals, *_ = contingency(P1, spark, sf)
    return utility.code_entropy(ct, len(totals)).select("col_idx", "bin", "label", "rows", r6("entropy"))


@query(
    "c13_rows_of_bins",
    encode_sql(P3, "SELECT tid AS event_id, y FROM binned WHERE ci = 1 AND bin = 3"),
)
def c13(spark, sf):
    data, _, numeric, _, _ = binned(P3, spark, sf)
    return encode.assign_bins(data, numeric).filter("b_1 = 3").select("event_id", "y")


_GAIN = (
    "SELECT ci::INTEGER AS col_idx, " + s6("any_value(h0)", "base_entropy") + ", " + s6("sum(m * h) / any_value(n)", "cond_entropy")
    + ", " + s6("floor((any_value(h0) - sum(m * h) / any_value(n)) * 1e6 + 0.5) / 1e6", "gain")
    + " FROM grp, tot, (SELECT -sum(ny / n * ln(ny / n)) / ln(any_value(k)) AS h0 FROM codes, tot) GROUP BY ci"
)


@query("c14_conditional_entropy", score_sql(P1, _GAIN, extra=[_CODED]))
def c14(spark, sf):
    ct, totals, *_ = contingency(P1, spark, sf)
    return utility.column_gain(ct, totals).select("col_idx", r6("base_entropy"), r6("cond_entropy"), r6("gain"))


@query("c15_column_gain_unrelated_label", score_sql(P5, _GAIN, extra=[_CODED]))
def c15(spark, sf):
    ct, totals, *_ = contingency(P5, spark, sf)
    return utility.column_gain(ct, totals).select("col_idx", r6("base_entropy"), r6("cond_entropy"), r6("gain"))


@query("c16_bins_per_column", encode_sql(P1, "SELECT col, (len(es) - 1)::INTEGER AS n_bins FROM edges", bins=-1))
def c16(spark, sf):
    from gainsieve.sources.local import local_frame

    numeric = binned(P1, spark, sf, -1)[2]
    return local_frame(spark, [(c.name, c.bins) for c in numeric], "col string, n_bins int")


@query(
    "c17_bin_ranges",
    encode_sql(P1, f"SELECT col, bin::INTEGER AS bin, {s6('es[bin]', 'lo')}, {s6('es[bin + 1]', 'hi')} FROM (SELECT col, es, unnest(range(1, len(es))) AS bin FROM edges)"),
)
def c17(spark, sf):
    return encode.bin_ranges(spark, binned(P1, spark, sf)[2]).select("col", "bin", r6("lo"), r6("hi"))


_DICT = (
    "SELECT 'lang' AS col, lang AS label, row_number() OVER (ORDER BY lang)::INTEGER AS idx FROM (SELECT DISTINCT trim(lang) AS lang FROM documents)"
    " UNION ALL SELECT 'source', source, row_number() OVER (ORDER BY source)::INTEGER FROM (SELECT DISTINCT trim(source) AS source FROM documents)"
)


@query("c18_category_dictionary", _DICT)
def c18(spark, sf):
    return encode.category_dictionary(table(spark, sf, "documents"), ["lang", "source"], Workspace(spark))


@query(
    "c19_category_lookup",
    f"WITH dict AS ({_DICT}), x AS (SELECT doc_id, CASE WHEN n_chars > 2000 THEN 'unseen' ELSE ' ' || lang || ' ' END AS lang FROM documents)"
    " SELECT doc_id, coalesce(idx, -1)::INTEGER AS idx FROM x LEFT JOIN dict ON col = 'lang' AND label = trim(x.lang)",
)
def c19(spark, sf):
    docs = table(spark, sf, "documents")
    dictionary = encode.category_dictionary(docs, ["lang", "source"], Workspace(spark))
    other = F.when(F.col("n_chars") > 2000, "unseen").otherwise(F.concat(F.lit(" "), "lang", F.lit(" ")))
    return encode.category_lookup(docs.select("doc_id", other.alias("lang")), "lang", dictionary, "idx").select("doc_id", "idx")


@query(
    "c20_category_indicators",
    "SELECT o_orderkey, label, (o_orderstatus = label)::INTEGER AS is_label FROM orders, (SELECT DISTINCT o_orderstatus AS label FROM orders)",
)
def c20(spark, sf):
    o = table(spark, sf, "orders")
    dictionary = encode.category_dictionary(o, ["o_orderstatus"], Workspace(spark))
    return encode.category_indicators(o, "o_orderstatus", dictionary, ["o_orderkey"], dense=True)


@query("c20_category_indicators_of_ones", "SELECT c_custkey, trim(c_name) AS label, 1 AS is_label FROM customer")
def c20_ones(spark, sf):
    """As many labels as rows."""
    c = table(spark, sf, "customer")
    return encode.category_indicators(c, "c_name", encode.category_dictionary(c, ["c_name"], Workspace(spark)), ["c_custkey"])


@query("c21_category_names", score_sql(P4, "SELECT col, label, col || '=' || label AS name FROM lab"))
def c21(spark, sf):
    ct, totals, numeric, _, ws = contingency(P4, spark, sf)
    scored, _ = utility.score_items(ct, numeric, P4.cats, totals, 1.0, ws)
    return scored.filter(F.col("label").isNotNull()).select("col", "label", "name")


@query("c08_profile", f"SELECT 'l_extendedprice' AS col, count(*) AS n, {s6('min(l_extendedprice)', 'min')}, {s6('max(l_extendedprice)', 'max')} FROM lineitem")
def c08_profile(spark, sf):
    from gainsieve.sources.local import local_frame

    p = profile_numeric(table(spark, sf, "lineitem"), ["l_extendedprice"])
    rows = [(c, v["n"], v["min"], v["max"]) for c, v in p.items()]
    return local_frame(spark, rows, "col string, n bigint, min double, max double").select("col", "n", r6("min"), r6("max"))
