"""Cleaning, imputation, labels and splits."""

from pyspark.sql import functions as F

from catalog.registry import query, r6, s6, table
from catalog.views import P1
from gainsieve.operators import prep
from gainsieve.sources.local import local_frame
from gainsieve.sources.workspace import Workspace


@query("b01_split_target", "SELECT c_custkey, c_acctbal, c_mktsegment, c_nationkey::VARCHAR AS c_nationkey FROM customer")
def b01(spark, sf):
    data = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    features, out = prep.split_target(data, "c_nationkey")
    return out.select(*features, "c_nationkey")


@query("b02_drop_columns", "SELECT s_suppkey, s_acctbal FROM supplier")
def b02(spark, sf):
    return table(spark, sf, "supplier").drop("s_name", "s_nationkey")


def _holes(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "event_id",
        F.when(F.col("event_type") != "click", F.col("value")).alias("value"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("props"),
        F.when(F.col("value") >= 20, F.col("event_type")).alias("kind"),
        F.when(F.col("value") < 60, F.col("user_id")).alias("user_id"),
    )


HOLES = (
    "h AS (SELECT event_id, CASE WHEN event_type <> 'click' THEN value END AS value, CASE WHEN event_type = 'error' THEN props END AS props,"
    " CASE WHEN value >= 20 THEN event_type END AS kind, CASE WHEN value < 60 THEN user_id END AS user_id FROM events)"
)


@query(
    "b03_missing_ratio",
    f"WITH {HOLES}, c AS (SELECT count(*) AS n, count(event_id) AS a, count(value) AS b, count(props) AS p, count(kind) AS k, count(user_id) AS u FROM h)"
    + " UNION ALL ".join(
        f" SELECT '{name}' AS col, n - {c} AS missing, {s6(f'(n - {c}) * 100.0::DOUBLE / n', 'ratio')} FROM c"
        for name, c in (("event_id", "a"), ("value", "b"), ("props", "p"), ("kind", "k"), ("user_id", "u"))
    ),
)
def b03(spark, sf):
    return prep.missing_ratio(_holes(spark, sf)).select("col", "missing", r6("ratio"))


@query("b03_drop_sparse_columns", f"WITH {HOLES} SELECT event_id, {s6('value', 'value')}, kind, user_id FROM h")
def b03_drop(spark, sf):
    kept = prep.drop_sparse_columns(_holes(spark, sf))
    return kept.withColumn("value", r6("value"))


@query("b04_all_strings", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def b04(spark, sf):
    return prep.all_strings(table(spark, sf, "nation"))


@query("b05_all_doubles", "SELECT p_partkey, p_size::DOUBLE AS p_size, length(p_name)::DOUBLE AS name_length FROM part")
def b05(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", F.length("p_name").cast("string").alias("name_length"))
    return prep.all_doubles(p, ["p_size", "name_length"])


_TOP = (
    "v AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1),"
    " top AS (SELECT *, row_number() OVER (ORDER BY n DESC, value DESC)::INTEGER AS rn FROM v)"
)


@query(
    "b06_condense_categories",
    f"WITH {_TOP} SELECT p_partkey, CASE WHEN p_brand IN (SELECT value FROM top WHERE rn <= 5) THEN p_brand ELSE 'Other' END AS p_brand FROM part",
)
def b06(spark, sf):
    return prep.condense_categories(table(spark, sf, "part").select("p_partkey", "p_brand"), ["p_brand"])


@query("b07_largest_categories", f"WITH {_TOP} SELECT 'p_brand' AS col, value, n, rn FROM top WHERE rn <= 5")
def b07(spark, sf):
    return prep.largest_categories(table(spark, sf, "part"), ["p_brand"])


@query(
    "b08_impute_mode",
    f"WITH {HOLES}, m AS (SELECT kind AS mode FROM h WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)"
    " SELECT event_id, coalesce(kind, mode) AS kind FROM h, m",
)
def b08(spark, sf):
    return prep.impute_mode(_holes(spark, sf).select("event_id", "kind"), ["kind"])


@query(
    "b09_replace_marker",
    "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '4%' THEN 'unknown' ELSE o_orderpriority END AS p,"
    " CASE WHEN o_totalprice < 100000 THEN 'unknown' ELSE o_orderstatus END AS s FROM orders),"
    " m AS (SELECT p AS mode FROM o GROUP BY p ORDER BY count(*) DESC, p LIMIT 1)"
    " SELECT o_orderkey, CASE WHEN p = 'unknown' THEN mode ELSE p END AS p, CASE WHEN s = 'unknown' THEN 'no' ELSE s END AS s FROM o, m",
)
def b09(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority").startswith("4"), "unknown").otherwise(F.col("o_orderpriority")).alias("p"),
        F.when(F.col("o_totalprice") < 100000, "unknown").otherwise(F.col("o_orderstatus")).alias("s"),
    )
    return prep.replace_marker(o, ["p", "s"], "unknown", {"s": "no"})


@query(
    "b10_impute_median",
    f"WITH {HOLES}, m AS (SELECT median(value) AS v, median(user_id) AS u FROM h)"
    f" SELECT event_id, {s6('coalesce(value, v)', 'value')}, {s6('coalesce(user_id, u)', 'user_id')} FROM h, m",
)
def b10(spark, sf):
    out = prep.impute_median(_holes(spark, sf), ["value", "user_id"], Workspace(spark))
    return out.select("event_id", r6("value"), r6("user_id"))


@query(
    "b11_impute_mean",
    f"WITH {HOLES}, m AS (SELECT avg(value) AS v, avg(user_id) AS u FROM h)"
    f" SELECT event_id, {s6('coalesce(value, v)', 'value')}, {s6('coalesce(user_id, u)', 'user_id')} FROM h, m",
)
def b11(spark, sf):
    out = prep.impute_mean(_holes(spark, sf), ["value", "user_id"])
    return out.select("event_id", r6("value"), r6("user_id"))


@query("b12_drop_sentinel_rows", "SELECT p_partkey, p_size FROM part WHERE p_size <> 9")
def b12(spark, sf):
    return prep.drop_sentinel_rows(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", 9)


@query(
    "b13_replace_sentinels",
    "WITH m AS (SELECT median(p_size) AS a, median(p_retailprice) AS b FROM part)"
    f" SELECT p_partkey, {s6('CASE WHEN p_size IN (7, 8) THEN a ELSE p_size END', 'p_size')},"
    f" {s6('CASE WHEN p_retailprice IN (7, 8) THEN b ELSE p_retailprice END', 'p_retailprice')} FROM part, m",
)
def b13(spark, sf):
    out = prep.replace_sentinels(table(spark, sf, "part"), ["p_size", "p_retailprice"], [7, 8], Workspace(spark))
    return out.select("p_partkey", r6("p_size"), r6("p_retailprice"))


@query(
    "b14_negative_columns",
    "SELECT 'c_acctbal' AS col, bool_or(c_acctbal < 0) AS has_negative FROM customer UNION ALL"
    " SELECT 'c_nationkey', bool_or(c_nationkey < 0) FROM customer",
)
def b14(spark, sf):
    return prep.negative_columns(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"])


@query("b15_log1p", f"SELECT o_orderkey, {s6('ln(o_totalprice + 1)', 'o_totalprice')} FROM orders")
def b15(spark, sf):
    return prep.log1p(table(spark, sf, "orders"), "o_totalprice").select("o_orderkey", r6("o_totalprice"))


@query("b16_row_sum", "SELECT l_orderkey, l_partkey, l_suppkey, l_partkey + l_suppkey AS total FROM lineitem")
def b16(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return prep.row_sum(li, ["l_partkey", "l_suppkey"], "total")


@query(
    "b18_ordered_features",
    "SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority, o_orderstatus FROM orders",
)
def b18(spark, sf):
    o = table(spark, sf, "orders").drop("o_orderdate")
    return prep.ordered_features(o, prep.feature_groups(o))


_CODES = "c AS (SELECT l_returnflag AS label, (row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 1)::INTEGER AS y, count(*) AS n FROM lineitem GROUP BY 1)"


@query("b20_label_codes", f"WITH {_CODES} SELECT label, y, n FROM c")
def b20(spark, sf):
    return prep.label_codes(table(spark, sf, "lineitem"), "l_returnflag")


@query("b21_regression_target", "SELECT p_partkey, p_size::DOUBLE AS y FROM part")
def b21(spark, sf):
    return prep.regression_target(table(spark, sf, "part"), "p_size").select("p_partkey", "y")


@query(
    "b22_decode_label",
    f"WITH {_CODES} SELECT l_orderkey, l_linenumber, l_partkey, c.y, l_returnflag AS label FROM lineitem JOIN c ON l_returnflag = c.label",
)
def b22(spark, sf):
    li = table(spark, sf, "lineitem")
    codes = prep.label_codes(li, "l_returnflag")
    coded = prep.encode_label(li, "l_returnflag", codes).select("l_orderkey", "l_linenumber", "l_partkey", "y")
    return prep.decode_label(coded, "y", codes)


@query(
    "b23_data_profile",
    f"WITH s AS ({P1.sql()}) SELECT 'class' AS metric, lab::VARCHAR AS name, count(*) AS value FROM s GROUP BY lab UNION ALL"
    " SELECT 'rows', 'all', count(*) FROM s UNION ALL SELECT 'features', 'int', 1 UNION ALL SELECT 'features', 'float', 4 UNION ALL"
    " SELECT 'features', 'string', 1",
)
def b23(spark, sf):
    frame = P1.frame(spark, sf)
    return prep.data_profile(frame, prep.feature_groups(frame, P1.features), "lab")


@query(
    "b24_prepare",
    f"WITH {_CODES} SELECT l_orderkey, y, l_linenumber, l_quantity, l_tax, l_linestatus FROM lineitem JOIN c ON l_returnflag = c.label",
)
def b24(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linestatus", "l_quantity", "l_tax", "l_linenumber", "l_returnflag")
    return prep.prepare(li, "l_returnflag", keys=["l_orderkey"])[0]


@query(
    "b25_stratified_split",
    "SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey)"
    " <= floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.2::DOUBLE + 0.5) AS is_test FROM orders",
)
def b25(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return prep.stratified_split(o, "o_orderstatus", ["o_orderkey"], Workspace(spark), order=[F.col("o_orderkey")])


@query(
    "b25_stratified_split_sizes",
    "SELECT o_orderstatus, count(*) AS n, floor(count(*) * 0.2::DOUBLE + 0.5)::BIGINT AS n_test FROM orders GROUP BY 1",
)
def b25_sizes(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    # The hash order, ranked through range partitions.
    ranked = prep.stratified_split(o, "o_orderstatus", ["o_orderkey"], Workspace(spark), seed=7)
    return ranked.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if("is_test").alias("n_test"))


@query(
    "b19_group_positions",
    "SELECT * FROM (VALUES ('int', 0, 'l_linenumber'), ('int', 1, 'l_partkey'), ('float', 2, 'l_quantity'), ('string', 3, 'l_linestatus'), ('string', 4, 'l_returnflag'))"
    " t(kind, position, name)",
)
def b19(spark, sf):
    li = table(spark, sf, "lineitem").select("l_linestatus", "l_linenumber", "l_quantity", "l_returnflag", "l_partkey")
    groups = prep.feature_groups(li)
    rows = [(kind, p, groups.ordered[p]) for kind, ps in zip(("int", "float", "string"), groups.positions()) for p in ps]
    return local_frame(spark, rows, "kind string, position int, name string")


@query(
    "b20_label_codes_of_many_classes",
    "SELECT o_custkey AS label, (row_number() OVER (ORDER BY count(*) DESC, o_custkey) - 1)::INTEGER AS y, count(*) AS n FROM orders GROUP BY o_custkey",
)
def b20_many(spark, sf):
    return prep.label_codes(table(spark, sf, "orders"), "o_custkey", max_classes=1_000_000)


_ODD = "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END"


@query(
    "b26_columns_with_missing_values",
    f"SELECT 'odd' AS col, count(*) FILTER (({_ODD}) IS NULL) AS missing FROM lineitem HAVING count(*) FILTER (({_ODD}) IS NULL) > 0",
)
def b26(spark, sf):
    """The columns that reject_missing names, each with its number of missing values."""
    li = table(spark, sf, "lineitem").selectExpr("l_tax", f"{_ODD} AS odd")
    prep.reject_missing(li, ["l_tax"])
    try:
        prep.reject_missing(li, ["l_tax", "odd"])
    except ValueError as refused:
        named = [c for c in li.columns if f"'{c}'" in str(refused)]
        return prep.missing_ratio(li, named).select("col", "missing")
    return local_frame(spark, [], "col string, missing bigint")
