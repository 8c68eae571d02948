"""Reading, writing and reading back."""

from pyspark.sql import functions as F

from catalog.chain import encode_sql, fit_sql, score_sql
from catalog.registry import query, r6, s6, table
from catalog.views import P2, P3, P4, fitted
from gainsieve.plans.miner import PatternModel
from gainsieve.sources import files
from gainsieve.sources.workspace import Workspace


@query("a01_read_delimited", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def a01(spark, sf):
    path = Workspace(spark).new_path("orders.csv")
    data = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    data.write.option("header", True).option("sep", ";").csv(path)
    return files.read_delimited(
        spark, path, sep=";", schema="o_orderkey bigint, o_totalprice double, o_orderstatus string"
    )


@query("a01_read_gzip", "SELECT c_custkey, c_mktsegment FROM customer")
def a01_gzip(spark, sf):
    path = Workspace(spark).new_path("customer.csv")
    data = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    data.write.option("header", True).option("compression", "gzip").csv(path)
    return files.read_delimited(spark, path, schema="c_custkey bigint, c_mktsegment string")


@query("a02_read_headerless", "SELECT p_partkey AS k, p_brand AS brand, p_size AS size FROM part")
def a02(spark, sf):
    path = Workspace(spark).new_path("part.data")
    table(spark, sf, "part").select("p_partkey", "p_brand", "p_size").write.csv(path)
    read = files.read_delimited(spark, path, header=False, names=["k", "brand", "size"])
    return read.select(F.col("k").cast("bigint").alias("k"), "brand", "size")


@query("a03_first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 250")
def a03(spark, sf):
    return files.first_rows(table(spark, sf, "orders"), 250, [F.col("o_orderkey")]).select("o_orderkey", "o_totalprice")


@query(
    "a04_load_table",
    "WITH e AS (SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS value,"
    " CASE WHEN value < 20 THEN NULL ELSE event_type END AS kind, user_id % 3 AS cls FROM events),"
    " m AS (SELECT median(value) AS med, mode FROM e, (SELECT kind AS mode FROM e WHERE kind IS NOT NULL GROUP BY kind"
    " ORDER BY count(*) DESC, kind LIMIT 1) GROUP BY mode)"
    " SELECT event_id, " + s6("coalesce(value, med)", "value") + ", coalesce(kind, mode) AS kind, cls::VARCHAR AS cls FROM e, m",
)
def a04_load(spark, sf):
    raw = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") != "click", F.col("value")).alias("value"),
        F.when(F.col("value") >= 20, F.col("event_type")).alias("kind"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("sparse"),
        F.col("ts").cast("string").alias("ts"),
        (F.col("user_id") % 3).alias("cls"),
    )
    done = files.load_table(raw, Workspace(spark), target="cls", drop=["ts"])
    return done.df.select("event_id", r6("value"), "kind", "cls")


@query(
    "a04_titanic",
    "WITH t AS (SELECT c_nationkey % 3 + 1 AS pc, CASE WHEN c_acctbal < 0 THEN 'male' ELSE 'female' END AS sex,"
    " CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal / 100 END AS age,"
    " CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE abs(c_acctbal) END AS fare, c_nationkey % 4 + c_nationkey % 5 AS rel,"
    " CASE WHEN c_nationkey = 7 THEN NULL ELSE c_mktsegment END AS emb, (c_custkey % 2)::BIGINT AS surv FROM customer),"
    " m AS (SELECT avg(age) AS a, avg(fare) AS f FROM t),"
    " e AS (SELECT emb AS mode FROM t WHERE emb IS NOT NULL GROUP BY emb ORDER BY count(*) DESC, emb LIMIT 1)"
    ' SELECT pc::VARCHAR AS "Pclass", ' + s6("coalesce(age, a)", '"Age"') + ', sex AS "Sex", rel AS "numRelatives", '
    + s6("ln(coalesce(fare, f) + 1)", '"Fare"') + ', coalesce(emb, mode) AS "Embarked", surv AS "Survived" FROM t, m, e',
)
def a04_titanic(spark, sf):
    c = table(spark, sf, "customer")
    raw = c.select(
        (F.col("c_nationkey") % 3 + 1).alias("Pclass"),
        F.when(F.col("c_acctbal") < 0, "male").otherwise("female").alias("Sex"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal") / 100).alias("Age"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.abs("c_acctbal")).alias("Fare"),
        (F.col("c_nationkey") % 4).alias("SibSp"),
        (F.col("c_nationkey") % 5).alias("Parch"),
        F.when(F.col("c_nationkey") != 7, F.col("c_mktsegment")).alias("Embarked"),
        (F.col("c_custkey") % 2).alias("Survived"),
    )
    return files.titanic(raw).df.select("Pclass", r6("Age"), "Sex", "numRelatives", r6("Fare"), "Embarked", "Survived")


_HELOC = (
    "CASE WHEN p_size % 10 = 0 THEN -7 WHEN p_size % 10 = 1 THEN -8 ELSE p_size END AS a,"
    " CASE WHEN p_retailprice < 950 THEN -8 ELSE floor(p_retailprice) END AS b"
)


@query(
    "a04_heloc",
    f"WITH h AS (SELECT p_brand AS cls, CASE WHEN p_size = 50 THEN -9 ELSE p_size END AS er, {_HELOC} FROM part),"
    " k AS (SELECT * FROM h WHERE er <> -9), m AS (SELECT median(a) AS ma, median(b) AS mb FROM k)"
    ' SELECT cls, er::DOUBLE AS "ExternalRiskEstimate", ' + s6("CASE WHEN a IN (-7, -8) THEN ma ELSE a END", "a") + ", "
    + s6("CASE WHEN b IN (-7, -8) THEN mb ELSE b END", "b") + " FROM k, m",
)
def a04_heloc(spark, sf):
    p = table(spark, sf, "part")
    raw = p.select(
        F.col("p_brand").alias("cls"),
        F.when(F.col("p_size") == 50, -9).otherwise(F.col("p_size")).alias("ExternalRiskEstimate"),
        F.when(F.col("p_size") % 10 == 0, -7).when(F.col("p_size") % 10 == 1, -8).otherwise(F.col("p_size")).alias("a"),
        F.when(F.col("p_retailprice") < 950, F.lit(-8.0)).otherwise(F.floor("p_retailprice").cast("double")).alias("b"),
    )
    return files.heloc(raw, Workspace(spark)).df.select("cls", "ExternalRiskEstimate", r6("a"), r6("b"))


@query(
    "a04_bank_marketing",
    "WITH b AS (SELECT l_linenumber AS age, l_quantity AS q, l_tax AS t, CASE WHEN l_linenumber = 3 THEN 'unknown' ELSE l_returnflag END AS job,"
    " CASE WHEN l_quantity < 30 THEN 'unknown' ELSE 'yes' END AS def, l_linestatus AS y FROM lineitem),"
    " m AS (SELECT job AS mode FROM b GROUP BY job ORDER BY count(*) DESC, job LIMIT 1)"
    ' SELECT age, q AS campaign, t AS euribor3m, CASE WHEN job = \'unknown\' THEN mode ELSE job END AS job,'
    " CASE WHEN def = 'unknown' THEN 'no' ELSE def END AS dflt, y FROM b, m",
)
def a04_bank(spark, sf):
    li = table(spark, sf, "lineitem")
    q, t = F.col("l_quantity"), F.col("l_tax")
    job = F.when(F.col("l_linenumber") == 3, "unknown").otherwise(F.col("l_returnflag"))
    raw = li.select(
        F.col("l_linenumber").alias("age"), job.alias("job"), F.col("l_linestatus").alias("marital"),
        F.col("l_returnflag").alias("education"), F.when(q < 30, "unknown").otherwise("yes").alias("default"),
        F.lit("no").alias("housing"), F.lit("no").alias("loan"), q.alias("campaign"), q.alias("pdays"), q.alias("previous"),
        q.alias("emp.var.rate"), q.alias("cons.price.idx"), q.alias("cons.conf.idx"), t.alias("euribor3m"), t.alias("nr.employed"),
        F.col("l_linestatus").alias("y"),
    )
    done = files.bank_marketing(raw).df
    return done.select("age", "campaign", "euribor3m", "job", F.col("default").alias("dflt"), "y")


@query(
    "a04_pima",
    'SELECT l_linenumber AS "numPregnancies", l_suppkey AS glucose, l_quantity AS bmi, l_tax AS "diabetesPedigreeFunction",'
    ' l_partkey AS age, l_returnflag AS "class" FROM lineitem',
)
def a04_pima(spark, sf):
    columns = ["l_linenumber", "l_suppkey", "l_suppkey", "l_suppkey", "l_suppkey", "l_quantity", "l_tax", "l_partkey"]
    li = table(spark, sf, "lineitem")
    raw = li.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], "l_returnflag")
    return files.pima(raw).df.select("numPregnancies", "glucose", "bmi", "diabetesPedigreeFunction", "age", "class")


@query(
    "a04_iris",
    'SELECT l_quantity AS "sepalLength", l_discount AS "sepalWidth", l_tax AS "petalLength", l_extendedprice AS "petalWidth",'
    ' l_returnflag AS "class" FROM lineitem',
)
def a04_iris(spark, sf):
    return files.iris(table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag")).df


_TRAIN_COORDS = "SELECT tid AS o_orderkey, pid FROM (SELECT pid, unnest(tids) AS tid FROM patterns)"


@query("a05_write_coordinates", fit_sql(P2, _TRAIN_COORDS, length=2))
def a05(spark, sf):
    m = fitted(P2, spark, sf, length=2)
    path = Workspace(spark).new_path("train")
    frame = P2.frame(spark, sf)
    files.write_coordinates(m.coordinates(frame, ["o_orderkey"]), path, frame.count(), m.n_patterns)
    return files.read_coordinates(spark, path)[0].select("o_orderkey", "pid")


@query(
    "a05_matrix_shape",
    fit_sql(P2, "SELECT (SELECT count(*) FROM d) AS n_rows, (SELECT count(*) FROM patterns) AS n_patterns", length=2),
)
def a05_shape(spark, sf):
    m = fitted(P2, spark, sf, length=2)
    path = Workspace(spark).new_path("train")
    frame = P2.frame(spark, sf)
    files.write_coordinates(m.coordinates(frame, ["o_orderkey"]), path, frame.count(), m.n_patterns)
    return spark.read.parquet(f"{path}/shape")


@query(
    "a07_coordinates_to_vectors",
    fit_sql(
        P2,
        "SELECT d.tid AS o_orderkey, count(pid)::BIGINT AS nnz, coalesce(sum(pid), 0)::BIGINT AS index_sum FROM d LEFT JOIN"
        " (SELECT pid, unnest(tids) AS tid FROM patterns) p USING (tid) GROUP BY d.tid",
        length=2,
    ),
)
def a07(spark, sf):
    from pyspark.ml.functions import vector_to_array

    m = fitted(P2, spark, sf, length=2)
    path = Workspace(spark).new_path("train")
    frame = P2.frame(spark, sf)
    files.write_coordinates(m.coordinates(frame, ["o_orderkey"]), path, frame.count(), m.n_patterns)
    coords, (_, n_patterns) = files.read_coordinates(spark, path)
    vectors = files.coordinates_to_vectors(frame.select("o_orderkey"), coords, ["o_orderkey"], n_patterns)
    dense = vectors.select("o_orderkey", vector_to_array("features").alias("v"))
    return dense.select(
        "o_orderkey",
        F.expr("cast(aggregate(v, 0D, (s, x) -> s + x) as bigint)").alias("nnz"),
        F.expr("cast(aggregate(transform(v, (x, i) -> x * i), 0D, (s, x) -> s + x) as bigint)").alias("index_sum"),
    )


@query(
    "a08_pattern_table",
    fit_sql(
        P3,
        f"SELECT pid, {s6('util / 1e6', 'utility')}, array_to_string(names, ', ') AS pattern, {s6('ig', 'ig')},"
        f" {s6('entropy', 'entropy')}, pure_class FROM patterns",
        length=2,
    ),
)
def a08(spark, sf):
    path = Workspace(spark).new_path("patterns")
    files.write_pattern_table(fitted(P3, spark, sf, length=2).patterns, path)
    back = files.read_pattern_table(spark, path)
    return back.select("pid", r6("utility"), "pattern", r6("ig"), r6("entropy"), "pure_class")


@query(
    "a10_pattern_items",
    fit_sql(P3, "SELECT pid, array_to_string(items, ' ') AS items FROM patterns", length=2),
)
def a10(spark, sf):
    path = Workspace(spark).new_path("patterns")
    files.write_pattern_table(fitted(P3, spark, sf, length=2).patterns, path)
    back = files.read_pattern_table(spark, path)
    return back.select("pid", F.array_join(F.col("items").cast("array<string>"), " ").alias("items"))


def _reloaded(view, spark, sf, **params):
    path = Workspace(spark).new_path("model")
    fitted(view, spark, sf, **params).save(path)
    return PatternModel.load(spark, path)


@query("a11_scaler_params", score_sql(P3, f"SELECT col, {s6('mn', 'min')}, {s6('mx', 'max')} FROM rng"))
def a11(spark, sf):
    return _reloaded(P3, spark, sf, length=2).edges().select("col", r6("min"), r6("max"))


@query(
    "a12_bin_edges",
    encode_sql(P3, f"SELECT col, pos::INTEGER AS pos, {s6('edge', 'edge')} FROM (SELECT col, unnest(es) AS edge, generate_subscripts(es, 1) - 1 AS pos FROM edges)"),
)
def a12(spark, sf):
    edges = _reloaded(P3, spark, sf, length=2).edges()
    return edges.select("col", F.posexplode("edges").alias("pos", "edge")).select("col", "pos", r6("edge"))


@query("a13_category_dictionary", score_sql(P4, "SELECT col, label, bin::INTEGER AS idx FROM lab"))
def a13(spark, sf):
    return _reloaded(P4, spark, sf).dictionary()


@query("a14_item_list", score_sql(P4, "SELECT item, col, bin::INTEGER AS bin, name FROM items"))
def a14(spark, sf):
    return _reloaded(P4, spark, sf).items.select("item", "col", "bin", "name")
