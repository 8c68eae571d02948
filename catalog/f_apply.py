"""Fitted patterns on unseen rows, in batch and on streams."""

from dataclasses import replace

from pyspark.sql import functions as F

from catalog.chain import COVER, apply_ctes, fit_sql
from catalog.registry import query, table
from catalog.views import P2, P3, View, fitted
from gainsieve.operators import apply as matching
from gainsieve.operators import encode
from gainsieve.sources.workspace import Workspace
from gainsieve.streaming import apply as streams

# Prices outside the fitted range, an unseen status, and a missing priority.
UNSEEN = (
    "SELECT o_orderkey AS tid, o_totalprice * 1.25::DOUBLE - 60000 AS o_totalprice,"
    " CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,"
    " CASE WHEN o_totalprice > 20000 THEN o_orderpriority END AS o_orderpriority FROM orders"
)
_UN = apply_ctes(P2, UNSEEN)


def unseen(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        (F.col("o_totalprice") * F.lit(1.25) - F.lit(60000.0)).alias("o_totalprice"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_totalprice") > 20000, F.col("o_orderpriority")).alias("o_orderpriority"),
    )


@query("f01_encode_unseen", fit_sql(P2, "SELECT tid AS o_orderkey, bin::INTEGER AS b_0 FROM unbin", length=2, extra=_UN))
def f01(spark, sf):
    m = fitted(P2, spark, sf, length=2)
    return encode.assign_bins(unseen(spark, sf), m.numeric).select("o_orderkey", "b_0")


_LISTS = "SELECT un.tid AS o_orderkey, coalesce(string_agg(item::VARCHAR, ' ' ORDER BY item), '') AS items FROM un LEFT JOIN untx USING (tid) GROUP BY un.tid"


@query("f02_item_lists", fit_sql(P2, _LISTS, length=2, extra=_UN))
def f02(spark, sf):
    rows = fitted(P2, spark, sf, length=2).row_items(unseen(spark, sf))
    return rows.select("o_orderkey", F.array_join(F.array_sort("item_ids").cast("array<string>"), " ").alias("items"))


_COVER_SQL = fit_sql(P2, "SELECT tid AS o_orderkey, pid FROM cover", length=2, extra=[*_UN, COVER])


@query("f03_containment_join", _COVER_SQL)
def f03_join(spark, sf):
    m = fitted(P2, spark, sf, length=2)
    return matching.match_join(m.row_items(unseen(spark, sf)), m.patterns, ["o_orderkey"])


@query("f03_containment_inline", _COVER_SQL)
def f03_inline(spark, sf):
    return matching.coordinates(fitted(P2, spark, sf, length=2).match(unseen(spark, sf)), ["o_orderkey"])


@query("f03_containment_profiles", _COVER_SQL)
def f03_profiles(spark, sf):
    m = fitted(P2, spark, sf, length=2)
    return matching.coordinates(matching.match_profiles(m.row_items(unseen(spark, sf)), m.patterns), ["o_orderkey"])


_LIST_SQL = (
    "SELECT un.tid AS o_orderkey, coalesce(string_agg(pid::VARCHAR, ' ' ORDER BY pid), '') AS pids FROM un LEFT JOIN cover USING (tid) GROUP BY un.tid"
)


@query("f04_apply", fit_sql(P2, _LIST_SQL, length=2, extra=[*_UN, COVER]))
def f04(spark, sf):
    matched = fitted(P2, spark, sf, length=2).match(unseen(spark, sf))
    return matched.select("o_orderkey", F.array_join(F.col("pids").cast("array<string>"), " ").alias("pids"))


@query("a06_write_unseen_coordinates", _COVER_SQL)
def a06(spark, sf):
    from gainsieve.sources import files

    m = fitted(P2, spark, sf, length=2)
    path = Workspace(spark).new_path("unseen")
    rows = unseen(spark, sf)
    files.write_coordinates(m.coordinates(rows, ["o_orderkey"]), path, rows.count(), m.n_patterns)
    return files.read_coordinates(spark, path)[0].select("o_orderkey", "pid")


@query("f05_sparse_vectors", fit_sql(P2, _LIST_SQL, length=2, extra=[*_UN, COVER]))
def f05(spark, sf):
    from pyspark.ml.functions import vector_to_array

    rows = fitted(P2, spark, sf, length=2).transform(unseen(spark, sf))
    dense = rows.select("o_orderkey", vector_to_array("features").alias("v"))
    on = F.expr("filter(transform(v, (x, i) -> if(x = 1, string(i), null)), s -> s is not null)")
    return dense.select("o_orderkey", F.array_join(on, " ").alias("pids"))


@query(
    "f06_transformed_shape",
    fit_sql(P3, "SELECT (SELECT count(*) FROM d) AS n_rows, (SELECT count(*) FROM patterns) AS n_patterns", length=2),
)
def f06(spark, sf):
    m = fitted(P3, spark, sf, length=2)
    return P3.frame(spark, sf).agg(F.count("*").alias("n_rows")).withColumn("n_patterns", F.lit(m.n_patterns).cast("bigint"))


_TRAIN = "SELECT d.tid AS event_id, coalesce(string_agg(pid::VARCHAR, ' ' ORDER BY pid), '') AS pids FROM d LEFT JOIN (SELECT pid, unnest(tids) AS tid FROM patterns) USING (tid) GROUP BY d.tid"


@query("f07_transform_training_rows", fit_sql(P3, _TRAIN, length=2))
def f07(spark, sf):
    matched = fitted(P3, spark, sf, length=2).match(P3.frame(spark, sf))
    return matched.select("event_id", F.array_join(F.col("pids").cast("array<string>"), " ").alias("pids"))


@query(
    "f07_training_table",
    fit_sql(P3, "SELECT nnz::BIGINT AS nnz, y, count(*) AS n FROM (SELECT d.tid, d.y, count(pid) AS nnz FROM d LEFT JOIN"
            " (SELECT pid, unnest(tids) AS tid FROM patterns) USING (tid) GROUP BY d.tid, d.y) GROUP BY nnz, y", length=2),
)
def f07_training(spark, sf):
    from pyspark.ml.functions import vector_to_array

    merged = fitted(P3, spark, sf, length=2).training_table().withColumn("v", vector_to_array("features"))
    nnz = F.expr("cast(aggregate(v, 0D, (s, x) -> s + x) as bigint)").alias("nnz")
    per = merged.groupBy(nnz, F.col("y").cast("int").alias("y")).agg(F.sum("weight").cast("bigint").alias("n"))
    return per


def order_stream(spark, sf):
    schema = table(spark, sf, "orders").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf)


@query("k01_stream_match", fit_sql(P2, "SELECT tid AS o_orderkey, pid FROM (SELECT pid, unnest(tids) AS tid FROM patterns)", length=2))
def k01(spark, sf):
    m = fitted(P2, spark, sf, length=2)
    ws = Workspace(spark)
    out = ws.new_path("stream-out")
    streams.write_matches(order_stream(spark, sf), m, ["o_orderkey"], out, ws.new_path("stream-state")).awaitTermination()
    return matching.coordinates(spark.read.parquet(out), ["o_orderkey"])


@query("k02_stream_counts", fit_sql(P2, "SELECT pid, support AS n FROM patterns", length=2))
def k02(spark, sf):
    m = fitted(P2, spark, sf, length=2)
    counts = streams.count_patterns(order_stream(spark, sf), m)
    ws = Workspace(spark)
    out = ws.new_path("stream-counts")

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(out)

    query_ = (
        counts.writeStream.outputMode("complete").foreachBatch(keep)
        .option("checkpointLocation", ws.new_path("stream-state")).trigger(availableNow=True).start()
    )
    query_.awaitTermination()
    return spark.read.parquet(out)


#: A category of its own for each customer.
MANY = View("p2many", P2.keys, [], P2.floats, ["o_orderstatus", "cust"], P2.label, "orders", (("cust", "'c' || o_custkey"),))
_MANY_SQL = fit_sql(MANY, "SELECT tid AS o_orderkey, pid FROM cover", length=2, gain=0.0002, extra=[*apply_ctes(MANY, MANY.sql()), COVER])


@query("f04_many_categories_inline", _MANY_SQL)
def f04_many(spark, sf):
    m = fitted(MANY, spark, sf, length=2, gain=0.0002)
    return matching.coordinates(m.match(MANY.frame(spark, sf)), ["o_orderkey"])


@query("f04_many_categories_joined", _MANY_SQL)
def f04_many_joined(spark, sf):
    m = fitted(MANY, spark, sf, length=2, gain=0.0002)
    return matching.coordinates(replace(m, inline_patterns=0).match(MANY.frame(spark, sf)), ["o_orderkey"])
