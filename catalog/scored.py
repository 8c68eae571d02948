"""Scored rows made from the tables by plain arithmetic, so that metrics can be checked exactly."""

from pyspark.sql import functions as F

from catalog.registry import table
from catalog.views import P1, P2

# Binary: 100 distinct scores from the price, class of view P2.
BINARY_SQL = (
    f"s AS (SELECT o_orderkey, {P2.label} AS y, (floor(o_totalprice / 5000::DOUBLE) + 1) / 102::DOUBLE AS p1 FROM orders),"
    " sc AS (SELECT *, 1 - p1 AS p0, CASE WHEN p1 > 0.5::DOUBLE THEN 1 ELSE 0 END AS prediction FROM s)"
)


def binary(spark, sf):
    o = table(spark, sf, "orders")
    p1 = (F.floor(F.col("o_totalprice") / F.lit(5000.0)) + 1) / F.lit(102.0)
    base = o.select("o_orderkey", F.expr(P2.label).alias("y"), p1.alias("p1"))
    return base.select(
        "o_orderkey",
        "y",
        F.when(F.col("p1") > 0.5, 1).otherwise(0).alias("prediction"),
        F.array(F.lit(1.0) - F.col("p1"), F.col("p1")).alias("probability"),
        F.col("p1").alias("score"),
    )


# Three classes of view P1, 350 distinct probability vectors.
THREE_SQL = (
    f"t AS (SELECT {P1.label} AS y, (60 - l_quantity) / (70 + l_linenumber)::DOUBLE AS p0, l_quantity / (70 + l_linenumber)::DOUBLE AS p1,"
    " (10 + l_linenumber) / (70 + l_linenumber)::DOUBLE AS p2 FROM lineitem),"
    " sc AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS prediction FROM t)"
)


def three(spark, sf):
    li = table(spark, sf, "lineitem")
    d = (F.lit(70) + F.col("l_linenumber")).cast("double")
    p = F.array((F.lit(60) - F.col("l_quantity")) / d, F.col("l_quantity") / d, (F.lit(10) + F.col("l_linenumber")) / d)
    base = li.select(F.expr(P1.label).alias("y"), p.alias("probability"))
    best = F.array_position("probability", F.array_max("probability")) - F.lit(1)
    return base.withColumn("prediction", best.cast("int"))


REGRESSION_SQL = "r AS (SELECT l_extendedprice AS y, l_quantity * 1000 + l_tax * 100 AS p FROM lineitem)"


def regression(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.lit(1000.0) + F.col("l_tax") * F.lit(100.0)).alias("prediction")
    )
