"""Running totals and row numbers over a whole table without a single-task window.

A plain ``Window.orderBy`` moves the table into one task. Here the table is range
partitioned, totals run inside each partition, and the totals of the partitions
before it (one small row per partition and group) are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gainsieve.sources.workspace import Workspace

ONE_TASK_ROWS = 200_000


def running_sums(
    df: DataFrame,
    order: list[Column],
    sums: dict[str, str],
    ws: Workspace,
    groups: list[str] | None = None,
    one_task_rows: int = ONE_TASK_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Add inclusive running sums ``out <- column`` along ``order`` inside each group.

    The order key has to be unique per group: aggregate equal keys first. ``rows``
    saves a count when the caller knows the size.
    """
    groups = list(groups or [])
    source = df
    if rows is None:
        source = ws.table(df, "running-in")
        rows = source.limit(one_task_rows + 1).count()
    if rows <= one_task_rows:
        keys = groups or [F.lit(0)]
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return source.select("*", *[F.sum(c).over(w).alias(out) for out, c in sums.items()])

    ranged = source.repartitionByRange(*[F.col(g) for g in groups], *order)
    ranged = ws.table(ranged.withColumn("_part", F.spark_partition_id()), "running-ranged")
    totals = ranged.groupBy("_part", *groups).agg(*[F.sum(c).alias(f"_t_{out}") for out, c in sums.items()])
    # One row per (partition, group) pair: a range partition holds few groups' borders.
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_part").alias("_o_part"),
        *[F.col(g).alias(f"_o_group{i}") for i, g in enumerate(groups)],
        *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_o_{out}") for out in sums],
    )
    local = Window.partitionBy("_part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.select("*", *[F.sum(c).over(local).alias(f"_l_{out}") for out, c in sums.items()])
    same = F.col("_part") == F.col("_o_part")
    for i, g in enumerate(groups):  # a NULL group is a group
        same = same & F.col(g).eqNullSafe(F.col(f"_o_group{i}"))
    return summed.join(offsets, same).select(
        *[F.col(c) for c in source.columns],
        *[(F.col(f"_l_{out}") + F.col(f"_o_{out}")).alias(out) for out in sums],
    )


def numbered(
    df: DataFrame,
    order: list[Column],
    ws: Workspace,
    name: str = "rn",
    groups: list[str] | None = None,
    one_task_rows: int = ONE_TASK_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """1-based row numbers along ``order`` inside each group; the order must be total."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    out = running_sums(ones, order, {name: "_one"}, ws, groups, one_task_rows, rows)
    return out.drop("_one")
