import random

from pyspark.sql import functions as F

from gainsieve.operators.running import numbered, running_sums
from gainsieve.sources.files import load_table, read_delimited
from gainsieve.sources.workspace import Workspace, shared_root


def test_ranged_totals_equal_one_task_totals(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else [None, "g1", "g2", "g3"][i % 4], i, rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, v bigint").repartition(6)
    ws = Workspace(spark)
    order = [F.col("k")]
    ranged = running_sums(df, order, {"s": "v"}, ws, ["g"], one_task_rows=0)
    plain = running_sums(df, order, {"s": "v"}, ws, ["g"])
    by_key = lambda r: r["k"]
    assert sorted(ranged.collect(), key=by_key) == sorted(plain.collect(), key=by_key)
    assert ranged.count() == 3000
    whole = numbered(df, [F.desc("v"), F.col("k")], ws, one_task_rows=0).orderBy("rn").collect()
    assert [r["rn"] for r in whole] == list(range(1, 3001))
    assert [(-r["v"], r["k"]) for r in whole] == sorted((-v, k) for _, k, v in rows)


def test_shared_folder_setting_is_used(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert Workspace(spark).path.startswith(configured.rstrip("/"))
    else:
        assert Workspace(spark).path.startswith(shared_root(spark))


def test_load_table_condenses_after_reading(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    rows = [(i, "abcdefg"[min(i % 9, 6)], None if i % 4 == 0 else i / 2, "yes" if i % 3 else "no") for i in range(90)]
    spark.createDataFrame(rows, "k int, c string, v double, y string").write.option("header", True).csv(path)
    done = load_table(read_delimited(spark, path), Workspace(spark), drop=["k"], condense=True)
    assert done.label == "y" and done.groups.floats == ["v"] and done.groups.cats == ["c"]
    values = {r[0] for r in done.df.select("c").distinct().collect()}
    assert len(values) == 6 and "Other" in values and done.df.filter("v is null").count() == 0
