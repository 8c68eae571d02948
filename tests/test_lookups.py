import pytest
from pyspark.sql import functions as F

from gainsieve import PatternMiner
from gainsieve.operators import encode, lookups
from gainsieve.operators.utility import encode_rows, item_lookup, item_transactions, transactions, with_items
from gainsieve.sources.workspace import Workspace

ODD = ['a "quoted" one', "back\\slash", "comma, and {brace}", "größe", ""]


@pytest.fixture(scope="module")
def rows(spark):
    """Half of the rows hold one label, a tenth an unseen one, others few each; some none."""
    data = []
    for i in range(2000):
        label = "hot" if i % 2 else None if i % 20 == 0 else "unseen" if i % 10 == 4 else ODD[i % 5] if i % 7 == 0 else f"v{i % 300}"
        data.append((i, label, f"w{i % 400}", i % 3, int(i % 2 and i % 3 == 0)))
    return spark.createDataFrame(data, "tid bigint, c string, e string, a int, y int")


def test_heavy_labels(rows):
    found = lookups.heavy_labels(rows, ["c", "e"])
    assert {"hot", "unseen"} <= set(found["c"]) and found["e"] == []
    assert lookups.heavy_labels(rows.limit(0), ["c"]) == {"c": []}


@pytest.mark.parametrize("heavy", [None, [], ["hot", 'a "quoted" one', "unseen", "never"]])
def test_category_lookup_is_the_same_with_any_heavy_labels(spark, rows, heavy):
    dictionary = encode.category_dictionary(rows.filter("c <> 'unseen'"), ["c", "e"], Workspace(spark))
    want = {r["label"]: r["idx"] for r in dictionary.filter("col = 'c'").collect()}
    got = encode.category_lookup(rows, "c", dictionary, "idx", heavy).collect()
    assert len(got) == 2000 and all(r["idx"] == want.get(r["c"], -1) for r in got)


def test_hot_and_missing_labels_do_not_meet_in_a_task(spark, rows):
    many = rows.select("tid", F.when(F.col("tid") < 1200, "hot").when(F.col("tid") > 1300, F.concat(F.lit("v"), "tid")).alias("c"))
    table = many.filter("c is not null").select("c").distinct().select(F.col("c").alias("label"), F.lit(1).alias("idx"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(kept, ("false", "-1")):
            spark.conf.set(k, v)
        joined = lookups.looked_up(many, "c", table, {"idx": "int"}, [{"label": "hot", "idx": 7}], "found")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)
        assert joined.filter("found.idx = 7").count() == 1200 and joined.filter("found is null").count() == 101
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_one_join_for_all_columns_gives_the_items_of_rows(rows):
    model = PatternMiner(label="y", keys=["tid"], bins=2, gain=0.0).fit(rows.fillna("none"))
    encoded, lookup = encode_rows(rows, model.numeric, model.groups.cats), item_lookup(model.items)
    once = item_transactions(encoded, model.numeric, 2, lookup, ["tid"])
    by_row = transactions(with_items(encoded, model.numeric, 2, lookup), ["tid"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, by_row.collect()))
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
