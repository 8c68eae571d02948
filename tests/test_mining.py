import random

import pytest
from pyspark.sql import functions as F

from gainsieve import PatternMiner
from gainsieve.operators import mine, utility
from gainsieve.operators.encode import quantile_ranks
from tests import brute

WORKED = [
    (1, 0.5, "p", 0), (2, 1.0, "p", 0), (2, 1.5, "q", 0), (3, 2.0, "p", 0), (4, 2.5, "q", 0), (5, 3.0, "q", 1),
    (6, 3.5, "q", 1), (6, 4.0, "p", 1), (7, 4.5, "q", 1), (9, 5.5, "q", 0),
]


@pytest.fixture(scope="module")
def worked(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(WORKED)], "tid bigint, a int, b double, c string, y int")


@pytest.fixture(scope="module")
def worked_model(worked):
    return PatternMiner(label="y", keys=["tid"], bins=3, length=2, gain=0.01).fit(worked)


def test_worked_items(worked_model):
    rows = worked_model.ranked.orderBy("rank").select("name", "support", "riu", "twu").collect()
    assert [tuple(r) for r in rows] == [
        ("a=[1.0-3.0]", 3, 999999, 2014789), ("b=[0.5-2.0]", 3, 900000, 2014789), ("a=[3.0-6.0]", 3, 2000001, 4013927),
        ("b=[2.0-3.5]", 3, 1800000, 4013927), ("c=p", 4, 20872, 4554205), ("a=[6.0-9.0]", 3, 3000000, 6213926),
        ("b=[3.5-5.5]", 3, 3000000, 6213926), ("c=q", 6, 626124, 7792791),
    ]


def test_worked_patterns(worked_model):
    assert worked_model.report["patterns_found"] == 15
    rows = worked_model.patterns.orderBy("pid").collect()
    assert [(r["name"], r["support"], round(r["ig"], 6)) for r in rows] == [
        ("b=[3.5-5.5]", 3, 0.38593), ("b=[3.5-5.5], c=q", 2, 0.223144), ("b=[0.5-2.0]", 3, 0.194976),
        ("b=[0.5-2.0], c=p", 2, 0.118494), ("c=p, a=[6.0-9.0]", 1, 0.100149), ("b=[0.5-2.0], c=q", 1, 0.054746),
        ("c=q", 6, 0.032189), ("c=p", 4, 0.032189),
    ]


def test_row_at_the_maximum_has_only_its_category(worked, worked_model):
    last = worked_model.transform(worked).filter("tid = 9").first()
    assert last["item_ids"] == [8] and last["pids"] == [6]


def random_rows(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.randint(0, 12), round(rng.random() * 4, 2), rng.choice("pqrs")
        d = rng.choice(["u", "v"])
        y = int(a > 7 and c in "pq") if rng.random() < 0.85 else rng.randint(0, 2)
        rows.append((i, a, b, c, d, y))
    return rows


@pytest.mark.parametrize(
    ("seed", "length", "top_k", "fs_k", "gain"),
    [(1, 3, -1, -1, 0.0), (2, 4, -1, -1, 0.001), (3, 3, 20, 12, 0.0005), (4, 2, 9, -1, 0.0), (5, -1, 60, -1, 0.002)],
)
def test_against_brute_force(spark, seed, length, top_k, fs_k, gain):
    df = spark.createDataFrame(random_rows(seed), "tid bigint, a int, b double, c string, d string, y int")
    model = PatternMiner(
        label="y", keys=["tid"], bins=4, length=length, gain=gain, top_k=top_k, fs_k=fs_k, exact_dedupe=True
    ).fit(df)
    k = mine.default_top_k(length, top_k, 1.0)
    encoded = utility.encode_rows(df, model.numeric, model.groups.cats)
    with_items = utility.with_items(encoded, model.numeric, len(model.groups.cats), utility.item_lookup(model.items))
    codes = {r["label"]: r["y"] for r in model.codes.collect()}
    rows = [({s["id"]: s["u"] for s in r["items"]}, codes[r["y"]]) for r in with_items.orderBy("tid").collect()]
    expected = brute.mine(rows, len(codes), length, gain, k, mine.default_fs_k(fs_k, k))
    got = [
        (list(r["items"]), r["support"], int(r["util"]), r["ig"]) for r in model.patterns.orderBy("pid").collect()
    ]
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert all(abs(g[3] - e[3]) < 1e-9 for g, e in zip(got, expected))
    if length >= 3:
        assert any(len(g[0]) >= 3 for g in got)


def test_partitions_do_not_matter(spark):
    df = spark.createDataFrame(random_rows(6), "tid bigint, a int, b double, c string, d string, y int")
    results = []
    for n in (1, 4, 32):
        m = PatternMiner(label="y", keys=["tid"], bins=3, length=3).fit(df.orderBy(F.xxhash64("tid", F.lit(n))).repartition(n))
        results.append([tuple(r) for r in m.patterns.orderBy("pid").select("name", "support", "util", "ig").collect()])
    assert results[0] == results[1] == results[2] and results[0]


def test_budgets():
    assert [mine.default_top_k(n, -1, 1.0) for n in (-1, 1, 2, 3, 4, 5, 6, 7)] == [
        100, 100, 5050, 166750, 4087975, 79375495, 1271427895, 5050,
    ]
    assert mine.default_top_k(1, -1, 0.5) == 100 and mine.default_top_k(2, -1, 0.5) == 2525
    assert mine.default_fs_k(-1, 7) == 7 and mine.default_fs_k(9, 7) == 7 and mine.default_fs_k(3, 7) == 3


def test_rank_uses_single_precision_percent():
    assert quantile_ranks(7, 6) == [0, 1, 2, 3, 4, 6, 6]


@pytest.mark.parametrize("bad", [{"bins": 2.5}, {"length": "all"}, {"gain": "x"}, {"label": ""}, {"length": 0}])
def test_parameters_are_checked(bad):
    with pytest.raises((TypeError, ValueError)):
        PatternMiner(**{"label": "y", **bad}).validate()


def test_missing_values_are_rejected(spark):
    df = spark.createDataFrame([(1.0, "a", 0), (None, "b", 1)], "x double, c string, y int")
    with pytest.raises(ValueError, match="x"):
        PatternMiner(label="y").fit(df)
    with pytest.raises(ValueError, match="c"):
        PatternMiner(label="y").fit(df.select(F.lit(1).alias("x"), F.when(F.col("y") == 1, "k").alias("c"), "y"))


def test_dates_have_to_be_cast(spark):
    df = spark.sql("select timestamp '2020-01-01 00:00:00' as t, 1 as y")
    with pytest.raises(TypeError, match="t"):
        PatternMiner(label="y").fit(df)


def test_constant_columns_single_category_and_full_cover_give_nothing(spark):
    rows = [(7, 3.5, "k", i, i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, f double, c string, x int, y int")
    model = PatternMiner(label="y", bins=3).fit(df)
    names = {r["col"] for r in model.items.select("col").distinct().collect()}
    assert names <= {"x"} and dict(model.bin_counts()) == {"i": 0, "f": 0, "x": 3}


def test_many_and_odd_categories(spark):
    rows = [(i, f" k{i % 300:03d},x " if i % 300 else "plain", int(i % 300 < 40)) for i in range(1200)]
    df = spark.createDataFrame(rows, "tid bigint, c string, y int")
    model = PatternMiner(label="y", keys=["tid"], top_k=400).fit(df)
    assert model.dictionary().count() == 300
    assert model.dictionary().filter("label = 'k001,x'").count() == 1
    assert model.items.count() == model.items.select("item").distinct().count()


def test_negative_integers(spark):
    def right_edges(values):
        df = spark.createDataFrame([(v, int(i > 8)) for i, v in enumerate(values)], "x int, y int")
        return PatternMiner(label="y", bins=3).fit(df)

    below = right_edges([-9, -8, -7, -6, -5, -4, -3, -2, -1, -1])
    assert min(below.numeric[0].right_edges()) >= 1.0
    zero = right_edges([-9, -8, -7, -6, -5, -4, -3, -2, -1, 0])
    assert zero.items.count() == 0
    mixed = right_edges([-9, -7, -5, -3, -1, 1, 3, 5, 7, 9])
    assert max(mixed.numeric[0].right_edges()) == 1.0


def test_few_distinct_values_clamp_to_two_bins(spark):
    df = spark.createDataFrame([(i % 2, i % 2) for i in range(30)], "x int, y int")
    assert PatternMiner(label="y", bins=5).fit(df).numeric[0].edges == [0.0, 1.0]


def test_constant_hashes_change_nothing(spark, monkeypatch):
    """Row sets are told apart by counting, so hashes that tell nothing give the same patterns."""
    rows = [(i, a, b, c, d, a // 2, y) for i, a, b, c, d, y in random_rows(11, 60)]  # with a column of equal row sets
    df = spark.createDataFrame(rows, "tid bigint, a int, b double, c string, d string, e int, y int")

    def fit():
        m = PatternMiner(label="y", keys=["tid"], bins=3, length=3, gain=0.0).fit(df)
        return [tuple(r) for r in m.patterns.orderBy("pid").select("name", "support", "util", "ig").collect()], m.report

    want, report = fit()
    monkeypatch.setattr(mine, "set_hashes", lambda: [F.lit(0).cast("bigint").alias("h1"), F.lit(0).cast("bigint").alias("h2")])
    got, _ = fit()
    assert got == want and len(want) > 20
    assert report["patterns_same_rows"] > 0 and sum(lv["siblings_dropped"] for lv in report["levels"]) > 0


def test_spread_prefixes_give_the_same_patterns(spark, monkeypatch):
    df = spark.createDataFrame(random_rows(13), "tid bigint, a int, b double, c string, d string, y int")

    def fit(share):
        monkeypatch.setattr(mine, "HOT_SHARE", share)
        m = PatternMiner(label="y", keys=["tid"], bins=3, length=3, gain=0.0).fit(df)
        return [tuple(r) for r in m.patterns.orderBy("pid").select("name", "support", "util", "ig").collect()]

    light, some, heavy = fit(0), fit(2), fit(10**9)
    assert light == some == heavy and any(name.count("=") == 3 for name, *_ in light)


def test_a_hot_prefix_is_dealt_evenly(spark):
    state = spark.range(20_000).selectExpr("array(if(id % 10 < 9, 1, 2 + id % 40)) p", "xxhash64(id) h1", "id")
    lists = spark.createDataFrame([([i], [5, 6], 18_000 if i == 1 else 50) for i in range(1, 42)], "p array<bigint>, s array<int>, most bigint")
    met = mine.meet_siblings(state.withColumn("p", F.col("p").cast("array<bigint>")), lists, 20_000)
    assert met.count() == 20_000 and met.columns.count("p") == 1
    hot = state.filter("p[0] = 1").select(F.pmod("h1", F.lit(mine.SALTS)).alias("k")).groupBy("k").count().collect()
    sizes = sorted(r["count"] for r in hot)
    assert len(sizes) == mine.SALTS and sizes[-1] < 1.5 * sizes[0]
