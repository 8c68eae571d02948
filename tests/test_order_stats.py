import math
import random
from decimal import Decimal

import numpy as np
import pytest

from gainsieve.operators.encode import quantile_edges, quantile_ranks
from gainsieve.operators import order_stats
from gainsieve.operators.order_stats import kth_largest, median, order_statistics, profile_numeric
from gainsieve.sources.workspace import Workspace


def data(seed, n):
    rng = random.Random(seed)
    return [
        (rng.gauss(0, 50), 5.0 if rng.random() < 0.4 else rng.random(), rng.randint(0, 30), float(int(rng.expovariate(0.01))))
        for _ in range(n)
    ]


@pytest.mark.parametrize(("seed", "n", "max_distinct", "cells"), [(1, 5000, 200_000, 65_536), (2, 5000, 100, 50), (3, 3001, 10, 20)])
def test_exact_with_any_number_of_cells(spark, seed, n, max_distinct, cells):
    rows = data(seed, n)
    df = spark.createDataFrame(rows, "a double, b double, c int, d double").repartition(5)
    columns = ["a", "b", "c", "d"]
    profile = profile_numeric(df, columns)
    ranks = {c: sorted({0, n - 1, *quantile_ranks(n, 7), n // 3}) for c in columns}
    got = order_statistics(df, ranks, profile, Workspace(spark), max_distinct=max_distinct, cells=cells)
    for i, c in enumerate(columns):
        ordered = np.sort([r[i] for r in rows])
        assert got[c] == {r: ordered[r] for r in ranks[c]}


def test_edges_drop_repeats(spark):
    df = spark.createDataFrame([(1.0,)] * 50 + [(2.0,)] * 3 + [(3.0,)] * 2, "x double")
    assert quantile_edges(df, ["x"], 5, Workspace(spark)) == {"x": [1.0, 3.0]}


def test_median_skips_missing(spark):
    df = spark.createDataFrame([(1.0, 4), (float("nan"), None), (None, 1), (4.0, 2)], "x double, k int")
    assert median(df, ["x", "k"], Workspace(spark)) == {"x": 2.5, "k": 2.0}


def test_many_magnitudes_heavy_ties_and_infinities(spark):
    rng = np.random.default_rng(0)
    n = 4000
    wide = rng.choice([-1.0, 1.0], n) * 10.0 ** rng.uniform(-300, 300, n)
    tied = np.where(rng.random(n) < 0.7, 1e300, rng.normal(size=n))
    tiny = np.concatenate([rng.uniform(0, 1e-310, n - 3), [0.0, 1.0, -1e300]])
    ends = np.concatenate([[-math.inf] * 900, rng.normal(size=n - 1800), [math.inf] * 900])
    near = 1e9 + np.arange(n) * 1e-6
    columns = {"wide": wide, "tied": tied, "tiny": tiny, "ends": ends, "near": near}
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in zip(*columns.values())], ", ".join(f"{c} double" for c in columns)).repartition(4)
    ranks = {c: sorted({0, n - 1, *range(7, n, 331)}) for c in columns}
    got = order_statistics(df, ranks, profile_numeric(df, list(columns)), Workspace(spark), max_distinct=20, cells=300)
    for c, values in columns.items():
        assert got[c] == {r: np.sort(values)[r] for r in ranks[c]}


def test_no_task_merges_sketches(spark, monkeypatch):
    df = spark.range(5000).selectExpr("cast(id * 37 % 4999 as double) x", "sqrt(id) y")
    plans, counted = [], order_stats._counted_cells

    def watched(data, *args):
        monkeypatch.setattr(order_stats.F, "percentile_approx", None)
        plans.append(args)
        return counted(data, *args)

    monkeypatch.setattr(order_stats, "_counted_cells", watched)
    edges = quantile_edges(df, ["x", "y"], 4, Workspace(spark), max_distinct=50)
    assert plans and edges["x"] == [0.0, 1249.0, 2499.0, 3749.0, 4998.0]


@pytest.mark.parametrize("k", [1, 2, 777, 5_000_000, 5_999_999, 6_000_000])
def test_kth_largest_of_millions(spark, k):
    df = spark.range(6_000_000).selectExpr("cast(cast(id div 2 as decimal(38,0)) * 1000000000000000007 - 5 as decimal(38,0)) v")
    assert kth_largest(df, "v", k) == Decimal((6_000_000 - k) // 2) * 1000000000000000007 - 5


def test_kth_largest_of_few(spark):
    df = spark.createDataFrame([(3,), (None,), (3,), (-7,)], "v long")
    assert [kth_largest(df, "v", k) for k in range(5)] == [None, 3, 3, -7, None]
    assert kth_largest(df.limit(0), "v", 1) is None
