import random

import pytest

from gainsieve import PatternMiner
from gainsieve.operators import lattice as lattices
from gainsieve.operators import mine
from gainsieve.plans import miner as miners
from tests.test_mining import random_rows

SHOWN = ["pid", "items", "name", "support", "util", "ig", "pure_class"]
POINTS = [(3, 0.06), (2, 0.0), (3, 0.0)]  # at a gain of 0 siblings with the same rows occur


def frame(spark, seed, twin=True):
    rng = random.Random(seed)
    rows = [(*r[:5], r[4] + "x" if twin else rng.choice("no"), r[5]) for r in random_rows(seed)]  # a column that repeats d
    return spark.createDataFrame(rows, "tid bigint, a int, b double, c string, d string, e string, y int")


def shown(model):
    return [tuple(r) for r in model.patterns.select(*SHOWN).orderBy("pid").collect()]


def counted_runs(monkeypatch):
    """Calls of mine.mine and of lattice.grow."""
    calls = {"mine": 0, "grow": 0}

    def counting(name, fn):
        def run(*args, **kwargs):
            calls[name] += 1
            return fn(*args, **kwargs)

        return run

    monkeypatch.setattr(mine, "mine", counting("mine", mine.mine))
    monkeypatch.setattr(miners, "grow", counting("grow", lattices.grow))
    return calls


@pytest.mark.parametrize("seed, keep, points", [(3, "lowest", POINTS), (4, "highest", POINTS[1:])])
def test_derived_patterns_equal_fits(spark, monkeypatch, seed, keep, points):
    df = frame(spark, seed)
    one = PatternMiner(label="y", keys=["tid"], bins=3, top_k=1_000_000, keep_duplicate=keep)
    calls = counted_runs(monkeypatch)
    models = one.fit_grid(df, points)
    assert calls == {"mine": 0, "grow": 1} and all(m.report["derived"] for m in models.values())
    dropped = 0
    for (length, gain), model in models.items():
        single = PatternMiner(label="y", keys=["tid"], bins=3, top_k=1_000_000, keep_duplicate=keep, length=length, gain=gain).fit(df)
        assert shown(model) == shown(single), (length, gain)
        assert {**model.report, "derived": 0} == single.report
        dropped += sum(lv["siblings_dropped"] for lv in single.report["levels"])
    assert dropped  # the twin column makes siblings with the same rows


def test_points_whose_budget_may_bind_are_mined(spark, monkeypatch):
    df = frame(spark, 5, twin=False)
    calls = counted_runs(monkeypatch)
    models = PatternMiner(label="y", keys=["tid"], bins=3, top_k=12).fit_grid(df, [(1, 0.02), (2, 0.02)])
    assert calls == {"mine": 2, "grow": 0} and not any(m.report["derived"] for m in models.values())


def test_length_without_limit_is_derived(spark):
    df = frame(spark, 6)
    models = PatternMiner(label="y", keys=["tid"], bins=3).fit_grid(df, [(-1, 0.1), (2, 0.05)])
    assert all(m.report["derived"] for m in models.values())
    assert shown(models[-1, 0.1]) == shown(PatternMiner(label="y", keys=["tid"], bins=3, length=-1, gain=0.1).fit(df))


def test_no_points(spark):
    assert PatternMiner(label="y").fit_grid(frame(spark, 7), []) == {}


def test_equal_hashes_do_not_join_classes(spark, monkeypatch):
    from pyspark.sql import functions as F

    df = frame(spark, 3)
    one = PatternMiner(label="y", keys=["tid"], bins=3, top_k=1_000_000)
    want = {p: shown(m) for p, m in one.fit_grid(df, [(2, 0.06)]).items()}
    monkeypatch.setattr(mine, "set_hashes", lambda: [F.lit(0).cast("bigint").alias("h1"), F.lit(0).cast("bigint").alias("h2")])
    assert {p: shown(m) for p, m in one.fit_grid(df, [(2, 0.06)]).items()} == want
