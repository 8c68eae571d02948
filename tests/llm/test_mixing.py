import hashlib

import numpy as np

from gainsieve.llm.mixing import mix


def targets(sizes):
    """Water level by bisection over the sources' own words."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want = 1.5 * sum(sizes.values())
    lo, hi = 0.0, 1e9
    for _ in range(200):
        t = (lo + hi) / 2
        lo, hi = (t, hi) if sum(min(2 * sizes[s], weight[s] * t) for s in names) < want else (lo, t)
    return {s: min(2 * sizes[s], weight[s] * lo) for s in names}


def data():
    rng = np.random.default_rng(0)
    out = [(i, "w " * int(rng.integers(0, 200)), ["a", "b", "c", "d", "é", None][int(rng.choice(6, p=[0.5, 0.1, 0.2, 0.1, 0.05, 0.05]))]) for i in range(1500)]
    return out + [(2000, None, "a"), (2001, "", "empty only"), (2002, " x y z", "b"), (5, out[5][1], out[5][2]), (None, "w w w", "c"), (2003, "w " * 30_000, "d")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, source string, size int, key string").repartition(5)


def test_targets_and_served_words(spark):
    rows = data()
    got = mix(frame(spark, rows)).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len([w for w in (text or "").replace("\n", " ").split(" ") if w])
    want = targets(sizes)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-3
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    again = mix(frame(spark, rows[::-1])).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"], r["target"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_served_in_order_of_virtual_time(spark):
    """Of a source, all documents before the cut are served as often as each other, those after it once less."""
    for source in ("a", "c"):
        own = sorted((r for r in mix(frame(spark, data())).collect() if r["source"] == source and r["size"]), key=lambda r: r["finish"])
        passes = [r["taken"] / r["size"] for r in own]
        assert all(a >= b for a, b in zip(passes, passes[1:]))
        assert sum(p != int(p) for p in passes) <= 1
    some = [r for r in data() if r[0] is not None][:50]
    order = [hashlib.md5(f"mix-1:{i}".encode()).hexdigest() for i, _, _ in some]
    assert len(set(order)) == len(order)


def test_no_words_and_no_rows(spark):
    df = frame(spark, [(1, None, None), (2, " ", "x")])
    assert sorted((r["doc_id"], r["target"], r["taken"]) for r in mix(df).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]
    assert mix(df.limit(0)).count() == 0
