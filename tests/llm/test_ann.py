import numpy as np

from gainsieve.llm import ann


def brute(vectors, k, every):
    """vectors: {id: list}. Rows (query, rank, id, score)."""
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    out = {}
    for i in ids:
        if i % every == 0:
            s = np.cumsum(x * x[ids.index(i)], axis=1)[:, -1]
            best = [j for j in sorted(range(len(ids)), key=lambda j: (-s[j], ids[j])) if ids[j] != i][:k]
            out[i] = [(i, r, ids[j], float(s[j])) for r, j in enumerate(best, 1)]
    return out


def clustered(n, d=16, centres=40, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    x = c[rng.integers(0, centres, n)] + 0.35 * rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], SCHEMA).repartition(4)


def test_recall_scores_and_ranks(spark):
    x = clustered(4000)
    rows = [(i, x[i].tolist()) for i in range(4000)] + [(4000 + i, x[7].tolist()) for i in range(1500)]
    want = brute(dict(rows), 20, 20)
    got = {}
    for r in ann.nearest(frame(spark, rows), sample=2000, part=300).collect():
        got.setdefault(r["query_id"], []).append(tuple(r))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort(key=lambda r: r[1])
        assert [r[1] for r in found] == list(range(1, 21))
        assert all((-a[3], a[2]) < (-b[3], b[2]) for a, b in zip(found, found[1:]))
        hits += len({r[2:] for r in found} & {r[2:] for r in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_small_and_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (40, [2.0, 1.0]), (3, [-1.0, 0.5]), (60, None), (80, [0.0, 0.0]), (100, [nan, 1.0]), (120, [inf, 1.0]), (140, []), (160, [1.0, None]), (180, [1.0, 2.0, 3.0])]
    rows += [(None, [5.0, 5.0]), (0, [1.0, 2.0])]
    got = sorted(tuple(r) for r in ann.nearest(frame(spark, rows)).collect())
    want = brute({0: [1.0, 2.0], 20: [2.0, 1.0], 40: [2.0, 1.0], 3: [-1.0, 0.5]}, 20, 20)
    assert got == sorted(r for rs in want.values() for r in rs)
    assert ann.nearest(frame(spark, rows).limit(0)).count() == 0


def test_parts_are_balanced_and_keep_neighbours():
    x = clustered(2000).astype(float)
    graph = ann.neighbour_graph(x)
    label = ann.balanced_parts(graph, 8)
    size = np.bincount(label, minlength=8)
    assert size.min() > 0 and size.max() <= 1.1 * 250 + 1
    assert (label[graph] == label[:, None]).mean() > 0.6


def test_parts_follow_the_vectors_as_far_as_the_sample_tells_them_apart():
    assert [ann.parts_for(n, min(n, 6000)) for n in (0, 1, 2, 500, 3200, 51_000, 200_000, 10**9)] == [1, 1, 4, 4, 4, 64, 256, 256]
    assert ann.parts_for(10**9, 100_000) == 4096


def test_rows_returned_grow_with_the_logarithm_of_the_parts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 16)).astype(np.float32)  # no structure: nearly all parts are searched
    rows = [(i, x[i].tolist()) for i in range(6000)]
    returned, search = [], ann._search

    def counted(queries, placed, pieces, k):
        out = search(queries, placed, pieces, k).cache()
        returned.append((queries.select("part").distinct().count(), out.count()))
        return out

    monkeypatch.setattr(ann, "_search", counted)
    got = ann.nearest(frame(spark, rows), sample=2000, part=100, wanted=0.99).collect()
    want = brute(dict(rows), 20, 20)
    assert len(returned) >= 4 and sum(n for _, n in returned) <= 20 * 300 * (2 + 3 * len(returned))
    hits = sum(len({r[2:] for r in want[q]} & {tuple(r)[2:] for r in got if r[0] == q}) for q in want)
    assert hits / (20 * len(want)) >= 0.9


def test_an_infinite_product_ranks_first(spark):
    rows = [(0, [1e200, 1.0]), (1, [1e200, 0.0]), (2, [1.0, 1.0]), (3, [-1e200, 0.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(docs).orderBy("rank").collect()] == [(1, 1, float("inf")), (2, 2, 1e200 + 1.0), (3, 3, float("-inf"))]
