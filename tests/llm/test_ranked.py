import math
import re

import numpy as np
import pytest

from gainsieve.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, ts) for i, ts in own if ts]
    n, length = len(own), sum(len(ts) for _, ts in own)
    df = {}
    for _, ts in own:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        found = []
        for i, ts in own:
            m = 50 + 50 * len(ts) * n // length
            score = 0
            for t in set(terms(text)) & set(ts):
                tf = ts.count(t)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def frames(spark, docs, items):
    d = spark.createDataFrame([(*r, 1, "clash") for r in docs], "doc_id long, text string, score int, key string").repartition(5)
    return d, spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")


def words(rng, n, vocabulary=120):
    return " ".join(f"w{min(int(rng.zipf(1.3)), vocabulary)}" for _ in range(n))


@pytest.mark.parametrize("k,chunk", [(5, 40), (50, 1 << 15)])
def test_equals_brute_force(spark, monkeypatch, k, chunk):
    rng = np.random.default_rng(1)
    docs = [(i, words(rng, int(rng.integers(1, 80)))) for i in range(600)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)] + [(7, docs[7][1]), (None, docs[7][1]), (2000, None), (2001, ""), (2002, "!?"), (2003, "W1 w1, É é"), (2004, "w3 " * 100_000)]
    items = [(i, words(rng, int(rng.integers(1, 40)))) for i in range(25)] + [(100, "unknown terms"), (101, None), (102, ""), (103, "é"), (103, "é"), (None, docs[7][1])]
    monkeypatch.setattr(ranked, "CHUNK_DOCS", chunk)
    got = [tuple(r) for r in ranked.search(*frames(spark, docs, items), k=k, block_terms=60).collect()]
    assert sorted(got, key=str) == brute(docs, items, k)


def test_empty_tables(spark):
    docs, items = [(1, "a b"), (2, "a")], [(1, "b")]
    for d, i in ((docs, []), ([], items), ([], []), ([(1, None)], items)):
        assert ranked.search(*frames(spark, d, i)).count() == 0
    assert ranked.search(*frames(spark, docs, items)).count() == 1


def test_nra_reads_no_more_than_it_must():
    rng = np.random.default_rng(0)
    size = 20_000
    for trial in range(20):
        lists, total = [], np.zeros(size, np.int64)
        for _ in range(int(rng.integers(1, 7))):
            rows = rng.choice(size, int(rng.integers(1, size)), replace=False)
            impact = -np.sort(-rng.integers(1, 30 if trial % 2 else 10**9, len(rows)))
            lists.append((rows, impact))
            total[rows] += impact
        for k, floor in ((10, 0), (10, int(np.sort(total)[-3])), (size + 5, 0)):
            found, score = ranked.nra(lists, size, k, floor)
            kth = max(floor, int(np.sort(total)[-k]) if k <= size else 0, 1)
            assert np.array_equal(found, np.flatnonzero(total >= kth)) and np.array_equal(score, total[found])


class Counted(np.ndarray):
    """Impacts that remember how far they were read."""

    far = 0

    def __getitem__(self, at):
        out = super().__getitem__(at)
        self.far = max(self.far, at.stop if isinstance(at, slice) else at + 1)
        return out


def test_nra_stops_early():
    n = 100_000
    a, b = (np.arange(n, 0, -1).view(Counted) for _ in range(2))
    rows = np.arange(n)
    found, _ = ranked.nra([(rows, a), (rows, b)], n, 10)
    assert np.array_equal(found, np.arange(10)) and max(a.far, b.far) <= 1024
