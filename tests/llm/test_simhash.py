import numpy as np
import pytest
import xxhash

from gainsieve.llm import simhash
from gainsieve.llm.components import components
from gainsieve.sources.workspace import Workspace

SCHEMA = "doc_id long, text string, fp string, component string"


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, radius):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fps))]


def texts():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    out = [None, "", " \t\n", "One two", "one TWO", "É x y z", "a b c d e " * 5000]
    for _ in range(40):
        base = rng.choice(words, 300).tolist()
        out.append(" ".join(base))
        for _ in range(rng.integers(0, 6)):
            edited = list(base)
            for _ in range(rng.integers(0, 4)):
                edited[rng.integers(300)] = "changed"
            out.append(" ".join(edited))
    return out


def test_groups_equal_brute_force(spark):
    own = texts()
    rows = [(i, t, "clash", "clash") for i, t in enumerate(own)] + [(3, own[3], "x", "x")]
    got = simhash.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    fps = [brute_fingerprint(t) for t in own]
    want = brute_groups(fps, 4)
    assert len(got) == len(rows)
    assert len(set(want)) < len(own) - 20
    for r in got:
        assert (int(r["fingerprint"], 16), r["component_id"]) == (fps[r["doc_id"]], want[r["doc_id"]])


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "p q r"), (None, None), (5, "p q r")], "doc_id long, text string")
    got = {(r["doc_id"], r["fingerprint"] == "0" * 16): r["component_id"] for r in simhash.near_duplicate_groups(df).collect()}
    assert got == {(None, False): 5, (None, True): None, (5, False): 5}
    assert simhash.near_duplicate_groups(df.limit(0)).count() == 0
    assert simhash.keep_representatives(df).count() == 3


@pytest.mark.parametrize("slack,together", [(1, 1), (0, 1), (0, 2)])
@pytest.mark.parametrize("spread", [3, 30])
def test_shards_lose_no_link(spread, slack, together):
    """Clusters and uniform noise, sent through deep trees with tiny shards."""
    rng = np.random.default_rng(spread)
    centres = rng.integers(0, 1 << 64, 30, np.uint64, endpoint=False)
    flips = np.zeros(1500, np.uint64)
    for _ in range(spread // 3 + 1):
        flips ^= np.uint64(1) << rng.integers(0, 64, 1500, np.uint64)
    fps = np.unique(np.concatenate([rng.choice(centres, 1500) ^ flips, rng.integers(0, 1 << 64, 500, np.uint64, endpoint=False)]))
    edges = []
    for t, mask in enumerate(simhash.block_masks(4, slack, together)):
        rows, node, home = simhash.Tree(fps, mask, 5, t).shards(fps, slack)
        assert np.array_equal(np.sort(rows[home]), np.arange(len(fps)))
        for n in np.unique(node):
            a, b = simhash.shard_edges(fps[rows[node == n]], home[node == n], 4, mask, slack)
            edges += list(zip(a.tolist(), b.tolist()))
    at = {f: i for i, f in enumerate(fps.tolist())}
    parent = simhash.Forest(len(fps))
    for a, b in edges:
        assert a != b
        parent.join(np.array([at[a]]), np.array([at[b]]))
    assert parent.roots().tolist() == brute_groups(fps.tolist(), 4)


def test_a_dense_ball_gives_a_forest_not_all_pairs():
    rng = np.random.default_rng(0)
    one = np.uint64(1)
    fps = np.unique((one << rng.integers(0, 64, 6000, np.uint64)) ^ (one << rng.integers(0, 64, 6000, np.uint64)))
    a, b = simhash.shard_edges(fps, np.ones(len(fps), bool), 4, simhash.block_masks(4, 1)[0], 1)
    assert len(a) < len(fps)
    assert len(set(b.tolist())) == 1


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100)]
    star = [(1000 + i, 999) for i in range(1, 300)] + [(-5, -7)]
    got = components(spark.createDataFrame(path + star + path[:3], "a long, b long"), Workspace(spark)).collect()
    assert {r["node"]: r["component"] for r in got} == {**{i: 0 for i in range(101)}, 999: 999, **{i: 999 for i in range(1001, 1300)}, -5: -7, -7: -7}
    assert len(got) == len({r["node"] for r in got})


@pytest.mark.parametrize("n", [1, 2**13, 2**20, 2**24, 2**28])
def test_copies_of_a_fingerprint_do_not_grow(n):
    fps = np.random.default_rng(1).integers(0, 1 << 64, 1 << 15, np.uint64, endpoint=False)
    masks = simhash.block_masks(4, 0, simhash.blocks_together(n, 4, 0))
    shards = [simhash.Tree(fps[:4096], m, simhash.depth_of(n, m.bit_count()), i).shards(fps, 0) for i, m in enumerate(masks)]
    assert sum(len(rows) for rows, _, _ in shards) <= 6 * len(fps)
    assert all(home.all() for _, _, home in shards)
    if n == 2**24:  # shards are as many as they should be, and none is far larger than the others
        size = np.unique(shards[0][1], return_counts=True)[1]
        assert len(size) > 500 and size.max() < 0.03 * len(fps)


def test_more_blocks_are_looked_at_together_when_one_tells_too_little():
    assert [simhash.blocks_together(n, 4, 0) for n in (1, 2**24, 2**28, 2**34, 10**12)] == [1, 1, 1, 2, 3]
    for together in (1, 2, 3):
        masks = simhash.block_masks(4, 0, together)
        rng = np.random.default_rng(together)
        for _ in range(200):
            d = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not d & m for m in masks)
