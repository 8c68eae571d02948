"""SimHash near-duplicate groups: exact pairs of close fingerprints by vantage-point trees, then connected components.

Fingerprints are made in Arrow batches. Equal ones are merged before anything else, so a group of exact copies, however
large, is one node. Close pairs are found in a vantage-point forest. The 64 bits are cut into blocks, and there is a tree for
each choice of some of them, whose metric is the Hamming distance within the chosen bits: two fingerprints within ``radius``
bits differ in at most ``slack`` of the bits of some choice. Vantage points come from a bounded sample; a node is cut at the
median distance to its vantage point, a fingerprint has one home shard, and by the triangle bound it is also sent to every
shard whose boundary is within ``slack`` of it. With ``slack`` 0, the default, no boundary is that near: a fingerprint is sent
once for each tree, five times in all, however many there are and however deep the trees. (With ``slack`` 1 and three trees a
third of the fingerprints lie on each boundary, so copies would grow by a third for each level.) A shard goes on with the tree
inside its task, first over the chosen bits and then over all 64 with the bound ``radius``, where queries near a boundary look
on both sides of it, and compares leaves exactly. It returns a spanning forest of its pairs, never all of them; components are
then found on Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gainsieve.llm.common import blocks, word_bounds
from gainsieve.llm.components import components
from gainsieve.sources.workspace import Workspace

SEED = 42
#: Points that vantage points and cuts are chosen from, at most.
SAMPLE = 4096
#: Fingerprints of a shard for which the tree is made; a larger shard is cut further inside its task.
SHARD = 8192
#: Levels of a tree outside the tasks, at most: its arrays are sent to all tasks (16 bytes a node and tree).
MAX_DEPTH = 16
#: Fingerprints in a leaf, whose pairs are all compared.
LEAF = 256
ALL_BITS = np.uint64((1 << 64) - 1)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN = np.arange(256, dtype=np.uint8)  # A-Z in lower case, white space as spaces
_PLAIN[0x41:0x5B] += 32
_PLAIN[_SPACE] = 32

#: The primes of XXH64; fixed values.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _lane(acc: np.ndarray, value: np.ndarray) -> np.ndarray:
    return _turn(acc + value * _P2, 31) * _P1


def xxh64_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many spans of a byte block at once: each step of the hash runs over all spans that have that step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,)).copy()  # the eight bytes from every place on
    one = np.array([seed], np.uint64)  # an array, whose sums wrap silently
    h = np.repeat(one + _P5, len(starts))
    at = starts.astype(np.int64)
    stripes = lengths >> 5
    if stripes.any():
        long = np.flatnonzero(stripes)
        acc = [np.repeat(v, len(long)) for v in (one + _P1 + _P2, one + _P2, one, one - _P1)]
        for k in range(int(stripes.max())):
            own = np.flatnonzero(stripes[long] > k)
            place = at[long[own]] + 32 * k
            for i in range(4):
                acc[i][own] = _lane(acc[i][own], words[place + 8 * i])
        g = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
        for v in acc:
            g = (g ^ _lane(np.zeros(1, np.uint64), v)) * _P1 + _P4
        h[long] = g
        at = at + 32 * stripes
    h += lengths.astype(np.uint64)
    rest = lengths & 31
    for k in range(3):
        own = np.flatnonzero(rest >= 8 * (k + 1))
        if len(own):
            h[own] = _turn(h[own] ^ _lane(np.zeros(1, np.uint64), words[at[own] + 8 * k]), 27) * _P1 + _P4
    at, rest = at + (rest & ~7), rest & 7
    own = np.flatnonzero(rest >= 4)
    if len(own):
        h[own] = _turn(h[own] ^ (words[at[own]] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
    at, rest = at + (rest & 4), rest & 3
    for k in range(3):
        own = np.flatnonzero(rest > k)
        if len(own):
            h[own] = _turn(h[own] ^ (words[at[own] + k] & np.uint64(0xFF)) * _P5, 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit; rows of bits are summed in bytes, 255 at a time, and then in long."""
    out = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 255 * 256):
        bits = np.unpackbits(hashes[lo : lo + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        out += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(0, dtype=np.int64) + np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)
    return out


def fingerprints_of(data: np.ndarray, off: np.ndarray, shingle: int = 4) -> np.ndarray:
    """One unsigned 64-bit fingerprint for each text of a block; a bit is set if over half of the shingle hashes have it."""
    out = np.zeros(len(off) - 1, np.uint64)
    space = _SPACE[data]
    starts, ends, counts = word_bounds(~space, off)
    if not len(starts):
        return out
    # words with one space between them: of each run of white space only the first byte stays
    keep = ~space
    keep[1:] |= ~space[:-1]
    place = np.concatenate([[0], np.cumsum(keep)])
    plain = _PLAIN[data[keep]]
    starts, ends = place[starts], place[ends]
    first = np.concatenate([[0], np.cumsum(counts)])
    grams = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    at = np.concatenate([[0], np.cumsum(grams)])
    begin = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], grams)
    final = np.minimum(begin + shingle, np.repeat(first[1:], grams)) - 1
    hashes = xxh64_spans(plain, starts[begin], ends[final] - starts[begin])
    for row in np.flatnonzero(grams).tolist():
        a, b = at[row], at[row + 1]
        out[row] = np.packbits(2 * _ones(hashes[a:b]) > b - a, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long). Null and wordless texts have fingerprint zero; one row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.zeros(batch.num_rows, np.uint64)
            for lo, hi, data, off in blocks(batch.column(1)):
                fps[lo:hi] = fingerprints_of(data, off, shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def block_masks(radius: int, slack: int, together: int = 1) -> list[int]:
    """Masks of all choices of ``together`` blocks of the 64 bits, cut into enough blocks: of two fingerprints within radius bits,
    each block of some choice differs in slack bits at most."""
    n = radius // (slack + 1) + together
    cuts = [64 * i // n for i in range(n + 1)]
    return [sum((1 << cuts[i + 1]) - (1 << cuts[i]) for i in some) for some in combinations(range(n), together)]


def blocks_together(n: int, radius: int, slack: int, shard: int = 8 * SHARD) -> int:
    """How many blocks a tree looks at: one, unless there are so many fingerprints that more than shard of them would agree on it."""
    together = 1
    while not slack and together < radius and n >> (64 * together // (radius + together)) > shard:
        together += 1
    return together


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Tree:
    """Vantage points and cut distances of the shards of one block: node i has children 2 i + 1 (near) and 2 i + 2 (far)."""

    def __init__(self, sample: np.ndarray, mask: int, depth: int, seed: int):
        self.mask, self.depth = np.uint64(mask), depth
        self.points = np.zeros(2**depth, np.uint64)
        self.cuts = np.zeros(2**depth, np.int64)
        rng = np.random.default_rng(seed)
        todo = [(0, 0, sample & self.mask)]
        while todo:
            node, level, own = todo.pop()
            if level == depth:
                continue
            # with too few points left to choose from, any bits do: the cut below is still sound
            pool = own if len(own) >= 8 else rng.integers(0, 1 << 64, 64, np.uint64, endpoint=False) & self.mask
            point = pool[rng.integers(len(pool))]
            d = distance(pool, point)
            self.points[node], self.cuts[node] = point, int(np.median(d))
            near = distance(own, point) <= self.cuts[node]
            todo += [(2 * node + 1, level + 1, own[near]), (2 * node + 2, level + 1, own[~near])]

    def shards(self, fps: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, shards and whether the shard is the row's home. By the triangle bound every point within slack
        (in the block) of a row has its home in one of the row's shards."""
        rows, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        home = np.ones(len(fps), bool)
        for _ in range(self.depth):
            d = distance(fps[rows] & self.mask, self.points[node]).astype(np.int64)
            cut = self.cuts[node]
            near = d <= cut
            to_near, to_far = near | (d - slack <= cut), ~near | (d + slack > cut)
            rows, node, home = (
                np.concatenate([rows[to_near], rows[to_far]]),
                np.concatenate([2 * node[to_near] + 1, 2 * node[to_far] + 2]),
                np.concatenate([(home & near)[to_near], (home & ~near)[to_far]]),
            )
        return rows, node, home


class Forest:
    """Union by smallest index over the fingerprints of one shard."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        p = self.parent
        while not np.array_equal(p, q := p[p]):
            p = q
        self.parent = p
        return p


def join_hits(forest: Forest, a: np.ndarray, b: np.ndarray) -> None:
    """Join all pairs of two rows, a few of them at a time: most are joined by then through others."""
    while True:
        roots = forest.roots()
        keep = roots[a] != roots[b]
        if not keep.any():
            return
        a, b = a[keep], b[keep]
        some = np.union1d(np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1])
        forest.join(a[some], b[some])


def close_pairs(fps: np.ndarray, home: np.ndarray, radius: int, mask: int, slack: int, forest: Forest) -> None:
    """Join home rows and the rows within radius bits of them that differ in at most slack bits of the mask.

    A vantage-point tree over the masked bits with the triangle bound slack; a branch that the masked bits cut no
    further goes on over all bits with the bound radius. Leaves are compared over all bits.
    """
    rng = np.random.default_rng(len(fps))
    todo = [(np.flatnonzero(home), np.arange(len(fps)), np.uint64(mask), slack)]  # every query is a candidate too
    while todo:
        queries, points, bits, bound = todo.pop()
        if not len(queries) or len(points) < 2:
            continue
        if len(points) <= LEAF or len(queries) <= 16:
            for lo in range(0, len(queries), 256):
                q = queries[lo : lo + 256]
                for at in range(0, len(points), 8192):
                    p = points[at : at + 8192]
                    i, j = np.nonzero(distance(fps[q][:, None], fps[p][None, :]) <= radius)
                    join_hits(forest, q[i], p[j])
            continue
        point = fps[points[rng.integers(len(points))]]
        whole = bits == ALL_BITS
        d = distance(fps[points] & bits, point & bits).astype(np.int64)
        if whole:  # by the triangle bound any two rows of this ball are within radius: a star joins them
            ball = points[2 * d <= radius]
            join_hits(forest, ball[1:], np.repeat(ball[:1], len(ball) - 1))
        cut = min(int(np.median(d)), int(d.max()) - 1)
        inner, outer = points[d <= cut + bound], points[d > cut - bound]
        # a query looks on its own side of the cut, and as far over it as the triangle bound asks
        near = distance(fps[queries] & bits, point & bits) <= cut
        n_near = int(near.sum())
        if n_near * len(inner) + (len(queries) - n_near) * len(outer) < 0.85 * len(queries) * len(points):
            todo += [(queries[near], inner, bits, bound), (queries[~near], outer, bits, bound)]
        elif not whole:
            todo.append((queries, points, ALL_BITS, radius))
        else:  # the bound prunes too little: compare in pieces
            todo += [(queries[lo : lo + 16], points, bits, bound) for lo in range(0, len(queries), 16)]


def shard_edges(fps: np.ndarray, home: np.ndarray, radius: int, mask: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as stars, of the close pairs of which one is at home here."""
    order = np.argsort(fps, kind="stable")
    fps, home = fps[order], home[order]
    forest = Forest(len(fps))
    close_pairs(fps, home, radius, mask, slack, forest)
    roots = forest.roots()
    own = np.flatnonzero(roots != np.arange(len(fps)))
    return fps[own], fps[roots[own]]


def depth_of(n: int, bits: int) -> int:
    """Levels that bring n fingerprints to about SHARD; not so many that shards of the trees outnumber what the bits tell apart."""
    return min(max(0, int(np.ceil(np.log2(max(1, n) / SHARD)))), bits, MAX_DEPTH)


def close_edges(distinct: DataFrame, n: int, radius: int, slack: int = 0) -> DataFrame:
    """a, b: edges whose components are those of all pairs of fingerprints (column fp) within radius bits."""
    spark = distinct.sparkSession
    masks = block_masks(radius, slack, blocks_together(n, radius, slack))
    depth = depth_of(n, min(m.bit_count() for m in masks))
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    trees = spark.sparkContext.broadcast([Tree(sample, m, depth, i) for i, m in enumerate(masks)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for t, tree in enumerate(trees.value):
                for lo in range(0, len(fps), 1 << 14):
                    own = fps[lo : lo + (1 << 14)]
                    rows, node, home = tree.shards(own, slack)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), t, np.int32)), pa.array(node), pa.array(own[rows].view(np.int64)), pa.array(home)],
                        ["tree", "shard", "fp", "home"],
                    )

    def pairs(table: pa.Table) -> pa.Table:
        fps = table["fp"].to_numpy().view(np.uint64)
        a, b = shard_edges(fps, table["home"].to_numpy(), radius, masks[table["tree"][0].as_py()], slack)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    sent = distinct.select("fp").mapInArrow(route, "tree int, shard long, fp long, home boolean")
    return sent.groupBy("tree", "shard").applyInArrow(pairs, "a long, b long")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links of radius bits or fewer.

    Null, empty and wordless texts have fingerprint zero and link like any other. A text of fewer than ``shingle`` words
    is one shingle; texts of any length are hashed whole. Nothing is ranked, so there are no ties. Repeated rows come back as often as they are there, in one component; a null id has a fingerprint and
    a component, and never is the smallest id (the component of null ids alone is null). Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession)
    rows = ws.table(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = ws.table(rows.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "distinct")
    edges = ws.table(close_edges(distinct, distinct.count(), radius), "edges")
    groups = components(edges, ws)  # node, component: fingerprints that have a link
    smallest = distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", "smallest", F.coalesce("component", "fp").alias("component"))
    named = smallest.groupBy("component").agg(F.min("smallest").alias("component_id"))
    # only fingerprints with a link can have another's id: the rest need no second shuffle
    linked = smallest.join(named, "component").select("fp", "component_id")
    return rows.join(linked, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """The rows of docs whose doc_id is its component's smallest; the other documents of each group go.

    Of rows that repeat a doc_id, all stay if that id stays; rows with a null id stay.
    """
    groups = near_duplicate_groups(docs, radius=radius, shingle=shingle)
    drop = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)
