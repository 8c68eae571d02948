"""Approximate nearest neighbours by learned partitions.

A neighbour graph over a bounded sample of the distinct vectors is cut into balanced parts that keep neighbours together. A
small classifier learns, from the vector alone, in which parts a vector's neighbours are; it places every vector in its most
probable part, and routes each query to its several most probable parts, whose members are scored exactly. How many parts
are searched is measured on the sample: as many as the wanted recall needs there.

Only the sample's graph and the classifier are made on the driver, so there are at most a sixteenth as many parts as sampled
vectors; up to there their number follows that of the vectors. Vectors are placed, routed and scored in tasks. A query's parts
are searched in rounds, the most probable one first, then three, twelve and so on: each round searches three times as many as
all before it. The ``k``-th score of all rounds before bounds the answer from below, and a part returns only rows that reach
it. That loses nothing, and what a query gets back grows with the logarithm of the number of parts. A part of very many vectors
is split into pieces of bounded size, as are the queries sent to it; a pair of pieces is one group, in which the queries are
taken block by block. Of equal vectors only the ``k + 1`` smallest ids can be among any query's ``k`` nearest, so the others are
left out before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gainsieve.sources.workspace import Workspace

#: Distinct vectors that the partitions are learnt from, at most: those with the least hash.
SAMPLE = 6_000
#: Distinct vectors in a part, about, and the least number of sampled vectors for a part.
PART, SAMPLED_PER_PART = 800, 16
NEIGHBOURS = 10
#: Share of the sample's neighbours that the parts searched must hold.
WANTED = 0.95
#: Vectors and queries in one group, about; all queries of a piece go to each piece of vectors.
PIECE, QUERY_PIECE = 16_384, 32_768


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Rows of the k rows with the largest inner product, in blocks."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo : lo + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def _halves(n: int, a: np.ndarray, b: np.ndarray, rng: np.random.Generator, steps: int = 60) -> np.ndarray:
    """Which rows of a graph with links a - b are in its second half: a cut at the median of its slow direction, by power iteration."""
    degree = np.sqrt(np.bincount(a, minlength=n) + 1e-9)
    x = rng.normal(size=n)
    for _ in range(steps):
        x -= degree * (x @ degree) / (degree @ degree)  # not the direction that all rows share
        x = 0.5 * x + 0.5 * np.bincount(a, x[b] / degree[b], minlength=n) / degree
        x /= np.linalg.norm(x) + 1e-300
    order = np.argsort(x / degree, kind="stable")
    second = np.zeros(n, bool)
    second[order[n // 2 :]] = True
    return second


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 0, rounds: int = 20, slack: float = 1.1) -> np.ndarray:
    """A part (of a power of two) for each row: the graph is halved until there are enough parts, then rows move to where most
    of their neighbours are, while no part gets over slack times its share."""
    n, k = graph.shape
    rng = np.random.default_rng(seed)
    a, b = np.repeat(np.arange(n), k), graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])  # links count both ways
    label = np.zeros(n, np.int64)
    for level in range(parts.bit_length() - 1):
        within = label[a] == label[b]
        for part in range(1 << level):
            own = np.flatnonzero(label == part)
            place = np.full(n, -1)
            place[own] = np.arange(len(own))
            link = within & (label[a] == part)
            label[own] += _halves(len(own), place[a[link]], place[b[link]], rng) << level
            within &= ~link  # halves that are made are not looked at again on this level
    most = int(np.ceil(slack * n / parts))
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (a, label[b]), 1.0)
        size = np.bincount(label, minlength=parts)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        moving = np.flatnonzero(gain > 0)
        for i in moving[np.argsort(-gain[moving], kind="stable")].tolist():
            if size[best[i]] < most and rng.random() < 0.7:  # not all at once: neighbours would swap for ever
                size[label[i]] -= 1
                label[i] = best[i]
                size[best[i]] += 1
        if not len(moving):
            break
    return label


@dataclass
class Router:
    """A classifier with one hidden layer over scaled vectors: scores of all parts."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) * self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 60, rate: float = 3e-3, seed: int = 0) -> Router:
    """Cross-entropy against the share of each row's neighbours in each part, by Adam."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    mean = x.mean(0)
    scale = 1 / max(float((x - mean).std()), 1e-12)
    p = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, target.shape[1])), np.zeros(target.shape[1])]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z = (x - mean) * scale
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 256):
            own = order[lo : lo + 256]
            h = np.maximum(z[own] @ p[0] + p[1], 0)
            s = h @ p[2] + p[3]
            q = np.exp(s - s.max(1, keepdims=True))
            g = (q / q.sum(1, keepdims=True) - target[own]) / len(own)
            gh = (g @ p[2].T) * (h > 0)
            t += 1
            for i, grad in enumerate((z[own].T @ gh + 1e-4 * p[0], gh.sum(0), h.T @ g + 1e-4 * p[2], g.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(mean, scale, *p)


def learn(x: np.ndarray, parts: int, wanted: float = WANTED, seed: int = 0) -> tuple[Router | None, int]:
    """A router over ``parts`` parts, and how many of a query's parts to search. Too few rows: no router, one part with all."""
    if parts < 2 or len(x) < 4 * parts:
        return None, 1
    # a fifth of the rows are not learnt from; they tell how many parts are needed
    order = np.random.default_rng(seed).permutation(len(x))
    test, own = order[: len(x) // 5], order[len(x) // 5 :]
    graph = neighbour_graph(x[own])
    label = balanced_parts(graph, parts, seed)
    target = np.zeros((len(own), parts))
    np.add.at(target, (np.repeat(np.arange(len(own)), graph.shape[1]), label[graph].ravel()), 1.0 / graph.shape[1])
    router = train_router(x[own], target, seed=seed)
    home = router.scores(x).argmax(1)
    ranks = np.argsort(np.argsort(-router.scores(x[test]), axis=1), axis=1)
    near = neighbour_graph(x)[test]
    needed = np.take_along_axis(ranks, home[near], axis=1).ravel()
    found = np.cumsum(np.bincount(needed, minlength=parts)) / max(1, len(needed))
    return router, int(np.searchsorted(found, wanted - 1e-12)) + 1


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (list of double) of the rows that take part, one for each id."""
    v = F.col(vector_col).cast("array<double>")
    inf = float("inf")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(inf))) & F.exists(v, lambda x: x != 0)
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(F.transform(F.array(v), lambda w: good)[0], F.lit(False)))
    return own.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _place(vectors: DataFrame, router, count: int, size: int, name: str) -> DataFrame:
    """vectors with the columns part (each of the count most probable), nth (from 0, the most probable) and name, a piece below
    the number that pieces tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = router.value
        for batch in batches:
            n = batch.num_rows
            if own is None or not n:
                best = np.zeros((n, 1), np.int64)
            else:
                best = np.argsort(-own.scores(_matrix(batch.column(1))), axis=1, kind="stable")[:, :count]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(r := pa.array(np.repeat(np.arange(n), best.shape[1]))), batch.column(1).take(r), pa.array(best.ravel().astype(np.int32)), pa.array(np.tile(np.arange(best.shape[1], dtype=np.int32), n))], ["vec_id", "v", "part", "nth"])

    placed = vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, part int, nth int")
    return placed.withColumn(name, F.xxhash64("vec_id", F.lit(size)))


def nearest(
    rows: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, part: int = PART, wanted: float = WANTED
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id ``every`` divides, the k rows with the largest inner
    product that were found, ties to the smaller id, never the query itself.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null ids; of vectors of
    several lengths those of the commonest (of equally common ones the least) take part. Repeated rows count once, and an id
    with several vectors counts with the least. Scores are sums in double precision in order of the components; one that overflows is
    infinite and ranks so, one that is no number is left out. Ties at the k-th place go to the smaller id. Other columns are ignored.
    """
    spark, inf = rows.sparkSession, float("inf")
    ws = Workspace(spark)
    own = ws.table(valid_vectors(rows, id_col, vector_col), "valid")
    sizes = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    vectors = own.where(F.size("v") == (sizes["d"] if sizes else 0))
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    kept = ws.table(vectors.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1), "distinct")
    n = kept.where("copy = 1").count()
    drawn = kept.where("copy = 1").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    parts = parts_for(n, len(drawn), part)
    model, count = learn(_matrix(drawn["v"]), parts, wanted)
    router = spark.sparkContext.broadcast(model)

    placed = ws.table(_place(kept, router, 1, 1, "h"), "placed")
    sent = ws.table(_place(vectors.where(F.col("vec_id") % every == 0), router, count, 2, "h"), "sent")
    pieces = placed.groupBy("part").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("cs"))  # at most as many rows as parts
    found, bounds, lo = None, None, 0
    while found is None or lo < count:
        hi = max(1, 4 * lo)
        asked = sent.where(F.col("nth").between(lo, hi - 1))
        asked = asked.join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(-inf))) if bounds else asked.withColumn("bound", F.lit(-inf))
        more = _search(asked, placed, pieces, k)
        found = ws.table(_best(found.drop("rank").unionAll(more) if found else more, k), f"round-{lo}")
        bounds = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
        lo = hi
    return found.select("query_id", "rank", "vec_id", "score")


def parts_for(n: int, sampled: int, part: int = PART) -> int:
    """A power of two: about part of the n vectors in each, 4 at least, and no more than the sample can tell apart."""
    if n < 2:
        return 1
    most = 1 << max(0, (sampled // SAMPLED_PER_PART).bit_length() - 1)
    return min(max(4, most), max(4, 1 << int(np.ceil(np.log2(n / part))) if n > part else 1))


def _best(found: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, rank of the k nearest rows of each query."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _search(queries: DataFrame, placed: DataFrame, pieces: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: of each pair of pieces the k nearest of each query (vec_id, v, part, h, bound) that reach its bound."""

    def score(asked: pa.Table, points: pa.Table) -> pa.Table:
        q_id, p_id = asked["vec_id"].to_numpy(), points["vec_id"].to_numpy()
        ids, rows, scores = [], [], []
        if len(q_id) and len(p_id):
            q, p, bound = _matrix(asked["v"]), _matrix(points["v"]), asked["bound"].to_numpy()
            order = np.argsort(p_id, kind="stable")
            p_id, p = p_id[order], p[order]
            for lo in range(0, len(q), 256):
                s = q[lo : lo + 256] @ p.T
                for i, row in enumerate(s, lo):
                    out = (p_id == q_id[i]) | np.isnan(row)
                    row[out] = -np.inf
                    # near ties of the matrix product stay in, and are settled by the exact sums
                    edge = max(bound[i], np.partition(row, -k)[-k] if len(row) > k else -np.inf)
                    some = np.flatnonzero(row >= (edge - 1e-9 * (1 + abs(edge)) if np.isfinite(edge) else edge))
                    some = some[~out[some]]
                    exact = np.cumsum(q[i] * p[some], axis=1)[:, -1] if len(some) else np.zeros(0)
                    best = np.lexsort((p_id[some], -exact))[:k]
                    best = best[exact[best] >= bound[i]]
                    ids.append(np.full(len(best), q_id[i]))
                    rows.append(p_id[some[best]])
                    scores.append(exact[best])
        flat = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
        return pa.table({"query_id": flat(ids, np.int64), "vec_id": flat(rows, np.int64), "score": flat(scores, np.float64)})

    keys = ["part", "q", "c"]
    counts = pieces.join(queries.groupBy("part").agg(F.ceil(F.count("*") / QUERY_PIECE).cast("int").alias("qs")), "part")
    left = queries.join(counts, "part").select("part", F.pmod("h", "qs").cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.col("cs") - 1)).alias("c"), "vec_id", "v", "bound")
    right = placed.join(counts, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), F.pmod("h", "cs").cast("int").alias("c"), "vec_id", "v")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, "query_id long, vec_id long, score double")
