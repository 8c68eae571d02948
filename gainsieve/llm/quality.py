"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its quantile bins, learnt by cyclic boosting: in turn, one shallow tree on one feature
is fitted to the gradient and added to that feature's table at a small rate. Then the pairs of features that explain most of
what is left get tables of their own over coarser bins, by the same cycle. A text's score is the logistic function of a sum
of table entries, looked up for whole batches.

The model is learnt on the driver from at most ``max_rows`` labelled rows (features, not texts); all texts are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gainsieve.llm.textstats import FEATURES, text_features
from gainsieve.sources.workspace import Workspace

#: Labelled rows that a model is learnt from, at most: those with the least hash of their id.
MAX_ROWS = 20_000


@dataclass
class AdditiveModel:
    """Tables over bins: main[f] by the bin of feature f, pairs[(f, g)] by the coarse bins of both."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float
    main: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, table in enumerate(self.main):
            out += table[np.searchsorted(self.edges[f], x[:, f])]
        for (f, g), table in self.pairs.items():
            out += table[np.searchsorted(self.coarse[f], x[:, f]), np.searchsorted(self.coarse[g], x[:, g])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower")).astype(np.float32)


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Step of a tree on one binned feature: the segment with the best cut is cut until there are enough leaves."""
    sg, sh = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a < 2:
                continue
            k = np.arange(a + 1, b)
            gain = _gain(sg[k] - sg[a], sh[k] - sh[a], ridge) + _gain(sg[b] - sg[k], sh[b] - sh[k], ridge) - _gain(sg[b] - sg[a], sh[b] - sh[a], ridge)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], (a, b), int(k[i]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    step = np.zeros(len(g))
    for a, b in parts:
        step[a:b] = (sg[b] - sg[a]) / (sh[b] - sh[a] + ridge)
    return step


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best tree of one cut in each of two features: its gain, and its step for each cell."""
    sums = []
    for m in (g, h):
        c = np.zeros((m.shape[0] + 1, m.shape[1] + 1))
        c[1:, 1:] = m.cumsum(0).cumsum(1)
        sums.append(c)

    def quarters(c):
        a, row, col, all_ = c[1:-1, 1:-1], c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return a, row - a, col - a, all_ - row - col + a

    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    gs, hs = quarters(sums[0]), quarters(sums[1])
    gain = sum(_gain(a, b, ridge) for a, b in zip(gs, hs)) - _gain(sums[0][-1, -1], sums[1][-1, -1], ridge)
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    values = [a[i, j] / (b[i, j] + ridge) for a, b in zip(gs, hs)]
    step = np.empty(g.shape)
    step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = values
    return float(gain[i, j]), step


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse_bins: int = 8, cycles: int = 80, rate: float = 0.1, leaves: int = 4, n_pairs: int = 6, ridge: float = 5.0) -> AdditiveModel:
    """Learn from rows of features x and labels y in {0, 1}. No rows: every score is 0.5. One class: near that class."""
    n_features = x.shape[1]
    if not len(x):
        none = [np.zeros(0, np.float32)] * n_features
        return AdditiveModel(none, none, 0.0, [np.zeros(1)] * n_features, {})
    edges, coarse = ([_edges(x[:, f], b) for f in range(n_features)] for b in (bins, coarse_bins))
    at = [np.searchsorted(edges[f], x[:, f]) for f in range(n_features)]
    at_coarse = [np.searchsorted(coarse[f], x[:, f]) for f in range(n_features)]
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(edges, coarse, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges], {})
    margin = np.full(len(x), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(cycles):
        for f in range(n_features):
            g, h = slopes()
            size = len(edges[f]) + 1
            step = rate * _tree(np.bincount(at[f], g, size), np.bincount(at[f], h, size), leaves, ridge)
            model.main[f] += step
            margin += step[at[f]]

    def cells(f: int, k: int, v: np.ndarray) -> np.ndarray:
        a, b = len(coarse[f]) + 1, len(coarse[k]) + 1
        return np.bincount(at_coarse[f] * b + at_coarse[k], v, a * b).reshape(a, b)

    g, h = slopes()
    ranked = sorted(((_quadrants(cells(f, k, g), cells(f, k, h), ridge)[0], f, k) for f in range(n_features) for k in range(f + 1, n_features)), reverse=True)
    chosen = [(f, k) for gain, f, k in ranked[:n_pairs] if gain > 0]
    for f, k in chosen:
        model.pairs[f, k] = np.zeros((len(coarse[f]) + 1, len(coarse[k]) + 1))
    for _ in range(cycles // 2):
        for f, k in chosen:
            g, h = slopes()
            step = rate * _quadrants(cells(f, k, g), cells(f, k, h), ridge)[1]
            model.pairs[f, k] += step
            margin += step[at_coarse[f], at_coarse[k]]
    return model


def fold(id_col: Column, folds: int = 3) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def train(features: DataFrame, labels: DataFrame, label: str = "quality", held_out_fold: int = 1, max_rows: int = MAX_ROWS) -> AdditiveModel:
    """Learn from the labelled rows outside the held-out fold; null ids and labels other than 0 and 1 are not learnt from.

    An id with several labels counts with its largest label, an id with several rows with one of the least features.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (fold(F.col("doc_id")) != held_out_fold))
    rows = features.groupBy("doc_id").agg(F.min("x").alias("x")).join(known.groupBy("doc_id").agg(F.max("y").alias("y")), "doc_id")
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("x", "y").toArrow()
    x = sample["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return fit(np.asarray(x, np.float32), sample["y"].to_numpy().astype(np.float64))


def scored(features: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return features.select("doc_id", "x").mapInArrow(run, "doc_id long, score double").select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from 0.5 on), one row for each input row.

    Null and empty texts are scored like any other, from their (zero) features; a null id is not held out. Repeated rows
    come back as often as they are there. Inputs of a score are the text's own features and nothing else.
    """
    ws = Workspace(docs.sparkSession)
    features = ws.table(text_features(docs, id_col, text_col), "features")
    return scored(features, train(features, labels, label, max_rows=max_rows))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted to be of good quality. Rows that repeat an id go or stay together (their best
    score counts); a null id stays."""
    bad = quality_scores(docs, labels).groupBy("doc_id").agg(F.max("score").alias("best")).where("best < 0.5").select("doc_id")
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
