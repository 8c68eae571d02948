"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text's UTF-8 bytes are cut into segments. One recurrence reads a segment forwards and one backwards, and from both states at
a byte the network gives the probability of each language at this byte. A text's probabilities are the means over all its
bytes. It is trained by backpropagation through time: the loss is the cross-entropy at every byte of a training segment.

The model (some 13,000 numbers) is learnt on the driver from a bounded number of segments; all bytes of all texts are labelled
in tasks, many segments at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gainsieve.llm.common import blocks

#: Units of the state in each direction.
HIDDEN = 8
#: Bytes of a text after which the recurrences start anew; segments that are run together, at most.
SEGMENT, TOGETHER = 128, 1024
#: Labelled documents to learn from, at most (those with the least hash of their id), segments of each, and their bytes.
MAX_DOCS, PIECES, PIECE = 4_000, 3, 64
#: Given for a text without letters, and for any text where no language could be learnt.
UNKNOWN = "und"


def squash(x: np.ndarray, out: np.ndarray | None = None, work: np.ndarray | None = None) -> np.ndarray:
    """x (27 + x^2) / (27 + 9 x^2), held at 1 and -1 from 3 and -3 on: the hyperbolic tangent but for 0.024, at half its cost."""
    out = np.clip(x, -3, 3, out=out)
    square = np.multiply(out, out, out=work)
    square += 3
    out *= square + 24
    square *= 9
    out /= square
    return out


def squash_slope(x: np.ndarray) -> np.ndarray:
    square = np.minimum(x * x, 9)
    return (9 - square) ** 2 / (9 * (3 + square) ** 2)


@dataclass
class BiGru:
    """For each direction: x (what a byte adds to reset gate, update gate and candidate, 3 by 256 by H), u (from the state, 3 by H by
    H), b (of the candidate's state part), v (state to languages); c: the languages' bias."""

    labels: list[str]
    x: list[np.ndarray]
    u: list[np.ndarray]
    b: list[np.ndarray]
    v: list[np.ndarray]
    c: np.ndarray

    def logits(self, data: np.ndarray, n: np.ndarray) -> np.ndarray:
        """T by B by languages, from T by B bytes; column j has n[j] bytes, and n falls. What lies beyond is without meaning."""
        steps, size = data.shape
        hidden = len(self.b[0])
        active = np.searchsorted(-n, -np.arange(steps), side="left")  # columns with more than t bytes come first
        out = np.zeros((steps, size, len(self.c)), np.float32) + self.c
        room = np.empty((5, size * hidden), np.float32)
        for d, order in enumerate((range(steps), range(steps - 1, -1, -1))):
            # half of what a gate squashes, and half of what it multiplies, is taken into the weights
            tables = [np.ascontiguousarray(t * np.float32(f)) for t, f in zip(self.x[d], (0.5, 0.5, 1))]
            maps = [np.ascontiguousarray(u * np.float32(0.5)) for u in self.u[d]]
            bias = self.b[d] * np.float32(0.5)
            h_all = np.zeros((size, hidden), np.float32)
            for t in order:
                m = active[t]
                if not m:
                    continue
                h, own = h_all[:m], data[t, :m]
                gates, work = room[:2].ravel()[: 2 * m * hidden].reshape(2, m, hidden), room[2:4].ravel()[: 2 * m * hidden].reshape(2, m, hidden)
                for k in (0, 1):
                    np.take(tables[k], own, axis=0, out=gates[k], mode="clip")
                    np.matmul(h, maps[k], out=work[k])
                gates += work
                squash(gates, gates, work)
                inner, new = work[0], room[4][: m * hidden].reshape(m, hidden)
                np.matmul(h, maps[2], out=inner)
                inner += bias
                np.take(tables[2], own, axis=0, out=new, mode="clip")
                new += inner
                inner *= gates[0]
                new += inner
                squash(new, new, inner)
                # update: h + (1 - z) (new - h), z = (1 + gate) / 2
                new -= h
                new *= np.float32(0.5)
                h += new
                new *= gates[1]
                h -= new
                out[t, :m] += h @ self.v[d]
        return out

    def pooled(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """A row of mean probabilities for each text; zeros for an empty one."""
        size = np.diff(off)
        count = -(-size // SEGMENT)
        text = np.repeat(np.arange(len(size)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        start = off[:-1][text] + nth * SEGMENT
        length = np.minimum(SEGMENT, off[1:][text] - start)
        total = np.zeros((len(size), len(self.c)))
        for lo in range(0, len(text), TOGETHER):
            order = lo + np.argsort(-length[lo : lo + TOGETHER], kind="stable")
            n = length[order]
            at = np.minimum(start[order] + np.arange(n[0])[:, None], len(data) - 1)
            p = self.logits(data[at], n)
            p -= p.max(2, keepdims=True)
            np.exp(p, out=p)
            p /= p.sum(2, keepdims=True)
            p[np.arange(n[0])[:, None] >= n] = 0
            np.add.at(total, text[order], p.sum(0, dtype=np.float64))
        return total / np.maximum(size, 1)[:, None]


def fresh(labels: list[str], hidden: int = HIDDEN, seed: int = 0, dtype=np.float32) -> BiGru:
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: [rng.normal(0, scale, shape).astype(dtype) for _ in range(2)]
    return BiGru(labels, draw(0.5, 3, 256, hidden), draw(hidden**-0.5, 3, hidden, hidden), draw(0, hidden), draw(hidden**-0.5, hidden, len(labels)), np.zeros(len(labels), dtype))


def loss_and_gradient(model: BiGru, data: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Weighted mean of the cross-entropy over all bytes, and its gradient in order of parameters(). data, n as in logits; y: the
    language of each column."""
    steps, size = data.shape
    dtype, hidden = model.c.dtype, len(model.b[0])
    real = (np.arange(steps)[:, None] < n).astype(dtype)[:, :, None]
    states, kept = [], []
    for d, order in enumerate((range(steps), range(steps - 1, -1, -1))):
        from_bytes = [table[data] for table in model.x[d]]
        h = np.zeros((size, hidden), dtype)
        before, pre_r, pre_z, pre_n, inner, after = (np.zeros((steps, size, hidden), dtype) for _ in range(6))
        for t in order:
            before[t] = h
            pre_r[t], pre_z[t] = (from_bytes[k][t] + h @ model.u[d][k] for k in (0, 1))
            inner[t] = h @ model.u[d][2] + model.b[d]
            pre_n[t] = from_bytes[2][t] + (0.5 + 0.5 * squash(0.5 * pre_r[t])) * inner[t]
            new, z = squash(pre_n[t]), 0.5 + 0.5 * squash(0.5 * pre_z[t])
            h = (new + z * (h - new)) * real[t]  # beyond the end the state stays empty
            after[t] = h
        states.append(after)
        kept.append((before, pre_r, pre_z, pre_n, inner))
    logits = sum(s @ v for s, v in zip(states, model.v)) + model.c
    logits -= logits.max(2, keepdims=True)
    p = np.exp(logits)
    total = p.sum(2, keepdims=True)
    p /= total
    share = real[:, :, 0] * weight[y] / (real[:, :, 0] * weight[y]).sum()
    own = logits[:, np.arange(size), y] - np.log(total[:, :, 0])
    p[:, np.arange(size), y] -= 1
    slope = p * share[:, :, None]
    by = np.argsort(data.ravel(), kind="stable")
    seen, first = np.unique(data.ravel()[by], return_index=True)
    grad_x, grad_u, grad_b, grad_v = [], [], [], []
    for d, order in enumerate((range(steps - 1, -1, -1), range(steps))):
        before, pre_r, pre_z, pre_n, inner = kept[d]
        r, z, new = 0.5 + 0.5 * squash(0.5 * pre_r), 0.5 + 0.5 * squash(0.5 * pre_z), squash(pre_n)
        slope_r, slope_z, slope_n = 0.25 * squash_slope(0.5 * pre_r), 0.25 * squash_slope(0.5 * pre_z), squash_slope(pre_n)
        into_r, into_z, into_n = inner * slope_r, (before - new) * slope_z, (1 - z) * slope_n
        gates, inners = np.zeros((3, steps, size, hidden), dtype), np.zeros((steps, size, hidden), dtype)
        down = slope @ model.v[d].T
        later = np.zeros((size, hidden), dtype)
        for t in order:
            dh = (down[t] + later) * real[t]
            dn = dh * into_n[t]
            gates[0, t], gates[1, t], gates[2, t], inners[t] = dn * into_r[t], dh * into_z[t], dn, dn * r[t]
            later = dh * z[t] + gates[0, t] @ model.u[d][0].T + gates[1, t] @ model.u[d][1].T + inners[t] @ model.u[d][2].T
        gx = np.zeros_like(model.x[d])
        for k in range(3):
            gx[k, seen] = np.add.reduceat(gates[k].reshape(-1, hidden)[by], first)
        over = lambda a, b: np.tensordot(a, b, ((0, 1), (0, 1)))
        grad_x.append(gx)
        grad_u.append(np.stack([over(before, g) for g in (gates[0], gates[1], inners)]))
        grad_b.append(inners.sum((0, 1)))
        grad_v.append(over(states[d], slope))
    return float(-(own * share).sum()), [*grad_x, *grad_u, *grad_b, *grad_v, slope.sum((0, 1))]


def parameters(model: BiGru) -> list[np.ndarray]:
    return [*model.x, *model.u, *model.b, *model.v, model.c]


def fit(pieces: list[bytes], langs: list[str], steps: int = 450, batch: int = 128, rate: float = 0.02, hidden: int = HIDDEN, seed: int = 0) -> BiGru | None:
    """Learn from pieces of texts (of at most PIECE bytes) and their languages, by Adam; each language counts the same. No pieces: None."""
    if not pieces:
        return None
    labels = sorted(set(langs))
    model = fresh(labels, hidden, seed)
    if len(labels) == 1:
        return model
    y = np.array([labels.index(x) for x in langs])
    n = np.array([len(p) for p in pieces])
    data = np.zeros((len(pieces), PIECE), np.uint8)
    for row, p in zip(data, pieces):
        row[: len(p)] = np.frombuffer(p, np.uint8)
    weight = (len(y) / np.bincount(y)).astype(np.float32)
    rng, own = np.random.default_rng(seed), parameters(model)
    first, second = [np.zeros_like(p) for p in own], [np.zeros_like(p) for p in own]
    for step in range(1, steps + 1):
        some = rng.integers(0, len(pieces), batch)
        _, grads = loss_and_gradient(model, np.ascontiguousarray(data[some].T), n[some], y[some], weight)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * (1 - 0.95 * step / steps)
        for p, g, a, b in zip(own, grads, first, second):
            g = g * np.float32(min(1.0, 1.0 / (norm + 1e-12)))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= np.float32(now) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return model


def fold(id_col: Column, folds: int = 3) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, held_out_fold: int = 1, max_docs: int = MAX_DOCS) -> BiGru | None:
    """Learn from documents (doc_id, text, lang) outside the held-out fold that have a language and a letter.

    From each of at most max_docs documents PIECES pieces are taken, at places that a hash of the text spreads over all of it.
    """
    raw = F.col("text").cast("binary")
    place = lambda i: (F.pmod(F.xxhash64("text", F.lit(i)), F.greatest(F.octet_length("text") - PIECE + 1, F.lit(1))) + 1).cast("int")
    known = docs.where(F.col("lang").isNotNull() & has_letter(F.col("text")) & (fold(F.col("doc_id")) != held_out_fold))
    cut = known.select("doc_id", "lang", F.array(*[F.substring(raw, place(i), F.lit(PIECE)) for i in range(PIECES)]).alias("pieces"))
    sample = cut.orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "pieces").limit(max_docs).select("lang", "pieces").toArrow()
    pieces, langs = sample["pieces"].to_pylist(), sample["lang"].to_pylist()
    return fit([p for ps in pieces for p in ps], [lang for lang in langs for _ in range(PIECES)])


def labelled(docs: DataFrame, model: BiGru | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for lo, hi, data, off in blocks(batch.column(1)):
                p = own.pooled(data, off)
                best = p.argmax(1)
                names = pa.DictionaryArray.from_arrays(pa.array(best.astype(np.int32)), pa.array(own.labels)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), names, pa.array(p[np.arange(len(p)), best])], ["doc_id", "lang_pred", "score"])

    with_letter = has_letter(F.col("text"))
    none = docs.where(~with_letter if model else F.lit(True)).select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    found = docs.where(with_letter).select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double").unionAll(none) if model else none
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1: the mean probability of lang_pred over all bytes), one row for each input row.

    Learnt from text and language of documents outside the held-out third; a prediction sees nothing but the text's bytes. A
    text that is null or has no letter (an empty one too), or any text where no language could be learnt, gives "und" with
    score 0. Of equally probable languages the first by code point is given. Null ids are not learnt from and not held out; rows
    that repeat come back as often as they are there; an empty table gives no rows. Texts of any length are labelled whole, in
    bounded memory. Other columns are not looked at.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return labelled(own.select("doc_id", "text"), train(own, max_docs=max_docs))
