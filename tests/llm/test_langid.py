import math
import zlib

import numpy as np
import pytest

from gainsieve.llm import langid

SF = "/root/testdata/sf0.01"


def squash(x):
    x = max(-3.0, min(3.0, x))
    return x * (27 + x * x) / (27 + 9 * x * x)


def states(model, d, data):
    """States of one direction after each byte, number by number."""
    (xr, xz, xn), (ur, uz, un), b = (m.astype(float) for m in model.x[d]), (m.astype(float) for m in model.u[d]), model.b[d]
    h, out = [0.0] * len(b), {}
    for t in range(len(data)) if d == 0 else range(len(data) - 1, -1, -1):
        dot = lambda u, j: sum(h[i] * u[i, j] for i in range(len(b)))
        new = []
        for j in range(len(b)):
            r, z = (0.5 + 0.5 * squash(0.5 * (x[data[t], j] + dot(u, j))) for x, u in ((xr, ur), (xz, uz)))
            c = squash(xn[data[t], j] + r * (dot(un, j) + b[j]))
            new.append((1 - z) * c + z * h[j])
        h = out[t] = new
    return out


def brute(model, text):
    raw, total = text.encode(), [0.0] * len(model.labels)
    for lo in range(0, len(raw), langid.SEGMENT):
        data = raw[lo : lo + langid.SEGMENT]
        both = [states(model, d, data) for d in (0, 1)]
        for t in range(len(data)):
            e = [model.c[k] + sum(h * v for d in (0, 1) for h, v in zip(both[d][t], model.v[d][:, k])) for k in range(len(total))]
            e = [math.exp(x) for x in e]
            total = [a + x / sum(e) / len(raw) for a, x in zip(total, e)]
    return total


@pytest.fixture(scope="module")
def model():
    out = langid.fresh(["a", "b", "c"], hidden=5, seed=3)
    for b in [*out.b, out.c]:
        b += np.linspace(-1, 1, len(b), dtype=np.float32)
    return out


def test_pooled_probabilities_equal_plain_python(model, monkeypatch):
    monkeypatch.setattr(langid, "TOGETHER", 3)
    texts = ["", "Ein kurzer Satz", "é" * 90, "x" * 128, "y" * 129, "abc " * 150, "\x00z"]
    raw = [t.encode() for t in texts]
    got = model.pooled(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in raw])]))
    assert np.allclose(got, [brute(model, t) for t in texts], atol=1e-5) and not got[0].any()


def test_gradient_equals_differences():
    model, rng = langid.fresh(["a", "b", "c"], hidden=4, seed=1, dtype=np.float64), np.random.default_rng(0)
    data, n, y, weight = rng.integers(0, 256, (9, 5)).astype(np.uint8), np.array([9, 9, 7, 3, 1]), np.array([0, 1, 2, 1, 0]), np.array([1.0, 2.0, 0.5])
    own = langid.parameters(model)
    _, grads = langid.loss_and_gradient(model, data, n, y, weight)
    for p, g in zip(own, grads):
        for at in zip(*(rng.integers(0, s, 12) for s in p.shape)):
            at = (at[0], data[0, 0], *at[2:]) if p.ndim == 3 and p.shape[1] == 256 else at
            kept, sides = p[at], []
            for step in (1e-6, -1e-6):
                p[at] = kept + step
                sides.append(langid.loss_and_gradient(model, data, n, y, weight)[0])
            p[at] = kept
            assert abs((sides[0] - sides[1]) / 2e-6 - g[at]) < 1e-7


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98
    blind = docs.selectExpr("doc_id + 0 doc_id", "text", "case when crc32(cast(doc_id as string)) % 3 = 1 then null else lang end lang", "'x' source")
    again = {r["doc_id"]: r["lang_pred"] for r in langid.identify(blind).collect()}
    assert all(again[r["doc_id"]] == r["lang_pred"] for r in rows)


def test_odd_rows(spark):
    rows = [(None, "Der Hund", "de", 1.0), (1, None, "de", 1.0), (2, "", "de", 1.0), (3, "123 !?\n", None, 1.0), (5, "der Hund und die Katze " * 100_000, None, 1.0), (6, "le chien", "fr", 1.0), (6, "le chien", "fr", 1.0), (7, "ß", "", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(3)
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    assert sorted(r["doc_id"] for r in got if r["lang_pred"] == "und") == [1, 2, 3] and all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert {r["lang_pred"] for r in got} <= {"und", "de", "fr", ""} and [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    nothing = langid.identify(docs.withColumn("lang", docs["lang"].substr(0, 0)).where("lang is null"))
    assert nothing.count() == 2 and {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0
