import math
import re
import zlib

import numpy as np

from gainsieve.llm import quality, textstats
from gainsieve.llm.common import SpanHash
from gainsieve.llm.quality import quality_scores

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scores = quality_scores(docs, labels)
    rows = scores.join(labels, "doc_id").collect()
    assert scores.count() == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c", 1), (1, None, 1), (2, "", 1), (3, "x " * 300_000, 1), (3, "x y", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 0), (2, None), (3, 1), (None, 1), (2, 7)], "doc_id long, quality int")
    for own in (labels, labels.limit(0), labels.where("quality = 1")):
        got = quality_scores(docs, own).collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
        assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert quality_scores(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns


def test_an_interaction_is_learnt():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9


def test_features_are_finite_and_do_not_depend_on_the_block():
    texts = ["", "One two, three!\nOne", "é" * 10, "\n \n", "a" * 1000, "123 (45) #x"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    together = textstats.features_of(np.frombuffer(b"".join(raw), np.uint8), off, SpanHash(9))
    assert np.isfinite(together).all() and not together[0].any()
    for row, b in zip(together, raw):
        alone = textstats.features_of(np.frombuffer(b, np.uint8), np.array([0, len(b)]), SpanHash(9))
        assert np.array_equal(alone[0], row)


def plain_features(text):
    """FEATURES of one text, word by word."""
    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    lines = [x for x in text.split("\n") if x]
    n, chars = max(len(words), 1), max(len(text), 1)
    share = lambda signs: sum(c in signs for c in text) / chars
    size = [len(w) for w in words]
    mean = sum(size) / n
    kinds = [
        math.log1p(len(text)), math.log1p(len(words)), mean, math.sqrt(max(sum(x * x for x in size) / n - mean * mean, 0)), sum(x > 12 for x in size) / n, sum(x <= 3 for x in size) / n,
        share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), sum(ord(c) > 127 for c in text) / chars, share(".?;:"), share(","), share("!*#%&$~^|"), share("()[]{}<>"),
        share("+-=/\\_@'\"`"), sum(w[-1] in "!*#%&$~^|+-=/\\_@`" for w in words) / n, sum("A" <= w[0] <= "Z" for w in words) / n, math.log1p(len(text) / max(len(lines), 1)),
        len(set(words)) / n, len(set(lines)) / max(len(lines), 1), max((words.count(w) for w in set(words)), default=0) / n,
    ]
    return kinds


def plain_score(model, x):
    """The sum of table entries, looked up one by one."""
    at = lambda edges, v: sum(e < v for e in edges)
    margin = model.base + sum(table[at(model.edges[f], x[f])] for f, table in enumerate(model.main))
    margin += sum(table[at(model.coarse[f], x[f]), at(model.coarse[g], x[g])] for (f, g), table in model.pairs.items())
    return 1 / (1 + math.exp(-margin))


def test_scores_equal_plain_python(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    features = textstats.text_features(docs)
    model = quality.train(features, labels)
    got = {r["doc_id"]: r["score"] for r in quality_scores(docs, labels).collect()}
    x = {r["doc_id"]: r["x"] for r in features.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] % 9 == 0}
    for i, text in texts.items():
        assert np.allclose(x[i], plain_features(text), rtol=1e-5, atol=1e-6)
    for i in x:
        assert abs(got[i] - plain_score(model, np.float32(x[i]))) < 1e-9
