import hashlib
import time
from collections import Counter
from pathlib import Path

import numpy as np

from gainsieve.llm.substrings import digest, remove_repeats
from gainsieve.sources.workspace import RELEASE, shared_root


def brute(docs):
    raw = [(t or "").encode() for _, t in docs]
    seen = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for (doc, _), b in zip(docs, raw):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def data():
    rng = np.random.default_rng(1)
    letters = list("abcdefghij klmnopé")
    pick = lambda n: "".join(rng.choice(letters, n))
    passages = [pick(n) for n in (150, 199, 200, 201, 320, 900)]
    docs = []
    for i in range(60):
        parts = [pick(int(rng.integers(0, 300)))]
        for _ in range(rng.integers(0, 3)):
            parts += [passages[rng.integers(0, 6)], pick(int(rng.integers(0, 120)))]
        docs.append((i, "".join(parts)))
    base = pick(3000)
    for i in range(25):  # near copies with edits all over
        own = list(base)
        for _ in range(rng.integers(0, 12)):
            own[rng.integers(0, 3000)] = "#"
        docs.append((200 + i, "".join(own)))
    docs += [(300 + i, base[i : i + 700]) for i in range(0, 40, 3)]
    docs += [(400, None), (401, ""), (402, "a" * 199), (403, "b" * 200), (404, "c" * 201), (405, "xy" * 400), (406, "z" * 5000), (0, docs[0][1]), (407, base), (408, base), (409, base)]
    return docs


def test_equals_brute_force(spark):
    docs = data()
    df = spark.createDataFrame([(*d, 1, "clash") for d in docs], "doc_id long, text string, k1 int, lo string").repartition(5)
    assert sorted((tuple(r) for r in digest(df).collect()), key=str) == brute(docs)


def test_long_text_over_several_pieces(spark, monkeypatch):
    rng = np.random.default_rng(2)
    long = "".join(rng.choice(list("abcdefgh"), 6000))
    docs = [(1, long), (2, long[2500:3400] + "!"), (3, "?" + long[5900:] + long[:300])]
    from gainsieve.llm import common, substrings

    data, off = np.frombuffer(long.encode(), np.uint8), np.array([0, 6000])
    whole = [np.concatenate(x) for x in zip(*substrings.anchors(data, off, common.SpanHash(6)))]
    monkeypatch.setattr(substrings, "STEP_BYTES", 1000)
    pieces = [np.concatenate(x) for x in zip(*substrings.anchors(data, off, common.SpanHash(6)))]
    assert set(whole[1]) == set(pieces[1])
    assert (pieces[3] - pieces[2] + 1).sum() == (whole[3] - whole[2] + 1).sum() == 5801
    assert sorted((tuple(r) for r in digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str) == brute(docs)


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([(None, "q" * 250), (None, None), (3, "q" * 250)], "doc_id long, text string")
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in remove_repeats(df).collect()) == [(0, 0, 0), (250, 250, 1), (250, 250, 1)]
    assert remove_repeats(df.limit(0)).count() == 0


def test_leaves_one_table_and_no_shuffle_files(spark):
    docs = data()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffles = lambda: {str(f) for d in local for f in Path(d).rglob("shuffle_*.data")}
    root = Path(shared_root(spark).removeprefix("file:"))
    tables = lambda: {str(f) for f in root.glob("gainsieve-*/*")}
    files, folders, setting = shuffles(), tables(), spark.conf.get(RELEASE, None)
    out = digest(df)
    for _ in range(100):  # files go in the background
        if not shuffles() - files:
            break
        time.sleep(0.1)
    assert not shuffles() - files
    assert [f.rsplit("-")[-1] for f in tables() - folders] == ["ranges"]
    assert spark.conf.get(RELEASE, None) == setting
    for _ in range(2):  # what is left serves any number of runs
        assert sorted((tuple(r) for r in out.collect()), key=str) == brute(docs)
