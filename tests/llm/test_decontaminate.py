import hashlib
import re

import numpy as np

from gainsieve.llm.decontaminate import contamination, remove_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, own = words_of(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    own |= found
        sha = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(own), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def data():
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}é" if i % 7 == 0 else f"v{i}" for i in range(300)]
    pick = lambda n: rng.choice(vocabulary, n).tolist()
    items = [(i, " ".join(pick(n))) for i, n in enumerate([40, 13, 14, 12, 3, 60, 25, 1])]
    items += [(20, items[0][1]), (21, items[0][1].upper().replace("É", "é")), (22, ""), (23, None), (24, "., -- !")]
    docs = []
    for i in range(60):
        text = pick(int(rng.integers(1, 200)))
        for _ in range(rng.integers(0, 3)):
            own = words_of(items[rng.integers(0, 8)][1])
            a = int(rng.integers(0, len(own)))
            at = int(rng.integers(0, len(text)))
            text[at:at] = own[a : a + int(rng.integers(1, 40))]
        docs.append((i, ", ".join(text).replace("v1", "V1")))
    docs += [(100, None), (101, ""), (102, "!!"), (103, items[0][1] + " " + items[0][1]), (3, docs[3][1]), (104, "x " * 60000 + items[5][1])]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = data()
    left = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, item_id string, fp int").repartition(4)
    right = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, doc_id string")
    got = contamination(left, right)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)
    bad = {r[0] for r in brute(docs, items) if r[-1]}
    kept = remove_contaminated(left, right)
    assert kept.columns == left.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d[0] for d in docs if d[0] not in bad)


def test_empty_tables_and_nulls(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, None), (1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "B c"), (None, "a")], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"]) for r in contamination(docs, items).collect())
    assert got == [(0, 0, 0, 0), (0, 3, 3, 1), (1, 3, 3, 1)]
    assert [r["n_hit"] for r in contamination(docs, items.limit(0)).collect()] == [0, 0, 0]
    assert contamination(docs.limit(0), items).count() == 0
    assert remove_contaminated(docs, items).count() == 2
