import re
from itertools import permutations

import numpy as np
import pytest

from gainsieve.llm import audit
from gainsieve.llm.common import SpanHash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """docs: (id, lang, text); labels: (id, quality, toxic)."""
    docs = [(i, lang or "", text or "") for i, lang, text in docs]
    least = {}
    for i, _, t in docs:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    rows = []
    for i, lang, t in docs:
        words = WORD.findall(t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t],
        }
        rows.append((lang, {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, total = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            gone = set()
            for step, f in enumerate(order, 1):
                own = [(k, r) for k, r in enumerate(rows) if r[0] == part and f in r[1]]
                here = [(k, r) for k, r in own if k not in gone]
                redundant = len(own) - len(here)
                gone |= {k for k, _ in here}
                kept = sum(r[0] == part and k not in gone for k, r in enumerate(rows))
                out[part, order, step] = [kept, len(here), redundant, sum(r[1] == {f} for _, r in own), sum(r[2] for _, r in here), sum(r[3] for _, r in here)]
                total[part, f] = total.get((part, f), 0) + len(here)
    return {(*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LONG = " ".join(f"w{i}" for i in range(300))
DOCS = [
    (5, "en", LONG), (3, "en", LONG), (3, "en", LONG), (None, "en", LONG), (9, None, LONG), (1, "de", None), (2, "de", ""), (None, "de", ""), (4, "", "A " * 250), (4, "", "A " * 250),
    (6, "en", "ÀÉ Straße " * 120), (7, "fr", "x # y " * 100), (8, "fr", "tab\tline\x0bfeed\x0cend\r\n" * 60 + "\x1cno\xa0space"), (10, "en", "B%" + LONG), (11, "en", "q" * 300_000), (12, "de", "ab " * 90_000),
]
LABELS = [(3, 1, 0), (3, 0, 1), (5, 1, 1), (9, None, 1), (None, 1, 1), (4, 1, None), (99, 1, 1), (12, 7, 1)]


def frames(spark, docs=DOCS, labels=LABELS):
    d = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, lang string, text string, part string, step int").repartition(3)
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_equals_brute_force(spark):
    got = {tuple(r) for r in audit.audit(*frames(spark)).collect()}
    assert got == brute(DOCS, LABELS)


@pytest.mark.parametrize("docs,labels", [([], LABELS), (DOCS[:6], []), ([], [])])
def test_empty_tables(spark, docs, labels):
    rows = audit.audit(*frames(spark, docs, labels)).collect()
    assert {tuple(r) for r in rows} == brute(docs, labels)


def count(texts, hasher=None):
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    return audit.counts_of(np.frombuffer(b"".join(raw), np.uint8), off, hasher or SpanHash(11)).tolist()


def plain(t):
    words = WORD.findall(t)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", t)), len(t), len(re.findall(r"[#$%&*|]", t))]


def test_transducer_on_random_texts():
    rng = np.random.default_rng(0)
    signs = list("ab AB#|\t\n\r\x0b\x0c\x1c\x85\xa0é€𝄞$")
    texts = ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(500)] + ["", " ", "a", "", "a a a"]
    assert count(texts) == [plain(t) for t in texts]


def test_colliding_hashes_do_not_merge_words():
    class Same(SpanHash):
        def spans(self, sums, starts, ends):
            return np.zeros(len(starts), np.uint64)

    texts = ["ab ba ab aab b", "ab ba ca", "ac ac"]
    assert count(texts, Same(1)) == [plain(t) for t in texts]


def test_the_next_state_depends_on_the_class_alone():
    assert (audit.NEXT[0] == audit.NEXT[1]).all()
