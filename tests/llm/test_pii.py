import os
import subprocess
import sys
import hashlib
import re

import numpy as np

from gainsieve.llm import crf, pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        if 16 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


CASES = [
    "mail a.b@c.de, or x@y, @z.com, a@b.c.d@e.f.g, p@q_r@s.t ü é@à.b",
    "1.2.3.4 and 1.2.3.4.5.6.7.8 or 256.1.1.1 or 01.002.3.4, 1..2.3.4 0000000255.1.1.1",
    "4111 1111 1111 1111, 4111-1111-1111-1112, 4111111111111111 4111, 41111111111111110000",
    "+1 (988) 555-2485, +49 30 123456, ++1 23, +1--- +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7, +123.",
    "éé a@b.cc éé 4111111111111111",
]


def line(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def test_base_spans_on_random_text():
    rng = np.random.default_rng(0)
    letters = list("0123456789" * 3 + "@@..+- ()ab_é\n%")
    for n in range(3000):
        text = "".join(rng.choice(letters, rng.integers(0, 60)))
        assert sorted(pii.base_spans(text)) == sorted(brute(text)), text


def test_find(spark):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(10, None), (11, ""), (12, "1" * 200_000 + "@" * 50_000 + "a" * 200_000), (0, CASES[0]), (None, CASES[1])]
    got = pii.find(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, spans string").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r["doc_id"]] or ""
        base = brute(text) if len(text) < 1000 else []
        assert r["base_sha256"] == hashlib.sha256(line(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in range(4)]
        assert set(line(base).split(",")) <= set(r["spans"].split(",")) or not base
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_field_finds_what_patterns_do_not(spark):
    train = pii.learn(pii.labelled_table(spark))
    test = pii.labelled_table(spark, 400, seed=99).collect()
    raw = [r["text"].encode() for r in test]
    off = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    words = crf.shapes(np.frombuffer(b"".join(raw), np.uint8), off)
    tags = train.decode(words)
    want = np.zeros(len(tags), int)
    for i, r in enumerate(test):
        for kind, a, b in zip(r["kinds"], r["starts"], r["ends"]):
            want[(words.starts[words.open] < off[i] + b) & (words.ends[words.open] > off[i] + a)] = crf.TAGS.index(kind)
    assert (tags == want).mean() > 0.97
    df = spark.createDataFrame([(1, "call (415) 555-0199 now"), (2, "in 1999 it was 12:30, 5% of 3.2"), (3, "see password=531ccd051a92ebcb68 la")], "doc_id long, text string")
    assert {r["doc_id"]: r["spans"] for r in pii.find(df).collect()} == {1: "phone:5:19", 2: "", 3: ""}


def test_viterbi_and_gradient_equal_enumeration():
    rng = np.random.default_rng(4)
    text = b"1 22 a 333 4 5@ b 6"
    words = crf.shapes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    k = len(crf.TAGS)
    field = crf.Field(rng.normal(size=(crf.SIZE, k)), rng.normal(size=(k, k)))
    score, got = words.x @ field.weights, field.decode(words)
    bounds = [*crf.runs(words).tolist(), len(got)]
    for a, b in zip(bounds, bounds[1:]):
        paths = np.indices((k,) * (b - a)).reshape(b - a, -1).T
        value = [sum(score[a + i, t] for i, t in enumerate(p)) + sum(field.moves[x, y] for x, y in zip([0, *p], [*p, 0])) for p in paths]
        assert tuple(got[a:b]) == tuple(paths[int(np.argmax(value))])


def test_fit_separates():
    text = b"aa 11 bb 2@2 cc 33 dd 4@4 5@5 ee 66 7@7"
    words = crf.shapes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    tags = np.array([0, 1, 0, 1, 1, 0, 1])
    assert crf.fit(words, tags, 200).decode(words).tolist() == tags.tolist()
    empty = crf.shapes(np.zeros(0, np.uint8), np.array([0]))
    assert crf.fit(empty, np.zeros(0, int)).decode(empty).tolist() == []


def test_a_text_of_numbers_is_decoded_in_bounded_memory():
    """In a process of its own, whose peak memory tells."""
    code = (
        "import resource, numpy as np\n"
        "from gainsieve.llm import crf\n"
        "text = b'12345 ' * 400_000 + b'word ' + b'7 x ' * 100_000\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "words = crf.shapes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))\n"
        "rng = np.random.default_rng(0)\n"
        "tags = crf.Field(rng.normal(size=(crf.SIZE, 5)), rng.normal(size=(5, 5))).decode(words)\n"
        "assert len(tags) == 500_000\n"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)\n"
    )
    mb = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.getcwd()).stdout)
    assert mb < 400


def test_features_do_not_depend_on_the_piece():
    text = b"a 12 b@c 3.4.5.6 x9 7 +1 y " * 40
    words = crf.shapes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert np.array_equal(words.x, np.concatenate([words.features(lo, lo + 7) for lo in range(0, len(words.open), 7)]))
