"""Personal data: patterns with checks, and what a conditional random field over word shapes finds beside them.

The field is learnt on the driver from a small labelled table (column text, with the personal data in it marked) and sent to
the tasks; its size is fixed. Texts are scanned whole, in Arrow batches. Only words with a digit or an at-sign can be tagged,
so the chain falls apart at all others, and the short runs between are decoded by Viterbi all at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gainsieve.llm import crf
from gainsieve.llm.common import blocks
from gainsieve.sources.local import local_frame

KINDS = ("email", "ip", "card", "phone")
#: Rows of a labelled table that are learnt from, at most: the first by hash.
MAX_LABELLED = 2_000

# A match starts at the start of a run of digits in any case; saying so spares the search inside long runs.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, at-sign and dotted domain: from each at-sign leftwards, which is linear in the text."""
    floor, at = 0, text.find("@")
    while at >= 0:
        local = text[floor:at]
        start = floor + len(local.rstrip(_LOCAL))
        if start < at and (found := _DOMAIN.match(text, at)):
            yield start, found.end()
            floor = found.end()
        else:
            floor = at + 1  # no local part reaches over an at-sign
        at = text.find("@", max(floor, at + 1))


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[-1::-2]]
    even = [2 * int(d) for d in digits[-2::-2]]
    return (sum(odd) + sum(d - 9 if d > 9 else d for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(place in KINDS, start, end) by kind and start; matches that fail their check are dropped, not tried again."""
    out = [(0, *span) for span in emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def labelled_table(spark: SparkSession, rows: int = 600, seed: int = 7) -> DataFrame:
    """text, kinds, starts, ends (code points): short passages made by rule, with personal data of all kinds and numbers that are none."""
    rng = np.random.default_rng(seed)
    plain = "write to the office or call before noon and ask for details about our last order which came with a note".split()
    digits = lambda n: "".join(rng.choice(list("0123456789"), n))
    word = lambda: "".join(rng.choice(list("abcdefghiklmnoprstuvw"), rng.integers(3, 9)))
    kinds = {
        "email": [lambda: f"{word()}.{digits(2)}@{word()}{digits(1)}.example.com", lambda: f"{word()}@{word()}.org", lambda: f"{word()}_{word()}@mail.{word()}.net"],
        "ip": [lambda: ".".join(str(rng.integers(1, 255)) for _ in range(4))],
        "card": [lambda: digits(16), lambda: " ".join(digits(4) for _ in range(4)), lambda: "-".join(digits(4) for _ in range(4))],
        "phone": [
            lambda: f"+{rng.integers(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}",
            lambda: f"+{rng.integers(1, 99)} {digits(3)} {digits(3)} {digits(4)}", lambda: f"+{digits(11)}",
        ],
    }
    none = [
        lambda: digits(4), lambda: digits(2), lambda: f"{digits(1)}.{digits(1)}", lambda: f"${digits(3)}.{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"20{digits(2)}-0{rng.integers(1, 9)}-1{digits(1)}",
        lambda: "AKIA" + "".join(rng.choice(list("ABCDEFGH234567"), 16)), lambda: f"password={digits(4)}{word()}{digits(5)}", lambda: f"{digits(3)},{digits(3)}", lambda: f"{word()}{digits(2)}", lambda: f"@{word()}",
        lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"${digits(2)}.{digits(2)}", lambda: f"{digits(1)}%", lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"#{digits(5)}", lambda: f"{digits(6)}", lambda: f"\"{digits(5)}{word()}{digits(9)}\"", lambda: f"{digits(2)}%",
    ]
    table = []
    for _ in range(rows):
        text, own = "", []
        for part in range(int(rng.integers(1, 4))):
            text += " ".join(rng.choice(plain, rng.integers(1, 6))) + " "
            if rng.random() < 0.55:
                kind = str(rng.choice(KINDS))
                value = kinds[kind][rng.integers(len(kinds[kind]))]()
                own.append((kind, len(text), len(text) + len(value)))
                text += value
            else:
                text += str(rng.choice([" ", ", "])).join(none[rng.integers(len(none))]() for _ in range(rng.integers(1, 4)))
            text += str(rng.choice([" ", ". ", ", ", "\n"]))
        table.append((text, [k for k, _, _ in own], [a for _, a, _ in own], [b for _, _, b in own]))
    return local_frame(spark, table, "text string, kinds array<string>, starts array<int>, ends array<int>")


def learn(labelled: DataFrame, max_rows: int = MAX_LABELLED) -> crf.Field:
    """A field from a labelled table; of more than max_rows rows those with the least hash are taken. No rows: it tags nothing."""
    rows = labelled.where("text IS NOT NULL").orderBy(F.xxhash64("text"), "text").limit(max_rows).select("text", "kinds", "starts", "ends").collect()
    if not rows:
        return crf.Field(np.zeros((crf.SIZE, len(crf.TAGS))), np.where(np.arange(len(crf.TAGS)) == 0, 0.0, -1.0) + np.zeros((len(crf.TAGS), 1)))
    raw = [r["text"].encode() for r in rows]
    off = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    words = crf.shapes(np.frombuffer(b"".join(raw), np.uint8), off)
    tags = np.zeros(len(words.open), np.int64)
    for i, r in enumerate(rows):
        for kind, a, b in zip(r["kinds"] or [], r["starts"], r["ends"]):
            a, b = (off[i] + len(r["text"][:x].encode()) for x in (a, b))
            tags[(words.starts[words.open] < b) & (words.ends[words.open] > a)] = crf.TAGS.index(kind)
    return crf.fit(words, tags)


#: Digits that a span of the field must have to be of a kind.
_LEAST_DIGITS = {0: 0, 1: 4, 2: 13, 3: 7}


def _plausible(kind: int, value: bytes) -> bool:
    digits = sum(0x30 <= c < 0x3A for c in value)
    return digits >= _LEAST_DIGITS[kind] and (kind != 0 or b"@" in value[1:-1])


_OUTER = b".,;:!?\"'()[]{}<>"


def _tagged(words: crf.Words, tags: np.ndarray, raw: bytes, lead: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Spans of neighbouring words of one tag, without outer signs, by text and in code points, if they can be of that kind."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    own = np.flatnonzero(tags)
    if not len(own):
        return out
    at, text = words.open[own], words.text[words.open[own]]
    new = np.ones(len(own), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(text) != 0) | (np.diff(tags[own]) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(own)) - 1
    for i, j in zip(first.tolist(), last.tolist()):
        a, b = int(words.starts[at[i]]), int(words.ends[at[j]])
        value = raw[a:b]
        a += len(value) - len(value.lstrip(_OUTER.replace(b"(", b"")))
        b -= len(value) - len(value.rstrip(_OUTER))
        kind = int(tags[own[i]]) - 1
        if a < b and _plausible(kind, raw[a:b]):
            t = int(text[i])
            start = lead[off[t]]
            out.setdefault(t, []).append((kind, int(lead[a] - start), int(lead[b] - start)))
    return out


def _added(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of more (which do not overlap each other) that overlap no base span."""
    taken = sorted((a, b) for _, a, b in base)
    top, ends = 0, []
    for _, b in taken:
        top = max(top, b)
        ends.append(top)
    starts = np.array([a for a, _ in taken], np.int64)
    out = []
    for kind, a, b in more:
        before = int(np.searchsorted(starts, b, side="left"))  # base spans that start before b
        if not before or ends[before - 1] <= a:
            out.append((kind, a, b))
    return out


def _line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added).

    Spans are kind:start:end in code points, by kind and start. Null and empty texts have none. A span of the field that
    overlaps a base span is left out; base spans of different kinds may overlap. Texts of any length are scanned whole, in
    memory of some hundred bytes a word; nothing is ranked between rows, so there are no ties. Repeated rows and null ids are
    rows like any other, an empty table gives none, other columns are ignored.
    """
    spark = docs.sparkSession
    field = spark.sparkContext.broadcast(learn(labelled if labelled is not None else labelled_table(spark)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for lo, hi, data, off in blocks(batch.column(1)):
                words = crf.shapes(data, off)
                rows = [[0, 0, 0, 0, empty, ""] for _ in range(hi - lo)]
                if len(words.open):
                    raw = data.tobytes()
                    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    more = _tagged(words, field.value.decode(words), raw, lead, off)
                    for t in np.unique(words.text[words.open]).tolist():
                        base = base_spans(raw[off[t] : off[t + 1]].decode("utf-8", "replace"))
                        counts = np.bincount([k for k, _, _ in base], minlength=4).tolist() if base else [0] * 4
                        rows[t] = [*counts, hashlib.sha256(_line(base).encode()).hexdigest(), _line(base + _added(base, more.get(t, [])))]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()] * 2)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
