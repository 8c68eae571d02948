"""Filter interaction audit: what each of several quality filters removes, in every order in which they may be applied.

What the filters look at is counted by a table-driven byte transducer. Bytes fall into five classes, and two tables give for
each state (between words, in a word) and class the next state and what is emitted: a word begins, a word has ended, a
capital, a code point, a symbol. As a class alone decides the next state, the state before a byte follows from the byte before
it; both tables are folded into one over pairs of bytes, so the pass is a single look-up for each byte of a block of texts.
The word spans that it emits go into a hash table with open addressing, in which a word is taken for one that is there only
after their bytes have been compared.

Copies are found by the digest of the text: rows are counted by digest, so no group of copies is ever gathered. Which filters a
document fails, and its labels, then stand for it: counts of these combinations are all that the orders are applied to.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gainsieve.llm.common import SpanHash, blocks
from gainsieve.sources.workspace import Workspace

SYMBOLS = b"#$%&*|"
BETWEEN, INSIDE = 0, 1
SPACE, CAPITAL, SYMBOL, FOLLOWING, OTHER = range(5)
#: Bits that a byte may emit. END says that a word ended before this byte.
BEGIN, END, UPPER, POINT, SIGN = 1, 2, 4, 8, 16

CLASS_OF = np.full(256, OTHER, np.int64)
CLASS_OF[[0x20, *range(0x09, 0x0E)]] = SPACE
CLASS_OF[0x41:0x5B] = CAPITAL
CLASS_OF[list(SYMBOLS)] = SYMBOL
CLASS_OF[0x80:0xC0] = FOLLOWING  # second and later bytes of a code point

#: By state and class.
NEXT = np.array([[BETWEEN, INSIDE, INSIDE, INSIDE, INSIDE]] * 2)
EMIT = np.array(
    [
        [POINT, BEGIN | UPPER | POINT, BEGIN | SIGN | POINT, BEGIN, BEGIN | POINT],
        [END | POINT, UPPER | POINT, SIGN | POINT, 0, POINT],
    ]
)
#: What a byte emits, by 256 * the byte before it + the byte.
PAIRS = EMIT[NEXT[BETWEEN][CLASS_OF]][:, CLASS_OF].astype(np.uint8).ravel()

COUNTS = ["words", "distinct_words", "capitals", "points", "symbols"]
FILTERS = "ABCDE"


def transduce(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each byte emits, and starts and ends of words, for texts that lie between the offsets off."""
    before = np.empty(len(data), np.uint16)
    before[1:] = data[:-1]
    some = off[:-1] < off[1:]
    before[off[:-1][some]] = 0x20  # every text starts between words
    out = PAIRS[(before << np.uint16(8)) | data]
    ended = np.zeros(len(data) + 1, bool)
    ended[:-1] = (out & END) != 0
    last = off[1:][some]
    ended[last] |= CLASS_OF[data[last - 1]] != SPACE
    return out, np.flatnonzero(out & BEGIN), np.flatnonzero(ended)


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the spans of these lengths (1 at least) from a and from b hold the same bytes."""
    if not len(a):
        return np.zeros(0, bool)
    first = np.cumsum(length) - length
    within = np.arange(int(length.sum())) - np.repeat(first, length)
    differ = data[np.repeat(a, length) + within] != data[np.repeat(b, length) + within]
    return ~np.logical_or.reduceat(differ, first)


def first_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which words are the first of their kind in their text: those that an open-addressed hash table takes in.

    Words that meet in a slot are the same only if text, length and all bytes agree; others go on to the next slot. So hashes
    decide where a word is looked for, never whether it is new.
    """
    n = len(starts)
    new = np.zeros(n, bool)
    if not n:
        return new
    mask = (1 << (2 * n - 1).bit_length()) - 1
    table = np.full(mask + 1, -1, np.int64)
    length = ends - starts
    key = hashes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    slot = ((key ^ (key >> np.uint64(29))) & np.uint64(mask)).astype(np.int64)
    left = np.arange(n)
    while len(left):
        free = np.flatnonzero(table[slot] < 0)[::-1]
        table[slot[free]] = left[free]  # of several the last written stays: the first word
        holder = table[slot]
        new[left[holder == left]] = True
        near = np.flatnonzero((holder != left) & (text[holder] == text[left]) & (length[holder] == length[left]))
        found = holder == left
        found[near] = _same_bytes(data, starts[left[near]], starts[holder[near]], length[left[near]])
        left, slot = left[~found], (slot[~found] + 1) & mask
    return new


def counts_of(data: np.ndarray, off: np.ndarray, hasher: SpanHash) -> np.ndarray:
    """A row of COUNTS for each text."""
    out, starts, ends = transduce(data, off)
    at = np.searchsorted(starts, off)
    text = np.repeat(np.arange(len(off) - 1), np.diff(at))
    new = first_words(data, starts, ends, text, hasher.spans(hasher.running(data), starts, ends))
    rows = np.zeros((len(off) - 1, len(COUNTS)), np.int64)
    rows[:, 0] = np.diff(at)
    rows[:, 1] = np.bincount(text[new], minlength=len(off) - 1)
    some = np.flatnonzero(off[:-1] < off[1:])
    for i, bit in enumerate((UPPER, POINT, SIGN), 2):
        if len(some):
            rows[some, i] = np.add.reduceat((out & bit) != 0, off[:-1][some], dtype=np.int64)
    return rows


def text_counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep, and COUNTS (long) of the whole text, one row for each input row; a null text counts as an empty one."""
    names = [f"c{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash(11)
        for batch in batches:
            for lo, hi, data, off in blocks(batch.column(len(names))):
                rows = counts_of(data, off, hasher)
                own = [batch.column(i).slice(lo, hi - lo) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c) for c in rows.T)], [*names, *COUNTS])

    slim = docs.select(*[F.col(k).alias(n) for k, n in zip(keep, names)], F.col(text_col).cast("string").alias("text"))
    schema = ", ".join([*(f"{n} {slim.schema[n].dataType.simpleString()}" for n in names), *(f"{c} long" for c in COUNTS)])
    return slim.mapInArrow(run, schema).select(*[F.col(n).alias(k) for k, n in zip(keep, names)], *COUNTS)


def own_failures() -> list[Column]:
    """For rows of COUNTS: the filters A to D, null where passed."""
    failed = {
        "A": F.col("words") < 200,
        "B": 100 * F.col("distinct_words") < 50 * F.col("words"),
        "C": 100 * F.col("capitals") > 3 * F.col("points"),
        "D": F.col("symbols") > 0,
    }
    return [F.when(c, F.lit(k)) for k, c in failed.items()]


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, fails (list of filters), good, toxic, n: how many documents fail exactly these filters and have these labels.

    E is failed by a row with a larger id than the least id of its text; rows that repeat the least id pass, as do rows
    without an id, which are no one's original. An id with several labels is good, or toxic, if any of them says so.
    """
    ws = Workspace(docs.sparkSession)
    slim = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    rows = text_counts(slim, ["id", "part", "digest"]).select("id", "part", "digest", F.array_compact(F.array(*own_failures())).alias("fails"))
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), *[F.coalesce(F.col(c).cast("int") == 1, F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    marks = marks.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    no = F.lit(False)
    rows = ws.table(rows.join(marks, "id", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)}), "failures")
    kind = ["digest", "part", "fails", "good", "toxic"]
    repeated = rows.groupBy("id", *kind).agg(F.count("*").alias("c"))
    # a row for each kind of row that a text has: as few as there are parts and labels, however many copies
    of_text = repeated.groupBy(*kind).agg(F.sum("c").alias("n"), F.min("id").alias("least"), F.sum(F.when(F.col("id").isNull(), F.col("c"))).alias("nameless"), F.min_by("c", "id").alias("c"))
    least = F.min("least").over(Window.partitionBy("digest"))
    first = F.when(F.col("least") == F.col("first"), F.col("c")).otherwise(0) + F.coalesce("nameless", F.lit(0))
    split = of_text.withColumn("first", least).withColumn("passing", first)
    each = F.explode(F.array(F.struct(F.col("fails"), F.col("passing").alias("n")), F.struct(F.array_append("fails", F.lit("E")).alias("fails"), (F.col("n") - F.col("passing")).alias("n"))))
    return split.select("part", "good", "toxic", each.alias("x")).where("x.n > 0").groupBy("part", F.col("x.fails").alias("fails"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part, each
    order of the filters (letters) and each step of it.

    Of a document that fails m filters each of them is the first in the same share of all orders, so it counts for a filter's
    shapley with the number of orders over m, which is whole.
    """
    orders = ["".join(p) for p in permutations(filters)]
    step = F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step")
    each = counts.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).select("*", step)
    letters = F.split("filter_order", "")
    each = each.withColumn("own", F.array_contains("fails", F.element_at(letters, F.col("step")))).withColumn("before", F.arrays_overlap(F.slice(letters, F.lit(1), F.col("step") - 1), "fails"))
    own, before, n = F.col("own"), F.col("before"), F.col("n")
    total = lambda c, v=n: F.sum(F.when(c, v).otherwise(0)).cast("long")
    return each.groupBy("part", "filter_order", "step").agg(
        total(~own & ~before).alias("kept"), total(own & ~before).alias("removed"), total(own & before).alias("redundant"), total(own & (F.size("fails") == 1)).alias("unique_fails"),
        total(own & ~before & F.col("good")).alias("good_lost"), total(own & ~before & F.col("toxic")).alias("toxic_lost"),
        total(own, n * (F.lit(factorial(len(filters))) / F.size("fails")).cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Interactions of five filters over whole texts: A under 200 words; B fewer distinct words than half; C more than 3 capitals
    in 100 code points; D a symbol; E the text of a smaller id.

    Words are what stands between white space, compared as they are written. Null texts count as empty ones (which fail A, and
    E from the second on), a null part as "". An empty table gives no rows. Texts of any length are one pass. Rows that repeat
    an id count as often as they are there; of equal texts only rows with the least id pass E, so ties are settled by the id.
    Other columns are not looked at.
    """
    return interactions(failure_counts(docs, labels, id_col, text_col, part_col))


AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d
), l AS (
  SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l USING (doc_id)
), c AS (
  SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, step, filter_order[step] AS letter, filter_order[1:step - 1] AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, step, letter, fails, good, toxic, n, contains(fails, letter) AS own,
    len(list_filter(string_split(fails, ''), lambda k: k <> '' AND contains(earlier, k))) > 0 AS earlier_fail
  FROM c, s
), g AS (
  SELECT part, filter_order, step, letter, sum(CASE WHEN NOT own AND NOT earlier_fail THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN own AND NOT earlier_fail THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN own AND earlier_fail THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = letter THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN own AND NOT earlier_fail AND good = 1 THEN n ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN own AND NOT earlier_fail AND toxic = 1 THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM g
"""
