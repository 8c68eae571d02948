"""Benchmark decontamination by winnowing.

A benchmark item is covered by windows of 13 words (an item of fewer words is one window). Of the 5-word grams in a window the
one with the least hash (of equal ones the last) is its fingerprint, so equal windows have equal fingerprints at the same place
in them, and each shared span of 13 words or more is found. Windows next to each other mostly keep the same gram: such a run of
windows is one row, with the fingerprint, its place, and the hashes of the run's words, about one row for five words. Training
texts are winnowed the same way, and runs are joined on the fingerprint alone. A hit is then extended: the two runs are laid over
each other at the fingerprint, and the windows that both hold are compared word by word to its left and right.

Before the join, training runs whose fingerprint is surely absent are dropped by a bitmap of fixed size (2 MB) over the
benchmark's fingerprints; a benchmark of any size only makes it let more rows through to the join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gainsieve.llm.common import SpanHash, bitmap_of, blocks, gram_hash, in_bitmap, list_column, word_bounds
from gainsieve.sources.workspace import Workspace

WINDOW, GRAM = 13, 5
#: log2 of the bits in the bitmap of benchmark fingerprints.
BITMAP_BITS = 24

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _word_hash() -> SpanHash:
    out = SpanHash(3)
    out.values[0x41:0x5B] = out.values[0x61:0x7B]  # A-Z count as a-z
    return out


def _last_minimum(x: np.ndarray, n: int) -> np.ndarray:
    """Place of the least of each n values that follow each other; of equal ones the last."""
    at, span = np.arange(len(x)), 1
    while span < n:
        step = min(span, n - span)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(x[right] <= x[left], right, left)
        span += step
    return at


def _runs(words: np.ndarray, counts: np.ndarray, n: int, gram: int):
    """Of the windows of n words within a text: text, first and last start, place of the fingerprint, and fingerprint of each run
    of windows that share the place. All places are into words."""
    none = np.zeros(0, np.int64)
    if len(words) < n:
        return none, none, none, none, np.zeros(0, np.uint64)
    hashes = gram_hash(words, gram)
    text = np.repeat(np.arange(len(counts)), counts)
    starts = np.flatnonzero(text[: len(words) - n + 1] == text[n - 1 :])
    place = _last_minimum(hashes, n - gram + 1)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[starts[1:]] != text[starts[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    return text[starts[first]], starts[first], starts[last], place[first], hashes[place[first]]


def _word_lists(words: np.ndarray, first: np.ndarray, last: np.ndarray, n: int) -> pa.ListArray:
    """The hashes of all words of each run."""
    length = last - first + n
    at = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    return list_column(words[at].view(np.int64), length, pa.int64())


RUN = "n int, fp long, place int, windows int, words array<long>"


def benchmark_runs(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id (string), n, fp, place (of the fingerprint in the run), windows (their number), words: the distinct runs of each
    item; null and wordless items have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _word_hash()
        for batch in batches:
            for lo, _, data, off in blocks(batch.column(1)):
                starts, ends, counts = word_bounds(_IS_WORD[data], off)
                words = hashes.spans(hashes.running(data), starts, ends)
                for n in range(1, WINDOW + 1):
                    text, first, last, place, fp = _runs(words, counts, n, GRAM if n == WINDOW else n)
                    own = np.flatnonzero(counts[text] == n) if n < WINDOW else np.arange(len(text))
                    text, first, last, place, fp = (x[own] for x in (text, first, last, place, fp))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(text + lo)),
                            pa.array(np.full(len(first), n, np.int32)),
                            pa.array(fp.view(np.int64)),
                            pa.array((place - first).astype(np.int32)),
                            pa.array((last - first + 1).astype(np.int32)),
                            _word_lists(words, first, last, n),
                        ],
                        ["item_id", "n", "fp", "place", "windows", "words"],
                    )

    slim = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"item_id string, {RUN}").distinct()


def candidate_runs(docs: DataFrame, id_col: str, text_col: str, lengths: list[int], bitmap: Callable[[], np.ndarray]) -> DataFrame:
    """doc_id, n_words and the list runs (start, n, fp, place, windows, words) of those whose fingerprint may be the benchmark's."""
    names = ["start", "n", "fp", "place", "windows", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = _word_hash(), bitmap()
        for batch in batches:
            for lo, hi, data, off in blocks(batch.column(1)):
                starts, ends, counts = word_bounds(_IS_WORD[data], off)
                words = hashes.spans(hashes.running(data), starts, ends)
                begin = np.concatenate([[0], np.cumsum(counts)])
                texts, lists, parts = [], [], []
                for n in lengths:
                    text, first, last, place, fp = _runs(words, counts, n, GRAM if n == WINDOW else n)
                    own = np.flatnonzero(in_bitmap(bits, fp))
                    text, first, last, place, fp = (x[own] for x in (text, first, last, place, fp))
                    texts.append(text)
                    parts.append((first - begin[text], np.full(len(own), n), fp.view(np.int64), place - first, last - first + 1))
                    lists.append(_word_lists(words, first, last, n))
                text = np.concatenate([np.zeros(0, np.int64), *texts])
                order = np.argsort(text, kind="stable")
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
                columns = [pa.array(np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)])[order], k) for i, k in enumerate(kinds)]
                held = pa.concat_arrays([pa.array([], pa.list_(pa.int64())), *lists]).take(pa.array(order))
                ends_at = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=hi - lo))]).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(ends_at), pa.StructArray.from_arrays([*columns, held], names))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts.astype(np.int64)), runs], ["doc_id", "n_words", "runs"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, n: int, fp: long, place: int, windows: int, words: array<long>>>")


def extended(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """_row, start, n, r1, r2: the windows of candidates (start, n, fp, place, windows, words of a text's runs) that are windows of
    the benchmark's runs (with keys r1, r2), whole words on both sides of the shared fingerprint."""
    theirs = runs.select("fp", "n", F.col("place").alias("b_place"), F.col("windows").alias("b_windows"), F.col("words").alias("b_words"), "r1", "r2").distinct()
    met = candidates.join(theirs, ["fp", "n"]).withColumn("shift", F.col("b_place") - F.col("place"))
    # windows of the text's run whose counterpart is in the benchmark's
    low, high = F.greatest(F.lit(0), -F.col("shift")), F.least(F.col("windows"), F.col("b_windows") - F.col("shift")) - 1
    same = lambda w: F.slice("words", w + 1, F.col("n")) == F.slice("b_words", w + F.col("shift") + 1, F.col("n"))
    equal = F.when(low <= high, F.filter(F.sequence(low, F.greatest(low, high)), same))
    return met.select("_row", "start", "n", "r1", "r2", F.explode(equal).alias("w")).select("_row", (F.col("start") + F.col("w")).alias("start"), "n", "r1", "r2")


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: int = 20
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (share * n_hit >= n_words, n_hit > 0).

    Null, empty and wordless texts have no words and are clean; so are all documents if the benchmark is empty. Rows that
    repeat a doc_id are judged each on its own. Null item ids count in n_items no more than in the list: not at all. Texts of any
    length are winnowed whole; a gram that ties for the least hash is settled by its place, the same in both texts.
    Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    keys = [F.xxhash64("n", "fp", "place", "words").alias("r1"), F.xxhash64(F.lit(0x5EED), "n", "fp", "place", "words").alias("r2")]
    runs = ws.table(benchmark_runs(benchmark, item_col, item_text_col).select("*", *keys), "runs")
    lengths = sorted(r["n"] for r in runs.select("n").distinct().collect())  # at most 13 values
    shared = spark.sparkContext.broadcast(bitmap_of(runs, "fp", BITMAP_BITS))
    scanned = candidate_runs(docs, id_col, text_col, lengths, lambda: shared.value)
    rows = ws.table(scanned.withColumn("_row", F.monotonically_increasing_id()), "scanned")
    candidates = rows.where(F.size("runs") > 0).select("_row", F.explode("runs").alias("w")).select("_row", "w.*")
    hits = ws.table(extended(candidates, runs), "hits")

    # a text's hit words: the union of its windows, counted where each window goes on beyond all before it
    spans = hits.groupBy("_row", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    per_text = spans.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("upto"))
    step = lambda acc, s: F.struct(
        (acc["hit"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))).alias("hit"), F.greatest(acc["upto"], s["end"]).alias("upto")
    )
    n_hit = per_text.select("_row", F.aggregate("spans", zero, step)["hit"].alias("n_hit"))

    # items of one text are met once: equal items are a class, and each text meets a class once
    classes = runs.groupBy("item_id").agg(F.count("*").alias("c"), F.sum(F.col("r2").cast("decimal(38,0)")).alias("s"), F.min("r1").alias("m"))
    named = runs.join(classes, runs["item_id"].eqNullSafe(classes["item_id"])).select("c", "s", "m", "r1", "r2").distinct()
    met = hits.select("_row", "r1", "r2").distinct().join(named, ["r1", "r2"]).select("_row", "c", "s", "m").distinct()
    items = met.join(classes, ["c", "s", "m"]).groupBy("_row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))

    found = n_hit.join(items, "_row")
    return rows.select("_row", "doc_id", "n_words").join(found, "_row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.coalesce((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")), F.lit(False)).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """The rows of docs that are not contaminated. Of rows that repeat a doc_id, all go if one is; a null id always stays."""
    bad = contamination(docs, benchmark, share=share).where("contaminated").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


CONTAMINATION_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS span
  FROM items, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 12))) AS i) u WHERE len(w) > 0
), spans AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS span
  FROM words, (SELECT DISTINCT n FROM windows) k, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS i) u WHERE len(w) >= n
), hits AS (
  SELECT s.doc_id, s.i, s.n, v.item_id FROM spans s JOIN windows v ON s.n = v.n AND s.span = v.span
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
