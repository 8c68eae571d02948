"""Ranked lexical search by NRA, the threshold algorithm with no random access, over impact-sorted lists.

One pass over the documents keeps, for each, its number of terms and the terms that a query may hold, with their occurrences;
a bitmap of fixed size (2 MB) over the hashes of all query terms drops the rest. Sums of this table give the number of
documents, their length and the documents of each term, and so the weight of each query's terms.

The table is then searched where it lies: a task takes its documents in chunks of bounded size, sorts the occurrences of each
term by falling impact, and reads the lists of a query in step, block by block. What is read of a document adds up to a lower
bound of its score; the last impacts read in its lists not yet met make the upper bound. Documents whose upper bound is below
the k-th lower bound are out. Reading goes on, only in lists that some undecided document may still be in, until all that are
left have equal bounds: their scores, and with them membership and the order of ties, are then exact. The k-th score of a task's
earlier chunks holds for its later ones. Tasks return their k best of each query, and these are ranked in two steps.

Queries are taken in blocks with a bounded number of terms; each block is one pass over the (small) table.

A term is its 64-bit hash. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gainsieve.llm.common import SpanHash, bitmap_of, blocks, in_bitmap, list_column, word_bounds
from gainsieve.sources.workspace import Workspace

#: log2 of the bits in the bitmap of query terms.
BITMAP_BITS = 24
#: Terms of all queries in a block, about; occurrences and documents in a chunk, at most (a single document may have more).
BLOCK_TERMS, CHUNK_TERMS, CHUNK_DOCS = 1 << 17, 1 << 20, 1 << 15
#: Entries of each list that the first round reads; each further round reads twice as many.
FIRST_READ = 256
#: Groups of tasks whose results are ranked together first.
GROUPS = 64

_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _hasher() -> SpanHash:
    out = SpanHash(12)
    out.values[0x41:0x5B] = out.values[0x61:0x7B]  # A-Z count as a-z
    return out


def _term_counts(data: np.ndarray, off: np.ndarray, hasher: SpanHash, bits: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Terms with repeats in each text, and text, hash and occurrences of its distinct terms that bits lets through."""
    starts, ends, n = word_bounds(_IS_TERM[data], off)
    hashes = hasher.spans(hasher.running(data), starts, ends)
    text = np.repeat(np.arange(len(n)), n)
    if bits is not None:
        own = in_bitmap(bits, hashes)
        hashes, text = hashes[own], text[own]
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    return n, text[at], hashes[at], np.diff(np.append(at, len(hashes)))


def term_table(rows: DataFrame, id_col: str, text_col: str, bits=None) -> DataFrame:
    """id, n (terms with repeats), terms (hashes, ascending) and tf (occurrences) for each row; null texts have no terms.

    bits: a broadcast bitmap; terms that are not in it are left out of terms and tf, but not of n.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for batch in batches:
            for lo, hi, data, off in blocks(batch.column(1)):
                n, text, hashes, tf = _term_counts(data, off, hasher, bits.value if bits else None)
                per = np.bincount(text, minlength=hi - lo)
                lists = list_column(hashes.view(np.int64), per, pa.int64()), list_column(tf, per, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), *lists], ["id", "n", "terms", "tf"])

    slim = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, n long, terms array<long>, tf array<int>")


def nra(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, floor: int = 0, first_read: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray]:
    """Rows below size that may be among the k with the largest sums, and these sums, exactly.

    lists: rows (each once) and their positive impacts in falling order. All rows of a sum of at least the k-th, and of at least
    floor, are returned; a row in no list has the sum 0 and is not.
    """
    lower, credit = np.zeros(size, np.int64), np.zeros(size, np.int64)  # credit: frontiers of the lists that a row was met in
    read, frontier = [0] * len(lists), [int(impact[0]) for _, impact in lists]
    going, step = [i for i, (rows, _) in enumerate(lists) if len(rows)], first_read
    while True:
        for i in going:
            rows, impact = lists[i]
            end = min(len(rows), read[i] + step)
            lower[rows[read[i] : end]] += impact[read[i] : end]
            credit[rows[: read[i]]] -= frontier[i]
            frontier[i] = int(impact[end - 1]) if end < len(rows) else 0
            if frontier[i]:
                credit[rows[:end]] += frontier[i]
            read[i] = end
        kth = max(floor, int(np.partition(lower, size - k)[size - k]) if size >= k else 0, 1)
        unread = sum(frontier) - credit
        undecided = (lower + unread >= kth) & (unread > 0)
        left = int(undecided.sum())
        if not left:
            break
        going = [i for i in range(len(lists)) if frontier[i] and int(undecided[lists[i][0][: read[i]]].sum()) < left]
        step *= 2
    found = np.flatnonzero(lower >= kth)
    return found, lower[found]


@dataclass
class Query:
    """Terms with positive weights, and the best rows met so far: scores, whether the id is missing, ids."""

    key: int
    terms: np.ndarray
    weights: np.ndarray
    best: tuple[np.ndarray, np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)))

    def add(self, score: np.ndarray, missing: np.ndarray, ids: np.ndarray, k: int) -> None:
        score, missing, ids = (np.concatenate(x) for x in zip(self.best, (score, missing, ids)))
        order = np.lexsort((ids, missing, -score))[:k]
        self.best = score[order], missing[order], ids[order]

    def floor(self, k: int) -> int:
        return int(self.best[0][-1]) if len(self.best[0]) == k else 0


def _search_chunk(table: pa.Table, queries: list[Query], known: np.ndarray, documents: int, length: int, k: int) -> None:
    """Add to each query the best of the documents (id, n, terms, tf) of a chunk. known: all terms of the queries, ascending."""
    column = lambda name: table[name].combine_chunks()
    ids, missing = column("id").fill_null(0).to_numpy(zero_copy_only=False), column("id").is_null().to_numpy(zero_copy_only=False)
    n, lists = column("n").to_numpy(zero_copy_only=False), column("terms")
    per = np.diff(lists.offsets.to_numpy())
    terms, tf = lists.flatten().to_numpy(zero_copy_only=False), column("tf").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(n)), per)
    at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
    own = known[at] == terms
    at, row, tf = at[own], row[own], tf[own]
    m = 50 + 50 * n * documents // max(length, 1)
    impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[row])
    order = np.lexsort((-impact, at))
    at, row, impact = at[order], row[order], impact[order]
    bounds = np.searchsorted(at, np.arange(len(known) + 1))
    for q in queries:
        mine = []
        for t, w in zip(np.searchsorted(known, q.terms), q.weights):
            a, b = bounds[t], bounds[t + 1]
            b = a + int(np.searchsorted(-impact[a:b], 0))  # an impact rounded down to 0 adds nothing
            if a < b:
                mine.append((row[a:b], w * impact[a:b]))
        if mine:
            found, score = nra(mine, len(n), k, q.floor(k))
            q.add(score, missing[found], ids[found], k)


def _search(docs: DataFrame, block: pa.Table, documents: int, length: int, k: int) -> DataFrame:
    """key, doc_id, score: each task's k best of each query of block (key, terms, weights)."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = zip(*(sent.value[c].to_pylist() for c in ("key", "terms", "weights")))
        queries = [Query(key, np.array(t, np.int64), np.array(w, np.int64)) for key, t, w in rows]
        known = np.unique(np.concatenate([q.terms for q in queries]))
        held, terms, size = [], 0, 0
        for batch in batches:
            lo, count = 0, np.diff(batch.column("terms").offsets.to_numpy())
            while lo < len(count):
                room = max(1, int(np.searchsorted(np.cumsum(count[lo:]), CHUNK_TERMS - terms, side="right")))
                hi = min(len(count), lo + min(room, CHUNK_DOCS - size))
                held.append(batch.slice(lo, hi - lo))
                terms, size, lo = terms + int(count[lo:hi].sum()), size + hi - lo, hi
                if size >= CHUNK_DOCS or terms >= CHUNK_TERMS or lo < len(count):
                    _search_chunk(pa.Table.from_batches(held), queries, known, documents, length, k)
                    held, terms, size = [], 0, 0
        if held:
            _search_chunk(pa.Table.from_batches(held), queries, known, documents, length, k)
        for q in queries:
            score, missing, ids = q.best
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), q.key, np.int64)), pa.array(ids, mask=missing), pa.array(score)], ["key", "doc_id", "score"])

    return docs.mapInArrow(run, "key long, doc_id long, score long")


def query_blocks(weighted: DataFrame, block_terms: int = BLOCK_TERMS) -> Iterator[pa.Table]:
    """The queries (key, terms, weights), dealt to as many blocks as keep each at about block_terms terms."""
    total = weighted.agg(F.sum(F.size("terms"))).first()[0] or 0
    count = -(-total // block_terms)
    for b in range(count):
        block = weighted.where(F.pmod(F.xxhash64("key"), F.lit(count)) == b).toArrow()
        if len(block):
            yield block


def search(
    docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text_col: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """query_col, rank (from 1), doc_id, score: for each query the k documents with the highest scores above 0.

    Terms are runs of letters, digits and code points beyond ASCII; only A-Z are lower-cased. A term's weight is
    floor(1000 ln((2 N + 2) / (2 df + 1))) with N documents that have terms and df that have this one; it counts once for a
    query. A document with n terms in all, of length m = 50 + 50 n N div L (L: terms of all documents), scores
    w (10^9 tf div (1000 tf + 20 m)) for each.

    Null and empty texts have no terms: such documents are not found, such queries find nothing. Equal scores are in order of
    the id, a null id last. Every row is a document, and a query, of its own: rows that repeat take several ranks, and a
    query's rows come back once for each of its rows. Empty tables give no rows. Texts of any length are read whole.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    asked = ws.table(queries.select(F.monotonically_increasing_id().alias("key"), F.col(query_col).alias("name"), F.col(query_text_col).alias("text")), "queries")
    wanted = ws.table(term_table(asked, "key", "text").select(F.col("id").alias("key"), F.explode("terms").alias("term")), "query-terms")
    bits = spark.sparkContext.broadcast(bitmap_of(wanted, "term", BITMAP_BITS))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = ws.table(term_table(own, "doc_id", "text", bits).where("n > 0"), "documents")
    documents, length = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    terms = wanted.join(df, "term").withColumn("weight", weight.cast("long")).where("weight > 0")
    weighted = terms.groupBy("key").agg(F.collect_list(F.struct("term", "weight")).alias("x")).select("key", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights"))
    found = [_search(table, block, documents, length, k) for block in query_blocks(ws.table(weighted, "weighted"), block_terms)]
    found = reduce(DataFrame.union, found) if found else spark.createDataFrame([], "key long, doc_id long, score long")
    # two steps, as each of any number of tasks returns k rows of a query
    best = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*best))
    near = found.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(GROUPS))).withColumn("rank", rank("key", "group")).where(F.col("rank") <= k)
    ranked = near.withColumn("rank", rank("key")).where(F.col("rank") <= k)
    return ranked.join(asked.select("key", "name"), "key").select(F.col("name").alias(query_col), "rank", "doc_id", "score")


SEARCH_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), n AS (
  SELECT r, doc_id, ts, len(ts) AS n FROM d WHERE len(ts) > 0
), g AS (
  SELECT count(*) AS nd, sum(n) AS l FROM n
), tf AS (
  SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS t FROM n) GROUP BY ALL
), df AS (
  SELECT t, count(*) AS df FROM tf GROUP BY t
), q AS (
  SELECT i, item_id, unnest(list_distinct(ts)) AS t FROM (
    SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark)
), w AS (
  SELECT i, item_id, t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM q JOIN df USING (t), g
), s AS (
  SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l))))::BIGINT AS score
  FROM w JOIN tf USING (t), g GROUP BY ALL
), k AS (
  SELECT i, item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r) AS rank FROM s WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 50
"""
