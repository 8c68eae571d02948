"""Removal of repeated byte strings by sampled anchors and block refinement.

A byte goes if a string of ``length`` (200) bytes that covers it also starts anywhere else. Doubling the ranks of all positions
sorts several times the text's size in every round, so positions are sampled first, without loss: a window of 200 bytes is
stood for by its anchor, the leftmost least hash of the 32-byte grams in it. Equal windows have equal anchors at equal
places, and neighbouring windows share one, so a text has about 2 anchors for each 170 bytes.

Each round then works on blocks of windows that share an anchor, as (rank, extension) pairs: the block's core, the bytes that
all its windows have, and its union, the bytes that any of them has. Pairs are grouped by Spark and

- a block whose core is unique in the corpus has no repeated window and leaves (unique);
- blocks with equal unions have equal windows: all are repeated and leave (past the threshold), but one stands in for their
  content as long as other blocks with that core are open;
- the rest are cut into smaller blocks on a fixed grid of places relative to the anchor, so their cores grow, from the 32
  bytes of the anchor in the first round to a whole window of 200 in the last.

So each round compares longer strings of fewer positions. Ranks are hashes (64 bits of the core beside 128 of the union).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gainsieve.llm.common import STEP_BYTES, SpanHash, blocks, text_key
from gainsieve.sources.workspace import Workspace

LENGTH, GRAM = 200, 32
#: Windows in a block, round by round after the first.
GRIDS = (28, 4, 1)
#: Anchors in one row of intermediate tables, so that a long text takes several rows.
PART = 256
#: log2 of the bits that say which anchors may be repeated.
BITMAP_BITS = 27
_PLACE_BITS = 22

ITEM = "core long, u1 long, u2 long, k1 long, k2 long, idx int, p int, lo int, hi int, n long"


def anchors(data: np.ndarray, off: np.ndarray, hashes: SpanHash, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, place, first and last window, hash) of each anchor of the texts, places relative to the text's start."""
    n = len(data)
    reach = length - gram + 1
    for a in range(0, n, STEP_BYTES):
        piece = data[a : min(n, a + STEP_BYTES + length - 1)]
        if len(piece) < length:
            return
        sums = hashes.running(piece)
        at = np.arange(len(piece) - gram + 1)
        g = hashes.spans(sums, at, at + gram)
        least = (g & ~np.uint64((1 << _PLACE_BITS) - 1)) | at.astype(np.uint64)  # the leftmost of equal ones
        span = 1
        while span < reach:
            step = min(span, reach - span)
            least = np.minimum(least[: len(least) - step], least[step:])
            span += step
        least = least[:STEP_BYTES]  # later windows are the next piece's
        starts = np.arange(a, a + len(least))
        text = np.searchsorted(off, starts, side="right") - 1
        whole = np.flatnonzero(starts + length <= off[text + 1])
        if not len(whole):
            continue
        p, text, starts = (least[whole] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64), text[whole], starts[whole]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (np.diff(starts) != 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(p)) - 1
        base = off[text[first]]
        yield text[first], p[first] + a - base, starts[first] - base, starts[last] - base, g[p[first]]


def anchor_hashes(texts: DataFrame) -> DataFrame:
    """h: the hash of every anchor of a table (k1, k2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = SpanHash(6)
        for batch in batches:
            for _, _, data, off in blocks(batch.column(0)):
                for *_, h in anchors(data, off, hashes):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return texts.select("text").mapInArrow(run, "h long")


def _bitmap(hashes: DataFrame, ws: Workspace) -> np.ndarray:
    """Bytes whose bit i says whether a hash is i modulo the number of bits; the size is fixed."""
    at = (F.pmod("h", F.lit(1 << BITMAP_BITS)) + 1).alias("at")
    parts = hashes.select(at).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    parts = ws.step(parts, "bitmap")
    out = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for row in parts.toLocalIterator():
        bits = np.frombuffer(row["bits"], np.uint8)
        out[(row["bucket"] - 1) * 4096 :][: len(bits)] = bits
    ws.drop(parts)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _union(data: bytes, first: int, last: int) -> tuple[int, int]:
    whole = xxhash.xxh3_128_intdigest(data, first << 16 | last)
    return _signed(whole >> 64), _signed(whole & (1 << 64) - 1)


def _contexts(texts: DataFrame, maybe) -> DataFrame:
    """k1, k2, part and lists idx, p, lo, hi, core, u1, u2, bytes: the anchors that may be repeated, some of a text's in each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = SpanHash(6), maybe.value
        for batch in batches:
            k1, k2 = batch.column(0), batch.column(1)
            for row, _, data, off in blocks(batch.column(2)):
                raw, seen = data.tobytes(), {}
                rows: list[dict] = []
                for text, p, lo, hi, h in anchors(data, off, hashes):
                    low = h & np.uint64((1 << BITMAP_BITS) - 1)
                    own = np.flatnonzero(bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8) & 1)
                    if not len(own):
                        continue
                    cuts = np.flatnonzero(np.diff(text[own])) + 1
                    for group in np.split(own, cuts):
                        t = int(text[group[0]])
                        start = int(off[t])
                        for at in range(0, len(group), PART):
                            some = group[at : at + PART]
                            part = seen[t] = seen.get(t, -1) + 1
                            contexts = [raw[start + a : start + b + LENGTH] for a, b in zip(lo[some].tolist(), hi[some].tolist())]
                            unions = [_union(c, a, b) for c, a, b in zip(contexts, (p - hi)[some].tolist(), (p - lo)[some].tolist())]
                            rows.append(
                                {
                                    "k1": k1[row + t].as_py(), "k2": k2[row + t].as_py(), "part": part,
                                    "idx": np.arange(part * PART, part * PART + len(some)).tolist(), "p": p[some].tolist(), "lo": lo[some].tolist(), "hi": hi[some].tolist(),
                                    "core": h[some].view(np.int64).tolist(), "u1": [u[0] for u in unions], "u2": [u[1] for u in unions], "bytes": contexts,
                                }
                            )
                            if len(rows) >= 64:
                                yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                                rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    return texts.select("k1", "k2", "text").mapInArrow(
        run, "k1 long, k2 long, part int, idx array<int>, p array<int>, lo array<int>, hi array<int>, core array<long>, u1 array<long>, u2 array<long>, bytes array<binary>"
    )


SCHEMA = pa.schema(
    [("k1", pa.int64()), ("k2", pa.int64()), ("part", pa.int32())]
    + [(c, pa.list_(pa.int32())) for c in ("idx", "p", "lo", "hi")]
    + [(c, pa.list_(pa.int64())) for c in ("core", "u1", "u2")]
    + [("bytes", pa.list_(pa.binary()))]
)


def cut(p: int, lo: int, hi: int, base: int, context: bytes, grid: int, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, int, int]]:
    """core, u1, u2 and the windows lo .. hi of each block on the grid; context has the bytes from base on."""
    most = length - gram
    for j in range((p - hi) // grid, (p - lo) // grid + 1):
        near, far = j * grid, min((j + 1) * grid - 1, most)  # places of the anchor in the full block's windows
        a, b = max(near, p - hi), min(far, p - lo)
        core = xxhash.xxh3_64_intdigest(context[p - near - base : p - far + length - base], j << 10 | grid)
        yield _signed(core), *_union(context[p - b - base : p - a + length - base], a, b), p - b, p - a


def _cut_blocks(contexts: DataFrame, grid: int) -> DataFrame:
    """Items of the blocks on the grid, from k1, k2, idx, p, base, n, bytes and the list open of (lo, hi)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ITEM.split(", ")]
        kinds = [pa.int32() if c.endswith(" int") else pa.int64() for c in ITEM.split(", ")]
        for batch in batches:
            rows: list[tuple] = []

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

            for k1, k2, idx, p, base, n, context, todo in zip(*(c.to_pylist() for c in batch.columns)):
                for block in todo:
                    for core, u1, u2, lo, hi in cut(p, block["lo"], block["hi"], base, context, grid):
                        rows.append((core, u1, u2, k1, k2, idx, p, lo, hi, n))
                if len(rows) > 50_000:
                    yield out()
                    rows.clear()
            if rows:
                yield out()

    return contexts.select("k1", "k2", "idx", "p", "base", "n", "bytes", "open").mapInArrow(run, ITEM)


def _round(items: DataFrame, ws: Workspace, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Windows known to be repeated (k1, k2, lo, hi), and the blocks to be cut further (k1, k2, idx, lo, hi)."""
    me = F.struct("k1", "k2", "idx", "lo")
    unions = items.groupBy("core", "u1", "u2").agg(F.sum("n").alias("many"), F.min(me).alias("first"))
    cores = unions.groupBy("core").agg(F.sum("many").alias("total"), F.count("*").alias("unions")).where("total > 1")
    status = unions.join(cores, "core").select("core", "u1", "u2", (F.col("many") > 1).alias("repeated"), F.col("unions").alias("classes"), "first")
    known = ws.step(items.join(status, ["core", "u1", "u2"]).withColumn("stands_in", me == F.col("first")).select("k1", "k2", "idx", "lo", "hi", "repeated", "classes", "stands_in"), "round", items)
    repeated = known.where("repeated").select("k1", "k2", "lo", "hi")
    if last:
        return repeated, None
    return repeated, known.where("classes > 1 AND (NOT repeated OR stands_in)").select("k1", "k2", "idx", "lo", "hi")


def repeated_windows(texts: DataFrame, ws: Workspace) -> DataFrame:
    """k1, k2, lo, hi: ranges of window starts that are repeated, of every distinct text of a table (k1, k2, text).

    Windows of texts that are there more than once are all repeated; such a text takes part once, with its number of copies.
    """
    hashes = anchor_hashes(texts).groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    maybe = texts.sparkSession.sparkContext.broadcast(_bitmap(hashes, ws))
    lists = ["idx", "p", "lo", "hi", "core", "u1", "u2", "bytes"]
    found = _contexts(texts, maybe).groupBy("k1", "k2", "part").agg(F.first(F.struct(*lists)).alias("a"), F.count("*").alias("n"))
    stored = ws.step(found.select("k1", "k2", "n", "a.*"), "contexts")
    thin = lists[:-1]
    items = stored.select("k1", "k2", "n", F.inline(F.arrays_zip(*thin))).select(*[c.split()[0] for c in ITEM.split(", ")])
    repeated, todo = _round(items, ws, False)
    out = [repeated]
    every = stored.select("k1", "k2", "n", F.inline(F.arrays_zip("idx", "p", F.col("lo").alias("base"), "bytes")))
    contexts = ws.step(every.join(todo, ["k1", "k2", "idx"]).withColumn("open", F.array(F.struct("lo", "hi"))).drop("lo", "hi"), "open", stored)
    for k, grid in enumerate(GRIDS):
        if k:
            blocks_left = todo.groupBy("k1", "k2", "idx").agg(F.collect_list(F.struct("lo", "hi")).alias("open"))
            contexts = contexts.drop("open").join(blocks_left, ["k1", "k2", "idx"])
        repeated, todo = _round(ws.step(_cut_blocks(contexts, grid), "items"), ws, grid == 1)
        out.append(repeated)
    for more in out[1:]:
        out[0] = out[0].union(more)
    return out[0].distinct()


def covered(n_bytes: int, windows: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes under the windows lo .. hi of a text."""
    runs: list[list[int]] = []
    for lo, hi in sorted(windows):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi + length)
        else:
            runs.append([lo, hi + length])
    return [(a, min(b, n_bytes)) for a, b in runs]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, kept (binary: the remaining bytes), n_bytes, n_removed, n_spans (maximal removed runs).

    Texts are UTF-8 bytes; null and empty texts, and those under 200 bytes, lose nothing. Strings are judged on the input:
    all occurrences go, the first one too. Rows with equal texts (repeated rows among them) are copies of each other, so
    from 200 bytes on nothing of them is left. Ids play no part but to name the rows; other columns are ignored.
    """
    ws = Workspace(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("doc_id", *text_key(F.col("text")), "text")
    keyed = keyed.withColumnsRenamed({"_k1": "k1", "_k2": "k2"})
    long = keyed.where(F.octet_length("text") >= LENGTH)
    windows = repeated_windows(long.select("k1", "k2", "text"), ws)
    # a text with copies has the one range of all its windows instead
    copies = long.groupBy("k1", "k2", F.octet_length("text").alias("size")).agg(F.count("*").alias("n")).where("n > 1")
    all_of = copies.select("k1", "k2", F.array(F.struct(F.lit(0).alias("lo"), (F.col("size") - LENGTH).alias("hi"))).alias("all"))
    some = windows.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("some"))
    ranges = ws.step(some.join(all_of, ["k1", "k2"], "full").select("k1", "k2", F.coalesce("all", "some").alias("windows")), "ranges")
    ws.keep(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in blocks(batch.column(1)):
                raw, rows = data.tobytes(), []
                for a, b, own in zip(off[:-1].tolist(), off[1:].tolist(), batch.column(2).slice(lo, hi - lo).to_pylist()):
                    runs = covered(b - a, [(w["lo"], w["hi"]) for w in own or []])
                    kept, at = [], a
                    for x, y in runs:
                        kept.append(raw[at : a + x])
                        at = a + y
                    rows.append((b"".join([*kept, raw[at:b]]), b - a, sum(y - x for x, y in runs), len(runs)))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    joined = keyed.join(ranges, ["k1", "k2"], "left").select("doc_id", "text", "windows")
    return joined.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    out = remove_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


