"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds; a longer text is a step of its own.
STEP_BYTES = 1 << 17
MASK64 = (1 << 64) - 1


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: equal texts, and no others, are taken to share them."""
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(0x5EED), text, F.length(text)).alias("_k2")]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of an unsigned 64-bit word over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(seed: int) -> np.ndarray:
    """A pseudo-random unsigned 64-bit value for each byte."""
    return mix64((np.arange(256, dtype=np.uint64) + np.uint64(seed * 256 + 1)) * np.uint64(0x9E3779B97F4A7C15))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, base
    while done < n:
        m = min(done, n - done)
        out[done : done + m] = out[:m] * np.uint64(step)
        done, step = done + m, step * step & MASK64
    return out[:n]


class SpanHash:
    """Hashes of any spans of a byte block, from one running sum of byte value times a power of the position."""

    BASE = 0xD6E8FEB86659FD93
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, seed: int):
        self.values = byte_values(seed)
        self.up = self.down = np.ones(0, np.uint64)

    def running(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.up) < n:
            self.up, self.down = powers(self.BASE, n), powers(self.INVERSE, n)
        sums = np.zeros(n, np.uint64)
        np.cumsum(self.values[data] * self.up[: n - 1], out=sums[1:])
        return sums

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((sums[ends] - sums[starts]) * self.down[starts])


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive word hashes; as long as words less n - 1."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = words[:m].copy()
    for j in range(1, n):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += words[j : j + m]
    return mix64(out)


def blocks(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a string column with their UTF-8 bytes: (first row, row after the last, bytes, offsets); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, whole[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_bounds(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of True that do not cross a text's bounds, and the number of runs in each text."""
    n = len(is_word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[at] = is_word[at]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    last[at[1:] - 1] = is_word[at[1:] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.diff(np.searchsorted(starts, offsets))


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the number of them in each row."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def bitmap_of(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bytes whose bit i says whether a value of the long column is i modulo 2 ** bits (15 or more); its size does not depend on the rows."""
    at = (F.pmod(column, F.lit(1 << bits)) + 1).alias("at")
    parts = rows.select(at).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in parts.toLocalIterator():
        part = np.frombuffer(row["bits"], np.uint8)
        out[(row["bucket"] - 1) * 4096 :][: len(part)] = part
    return out


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which unsigned values bitmap_of may have seen: all that it has, and few others while it is mostly empty."""
    low = values & np.uint64(len(bits) * 8 - 1)
    return (bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
