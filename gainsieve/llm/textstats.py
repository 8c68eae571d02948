"""Numeric features of whole texts, computed for many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gainsieve.llm.common import SpanHash, blocks, word_bounds

FEATURES = [
    "log_chars", "log_words", "mean_word", "std_word", "long_words", "short_words", "upper", "digits", "non_ascii", "stops", "commas",
    "marks", "brackets", "other_signs", "sign_ended", "capital_words", "log_line", "distinct_words", "distinct_lines", "top_word",
]

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_CLASSES = {
    "upper": _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digits": _table("0123456789"),
    "stops": _table(".?;:"),
    "commas": _table(","),
    "marks": _table("!*#%&$~^|"),
    "brackets": _table("()[]{}<>"),
    "other_signs": _table("+-=/\\_@'\"`"),
}
#: The one class of each byte: those above, then first bytes of letters beyond ASCII, then all else; the last are bytes within a letter.
_CLASS_OF = np.full(256, len(_CLASSES) + 1, np.int64)
for _i, _mask in enumerate(_CLASSES.values()):
    _CLASS_OF[_mask] = _i
_CLASS_OF[0xC0:] = len(_CLASSES)
_CLASS_OF[0x80:0xC0] = len(_CLASSES) + 2
_SIGN = _table("!*#%&$~^|+-=/\\_@`")


def _per_text(sums: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.float64)


def _distinct(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct hashes in each text, and how often the commonest is there."""
    text = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    keys = np.sort(text << np.uint64(44) | hashes >> np.uint64(20))  # texts of a block are few: 44 bits are left for the hash
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    t = (keys[at] >> np.uint64(44)).astype(np.int64)
    different = np.bincount(t, minlength=len(counts))
    top = np.zeros(len(counts))
    if len(at):
        some = np.flatnonzero(different)
        top[some] = np.maximum.reduceat(np.diff(np.append(at, len(keys))), (np.cumsum(different) - different)[some])
    return different.astype(np.float64), top


def features_of(data: np.ndarray, off: np.ndarray, hashes: SpanHash) -> np.ndarray:
    """A row of FEATURES for each text; all are finite, and an empty text has zeros."""
    n = len(off) - 1
    cum = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    size = len(_CLASSES) + 3
    classes = np.bincount(_CLASS_OF[data] + np.repeat(np.arange(n) * size, np.diff(off)), minlength=n * size).reshape(n, size).astype(np.float64)
    chars = classes[:, :-1].sum(1)
    least = np.maximum(chars, 1)
    starts, ends, words = word_bounds(~_SPACE[data], off)
    lines_s, lines_e, lines = word_bounds(data != 10, off)
    many, many_lines = np.maximum(words, 1), np.maximum(lines, 1)
    at, at_lines = np.concatenate([[0], np.cumsum(words)]), np.concatenate([[0], np.cumsum(lines)])
    letters = cum((data & 0xC0) != 0x80)
    length = letters[ends] - letters[starts]
    sums = hashes.running(data)
    part = lambda x: _per_text(cum(x), at) / many
    mean = _per_text(cum(length), at) / many
    out = {"log_chars": np.log1p(chars), "log_words": np.log1p(words), "mean_word": mean, "std_word": np.sqrt(np.maximum(part(length * length) - mean * mean, 0))}
    out |= {"long_words": part(length > 12), "short_words": part(length <= 3), "non_ascii": classes[:, len(_CLASSES)] / least}
    out |= {k: classes[:, i] / least for i, k in enumerate(_CLASSES)}
    last = data[ends - 1] if len(ends) else data[:0]
    first = data[starts] if len(starts) else data[:0]
    out |= {"sign_ended": part(_SIGN[last]), "capital_words": part(_CLASSES["upper"][first]), "log_line": np.log1p(chars / many_lines)}
    different, top = _distinct(hashes.spans(sums, starts, ends), words)
    out |= {"distinct_words": different / many, "top_word": top / many}
    out["distinct_lines"] = _distinct(hashes.spans(sums, lines_s, lines_e), lines)[0] / many_lines
    return np.column_stack([out[k] for k in FEATURES]).astype(np.float32) if n else np.zeros((0, len(FEATURES)), np.float32)


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the list x of FEATURES, one row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = SpanHash(9)
        for batch in batches:
            for lo, hi, data, off in blocks(batch.column(1)):
                x = features_of(data, off, hashes)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), flat], ["doc_id", "x"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, x array<float>")
