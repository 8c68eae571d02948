import base64
import gzip
import hashlib

import pytest

from gainsieve.llm import warc
from gainsieve.llm.files import resolve
from gainsieve.sources.workspace import Workspace

SCHEMA = "page_id long, url string, html string, payload string"
ROWS = [
    (5, "http://a.example/x\r\nWARC-Type: bad", "same é text"),
    (3, "http://b.example/", "same é text"),
    (9, None, "same é text"),
    (9, "http://repeat.example/", "same é text"),
    (1, "http://c.example/", None),
    (2, "http://d.example/", ""),
    (7, "http://e.example/", "WARC/1.1\r\n\r\nnot a record\r\n\r\n"),
    (8, "http://f.example/", "long " * 400_000),
    (None, "http://g.example/", "only here"),
    (None, "http://h.example/", "same é text"),
]


def brute(rows, min_bytes):
    out = []
    for page, _, text in rows:
        raw = (text or "").encode()
        same = [p for p, _, t in rows if (t or "") == (text or "") and p is not None]
        revisit = bool(same) and page != min(same) and len(raw) >= min_bytes
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", min(same) if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, min_bytes):
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], SCHEMA).repartition(3)
    assert sorted((tuple(r) for r in warc.round_trip(pages, min_bytes).collect()), key=str) == brute(ROWS, min_bytes)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_members_stand_alone_and_the_index_finds_them(spark):
    ws = Workspace(spark)
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], SCHEMA).coalesce(1)
    streams = warc.write_streams(warc.mark_revisits(pages).coalesce(1), ws)
    (stream,) = [r["path"] for r in streams.collect()]
    (archive,) = warc.normalise(streams, ws).collect()
    system, path = resolve(stream)
    whole = system.open_input_stream(path, compression=None).read()
    system, path = resolve(archive["path"])
    data = system.open_input_stream(path, compression=None).read()
    assert archive["n_records"] == len(ROWS) and archive["n_bytes"] == len(data)
    assert gzip.decompress(whole) == gzip.decompress(data)
    entries = list(warc.index_lines(archive["path"]))
    assert sum(e["length"] for e in entries) == len(data)
    for e in entries:
        assert gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]).startswith(b"WARC/1.1\r\nWARC-Type: " + e["type"].encode())
    assert warc.read_record(system.open_input_file(path), entries[4]["offset"], entries[4]["length"]).headers["WARC-Record-ID"] == entries[4]["id"]


def test_damage_is_an_error():
    record = warc.page_record(1, "u", b"payload", warc.digest_of(b"payload"), True, None)
    data = record.dump()
    assert [r.block for r in warc.records(iter([data[:9], data[9:], data]))] == [record.block] * 2
    with pytest.raises(ValueError, match="cut short"):
        list(warc.records(iter([data[:-9]])))
    with pytest.raises(ValueError, match="not a WARC"):
        list(warc.records(iter([b"junk\r\n\r\n"])))
    with pytest.raises(ValueError, match="digest"):
        warc.payload_of(warc.page_record(1, "u", b"payload", warc.digest_of(b"other"), True, None))
