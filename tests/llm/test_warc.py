"""Archives written and read back, against a plain reader and a plain grouping."""

import glob
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestry.llm import common
from harvestry.llm import warc as W

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                       *[T.StructField(c, T.StringType()) for c in ("record", "id", "n", "digest", "rows", "file", "row", "payload", "nth", "chunk", "last")]])


def pages(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 11) for r in rows], SCHEMA)


COPY = "<p>" + "é copy \r\n\r\nWARC/1.1\r\n" * 20
LONG = "".join(f"<i>{i}</i>\r\n" for i in range(60_000))
ROWS = [(5, "http://a/1", COPY), (3, "http://a/\r\nWARC-Type: evil", COPY), (9, None, COPY), (None, "u", COPY), (5, "again", COPY),
        (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", LONG), (8, "u", LONG), (None, None, None), (10, "u", "x" * 100), (11, "u", "x" * 99)]


def expected():
    """(id, bytes, digest, type, refers to) by the contract; of equal payloads the smallest id, nulls last, is the response."""
    out = []
    for i, (page_id, _, html) in enumerate(ROWS):
        raw = (html or "").encode()
        same = sorted((r[0] is None, r[0] or 0, k) for k, r in enumerate(ROWS) if (r[2] or "").encode() == raw)
        first = same[0][2]
        revisit = len(raw) >= 100 and first != i
        out.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", ROWS[first][0] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("settings", [{}, {"chunk_bytes": 1000, "archive_bytes": 2000}])
def test_round_trip_equals_plain_grouping(spark, settings):
    got = [tuple(r) for r in W.round_trip(pages(spark, ROWS).coalesce(1), **settings).collect()]
    assert sorted(got, key=str) == expected()


def test_groups_that_are_not_hot_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_GROUPS", 2)
    assert sorted((tuple(r) for r in W.round_trip(pages(spark, ROWS).coalesce(1)).collect()), key=str) == expected()


def test_chunks_carry_running_digests(spark):
    archives = W.write_warc(pages(spark, ROWS), chunk_bytes=1 << 16, archive_bytes=1)
    assert archives.agg(F.sum("records")).first()[0] == len(ROWS) and archives.count() > 3
    rows = W.read_chunks(archives, chunk_bytes=4096).filter("row_id = '7'").orderBy("chunk_number").collect()
    assert [r.chunk_number for r in rows] == list(range(len(rows))) and all(len(r.chunk) <= 4096 for r in rows) and len(rows) > 100
    sofar = b""
    for r in rows:
        sofar += bytes(r.chunk)
        assert (r.payload_bytes, r.payload_digest) == (len(sofar), hashlib.sha256(sofar).hexdigest())
        assert r.last_chunk == (len(sofar) == len(LONG.encode()))
    assert sofar == LONG.encode() and W.read_chunks(archives, payload=False).filter("chunk is not null").count() == 0


def test_files_follow_the_standard(spark, tmp_path):
    """A reader that knows only the standard finds every record, and each is a gzip member of its own."""
    folder = f"{tmp_path}/w"
    W.write_warc(pages(spark, ROWS).coalesce(1), folder=f"file://{folder}")
    paths = glob.glob(folder + "/*.warc.gz")
    data, found = b"".join(gzip.open(p).read() for p in paths), []
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        assert lines[0] == "WARC/1.1" and data[n:n + 4] == b"\r\n\r\n"
        found.append((fields, data[:n]))
        data = data[n + 4:]
    assert len(found) == len(ROWS) == len({f["WARC-Record-ID"] for f, _ in found}) 
    assert sum(open(p, "rb").read().count(b"\x1f\x8b\x08\x00\x00\x00\x00\x00") for p in paths) == len(ROWS)
    ids = {f["WARC-Record-ID"] for f, _ in found if f["WARC-Type"] == "response"}
    for f, block in found:
        http, _, payload = block.partition(b"\r\n\r\n")
        if f["WARC-Type"] == "response":
            assert f["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
        else:
            assert f["WARC-Refers-To"] in ids and f["WARC-Profile"] == W.PROFILE and payload == b""


def test_plain_archives_and_damage():
    head = W.record_head("0" * 32, "1", "u", 5, hashlib.sha256(b"hello").hexdigest(), None, None, W.DATE)
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = list(W.chunk_rows(io.BytesIO(info + head + b"hello\r\n\r\n"), 2))
    assert [(r[6], r[7], r[8], r[10]) for r in rows] == [(0, b"he", 2, False), (1, b"ll", 4, False), (2, b"o", 5, True)]
    for broken in (head + b"hellx\r\n\r\n", head + b"hel", head + b"hello!\r\n\r\n", b"junk\r\n\r\n", gzip.compress(head + b"hello\r\n\r\n")[:-20], head[:30]):
        with pytest.raises(ValueError):
            list(W.chunk_rows(io.BytesIO(broken), 1024))


def test_empty_table(spark):
    got = W.round_trip(pages(spark, []))
    assert got.count() == 0 and got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
