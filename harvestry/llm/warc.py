"""WARC archives written and read as a chunked record table.

Writing. A first pass over slim rows (digest, length, locator) finds payloads that
occur more than once; the row with the smallest id among them is a response, the
others revisit it and carry no payload. Payloads become rows (record, chunk
number, at most ``CHUNK_BYTES``), which tasks stream into gzip members, one per
record. A file is closed at about ``ARCHIVE_BYTES``, so that readers have many of
bounded size. Files get names of their own per attempt, and only those that the
returned table names (written by Spark, so by successful attempts alone) are
archives; a lost executor costs a rewrite and leaves a file that nobody reads.

Reading. One task per file inflates and parses it in steps and emits the chunked
record table: a row per (record, chunk number) with the chunk, and the length and
SHA-256 of the payload as far as the chunk reaches. The digest is carried along,
so no step holds more than a chunk of a record; the last chunk's row has the
whole payload's digest, and must agree with the record's header.

Null payloads count as empty. Rows that repeat an id, or have none, get a record
each; among equal payloads a null id comes last and equal ids go by locator (file,
row). A null url gives no target header; control characters in one are
percent-encoded. An empty table gives no archives and no records. Other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.llm.common import join_hot, store
from harvestry.llm.exact_dedup import located
from harvestry.session import shared_path

CHUNK_BYTES = 1 << 22
ARCHIVE_BYTES = 1 << 27
#: Compressed bytes read, and bytes inflated, in one step.
READ_BYTES, STEP_BYTES = 1 << 16, 1 << 20
#: Payloads below this are always stored themselves.
MIN_REVISIT = 100
DATE = "2026-01-01T00:00:00Z"
#: Fixed value: the profile that the WARC 1.1 standard names for equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a folder or file named the way Spark names them."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/(?!//)", "file:///", uri))


def _record_id(file: Column, row: Column) -> Column:
    return F.md5(F.concat_ws("#", file, row.cast("string")))


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_revisit: int, chunk_bytes: int) -> DataFrame:
    """Chunk rows (record, id, url, n, digest, refers, refers_id, nth, last, chunk); a revisit has one, without a chunk."""
    pages = located(pages)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), file.alias("file"), row.alias("row"))
    base = base.withColumns({"n": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    slim = store(base.drop("payload"), "warc-slim")
    first = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("file").alias("file"), F.col("row").alias("row"))
    groups = store(slim.filter(F.col("n") >= min_revisit).groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.min(first).alias("first"))
                   .filter("rows > 1"), "warc-groups")
    nothing = F.lit(None).cast("string")
    revisits = store(join_hot(slim, groups, ["digest"], "rows").filter("file != first.file or row != first.row").select(
        "file", "row", "id", "url", "n", "digest", _record_id(F.col("first.file"), F.col("first.row")).alias("refers"),
        F.col("first.id").cast("string").alias("refers_id")), "warc-revisits")
    responses = base.join(revisits.select(F.col("file").alias("_f"), F.col("row").alias("_r")), (F.col("file") == F.col("_f")) & (F.col("row") == F.col("_r")), "left_anti")
    last = F.greatest(F.ceil(F.col("n") / chunk_bytes).cast("int") - 1, F.lit(0))
    head = [_record_id(F.col("file"), F.col("row")).alias("record"), F.col("id").cast("string").alias("id"), "url", "n", "digest"]
    chunks = responses.select(*head, "payload", last.alias("end"), F.explode(F.sequence(F.lit(0), last)).alias("nth")).select(
        "record", "id", "url", "n", "digest", nothing.alias("refers"), nothing.alias("refers_id"), "nth", (F.col("nth") == F.col("end")).alias("last"),
        F.substring("payload", F.col("nth") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("chunk"))
    return chunks.unionByName(revisits.select(*head, "refers", "refers_id", F.lit(0).alias("nth"), F.lit(True).alias("last"), F.lit(None).cast("binary").alias("chunk")))


def _urn(record: str) -> str:
    return f"<urn:uuid:{uuid.UUID(record)}>"


def _fields(lines: list[tuple[str, str | None]]) -> bytes:
    clean = lambda v: re.sub("[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", v)
    return "".join(f"{k}: {clean(v)}\r\n" for k, v in lines if v is not None).encode() + b"\r\n"


def record_head(record: str, row_id: str | None, url: str | None, n: int, digest: str, refers: str | None, refers_id: str | None, date: str) -> bytes:
    """The WARC fields and the HTTP fields of a record, all that comes before its payload."""
    http = b"HTTP/1.1 200 OK\r\n" + _fields([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(n))])
    return b"WARC/1.1\r\n" + _fields([
        ("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", _urn(record)), ("WARC-Date", date), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Refers-To", _urn(refers) if refers else None), ("WARC-Profile", PROFILE if refers else None),
        ("Row-ID", row_id), ("Refers-To-Row-ID", refers_id), ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(http) + (n if refers is None else 0)))]) + http


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None,
               min_revisit: int = MIN_REVISIT, chunk_bytes: int = CHUNK_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Write a record per row under ``folder``; returns (path, records, bytes), one row per archive."""
    chunks = plan_records(pages, id_col, url_col, payload_col, min_revisit, chunk_bytes)
    folder = (folder or shared_path(pages.sparkSession, "warc-archives")).rstrip("/")

    def run(batches):
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        out = name = member = None
        records = size = 0

        def put(data: bytes):
            nonlocal size
            out.write(data)
            size += len(data)

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records], pa.int64()), pa.array([size], pa.int64())],
                                              names=["path", "records", "bytes"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("record", "id", "url", "n", "digest", "refers", "refers_id", "nth", "last")]
            for i, (record, row_id, url, n, digest, refers, refers_id, nth, last) in enumerate(zip(*columns)):
                if nth == 0:
                    if out is not None and size >= archive_bytes:
                        yield closed()
                        out = None
                    if out is None:
                        name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    member = zlib.compressobj(wbits=31)
                    put(member.compress(record_head(record, row_id, url, n, digest, refers, refers_id, date)))
                    records += 1
                if refers is None:
                    put(member.compress(batch.column("chunk")[i].as_buffer()))
                if last:
                    put(member.compress(b"\r\n\r\n") + member.flush())
        if out is not None:
            yield closed()

    return store(chunks.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


class Inflated:
    """A plain or gzip stream (of any number of members) from which bytes are taken in bounded steps."""

    def __init__(self, stream):
        self.stream, self.held, self.raw = stream, bytearray(), stream.read(READ_BYTES)
        self.member = zlib.decompressobj(31) if self.raw[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.member is None:
            data, self.raw = self.raw or self.stream.read(READ_BYTES), b""
            self.held += data
            return bool(data)
        while True:
            if self.member.eof:
                self.raw = self.member.unused_data or self.stream.read(READ_BYTES)
                if not self.raw:
                    return False
                self.member = zlib.decompressobj(31)
            data = self.member.decompress(self.raw, STEP_BYTES)
            self.raw = self.member.unconsumed_tail
            if data:
                self.held += data
                return True
            if not self.raw and not self.member.eof:
                self.raw = self.stream.read(READ_BYTES)
                if not self.raw:
                    raise ValueError("the archive ends inside a gzip member")

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before ``mark``, which is skipped; None at the end of the stream."""
        at, seen = self.held.find(mark), 0
        while at < 0:
            seen = max(len(self.held) - len(mark) + 1, 0)
            if not self._more():
                if self.held:
                    raise ValueError("the archive ends inside a record")
                return None
            at = self.held.find(mark, seen)
        found = bytes(self.held[:at])
        del self.held[:at + len(mark)]
        return found

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        found = bytes(self.held[:n])
        del self.held[:n]
        return found


def _parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def chunk_rows(stream, chunk_bytes: int) -> Iterator[tuple]:
    """(record, type, uri, row id, refers to, its row id, chunk number, chunk, bytes so far, digest so far, last) of each chunk."""
    source = Inflated(stream)
    while (head := source.until(b"\r\n\r\n")) is not None:
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins at {head[:40]!r}")
        fields = _parsed(head)
        left, kind = int(fields["content-length"]), fields.get("warc-type")
        named = (fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("row-id"), fields.get("warc-refers-to"), fields.get("refers-to-row-id"))
        told = fields.get("warc-payload-digest", "").removeprefix("sha256:") if fields.get("warc-payload-digest", "").startswith("sha256:") else None
        http = {}
        if fields.get("content-type", "").startswith("application/http") and left:
            block_head = source.until(b"\r\n\r\n")
            http, left = _parsed(block_head), left - len(block_head) - 4
        if kind == "revisit":
            source.take(left)
            yield (*named, 0, None, int(http["content-length"]) if "content-length" in http else None, told, True)
        else:
            digest, done, nth = hashlib.sha256(), 0, 0
            while True:
                chunk = source.take(min(left, chunk_bytes))
                digest.update(chunk)
                done, left = done + len(chunk), left - len(chunk)
                sofar = digest.hexdigest()
                if not left and told not in (None, sofar):
                    raise ValueError(f"the payload of {named[0]} has not the digest in its record")
                if kind in ("response", "resource"):
                    yield (*named, nth, chunk, done, sofar, not left)
                nth += 1
                if not left:
                    break
        if source.take(4) != b"\r\n\r\n":
            raise ValueError(f"the record {named[0]} does not end where its length says")


def read_chunks(archives: DataFrame, payload: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of the files in column ``path``: record, record_type, url, row_id, refers_to, refers_to_row, chunk_number,
    chunk (null if not ``payload``), payload_bytes and payload_digest as far as the chunk reaches, last_chunk."""
    schema = ("record string, record_type string, url string, row_id string, refers_to string, refers_to_row string, chunk_number long, "
              "chunk binary, payload_bytes long, payload_digest string, last_chunk boolean")
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in schema.split(", ")]
    paths = archives.select("path")

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, place = filesystem(path)
                rows, held = [], 0
                with files.open_input_stream(place, compression=None, buffer_size=STEP_BYTES) as stream:
                    for row in chunk_rows(stream, chunk_bytes):
                        rows.append(row if payload else (*row[:7], None, *row[8:]))
                        held += 500 + len(rows[-1][7] or b"")
                        if held >= 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return paths.repartition(max(paths.count(), 1)).mapInArrow(run, schema)  # a file each; a plain shuffle would merge these few bytes into one task


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", **settings) -> DataFrame:
    """Write the archives and read them back: one row per record, from its last chunk: id, payload_bytes, payload_digest, record_type, refers_to."""
    kind = pages.schema[id_col].dataType
    last = read_chunks(write_warc(pages, id_col, url_col, payload_col, **settings), payload=False).filter("last_chunk")
    return last.select(F.col("row_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to_row").cast(kind).alias("refers_to"))
