"""WARC files as a PySpark Python data source, and page archives on top of it.

``WarcDataSource`` (format ``warc``) reads and writes folders of ``.warc.gz``
or plain ``.warc`` files through pyarrow's file systems.

* Planning: the driver lists the files and packs them into partitions of about
  ``splitBytes``; files are rotated at ``FILE_BYTES`` by the writer.
* Pushdown: equality and membership on the record type, record id, target URI,
  payload digest and refers-to columns are taken over; they are decided right
  after a record's headers are parsed.
* Unwanted payloads are not decoded: every record is a gzip member of its own
  whose extra field ``sl`` holds its compressed length (the skip length of the
  early WARC drafts), so a reader inflates the first bytes only and steps over
  the rest; plain files are skipped by ``Content-Length``.  Members without the
  field (other writers) are inflated through.  Option ``payload=false`` leaves
  payloads out altogether.
* Writing: each task writes files of its own under a hidden folder; the commit
  on the driver moves the files of successful attempts, so lost or repeated
  attempts leave nothing behind.

``archive_pages`` writes one record per page, a ``response`` for the largest
page id of each payload and ``revisit`` records without payload for the
others; ``archived_pages`` reads them back.

Results for odd input: null html is the empty payload, which is a payload like
any other; rows that tie on the largest page id are all responses; a null page
id revisits the largest one (if all are null, all are responses) and comes back
as null; null urls have no target URI; a folder without files has no records.
"""

from __future__ import annotations

import io
import re
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition,
                                    WriterCommitMessage)

from medlake.llm.common import landed, row_key
from medlake.session import scratch_path

FILE_BYTES = 64 << 20
SPLIT_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
HEAD_BYTES = 4096
SCHEMA = ("record_type string, record_id string, target_uri string, refers_to string, payload_digest string, "
          "date string, headers map<string,string>, payload binary")
#: Pushed columns and the header each one is read from.
PUSHED = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
          "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "date": "WARC-Date"}
_FIELDS = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
                     ("refers_to", pa.string()), ("payload_digest", pa.string()), ("date", pa.string()),
                     ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (pafs.LocalFileSystem(), path)


# --- records --------------------------------------------------------------

def _clean(value: str) -> str:
    """Header values stay on one line."""
    return re.sub(r"[\r\n]+", " ", value)


def record_bytes(headers: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {_clean(v)}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(raw: bytes) -> bytes:
    """One gzip member whose extra field ``sl`` holds (member, raw) lengths."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0\0\0\0" + b"\0\xff" + struct.pack("<H", 12)
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF)
    return head + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def parse_headers(raw: bytes) -> dict[str, str]:
    """Named fields of a record's head (without the version line)."""
    out: dict[str, str] = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip()] = value.strip()
    return out


def _exactly(stream: Any, n: int) -> bytes:
    got = stream.read(n)
    while len(got) < n:
        more = stream.read(n - len(got))
        if not more:
            raise ValueError("a WARC record is cut off")
        got += more
    return got


def _skip(stream: Any, n: int) -> None:
    """Pass over ``n`` bytes, without reading them where the stream can seek."""
    if n > 0 and stream.seekable():
        stream.seek(stream.tell() + n - 1)
        n = 1
    while n > 0:
        n -= len(_exactly(stream, min(n, HEAD_BYTES)))


def _inflate(stream: Any, first: bytes) -> Iterator[bytes]:
    """Pieces of at most HEAD_BYTES of one member that has no length field; the bytes
    after it are the generator's return value."""
    z, data = zlib.decompressobj(31), first
    while True:
        out = z.decompress(data, HEAD_BYTES)
        if out:
            yield out
        if z.eof:
            return z.unused_data
        data = z.unconsumed_tail
        if not data and len(out) < HEAD_BYTES:
            data = stream.read(1 << 16)
            if not data:
                raise ValueError("a gzip member is cut off")


def _foreign(stream: Any, head: bytes, wanted: Any, payload: bool) -> tuple[dict[str, str] | None, bytes, bytes]:
    """Headers (None where unwanted), block and the bytes behind a member without a
    length field.  Headers are parsed as soon as their end is inflated; what follows
    in an unwanted member is inflated to find its end, and dropped piece by piece."""
    pieces, top, block = _inflate(stream, head), bytearray(), bytearray()
    headers: dict[str, str] | None = None
    keep = known = False
    size = 0

    def decide(raw: bytes) -> None:
        nonlocal headers, keep, known, size
        got = parse_headers(raw)
        known, size = True, int(got.get("Content-Length", 0))
        headers = got if wanted(got) else None
        keep = payload and headers is not None

    while True:
        try:
            piece = next(pieces)
        except StopIteration as end:
            if not known:
                decide(bytes(top))
            return headers, bytes(block[:size]), end.value
        if not known:
            seen = max(0, len(top) - 3)
            top += piece
            cut = top.find(b"\r\n\r\n", seen)
            if cut < 0:
                continue
            decide(bytes(top[:cut]))
            piece = bytes(top[cut + 4:])
            top = bytearray()
        if keep and len(block) < size:
            block += piece


def records(stream: Any, zipped: bool, wanted: Any, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and block of the wanted records of one file, in order."""
    rest = b""
    while True:
        head = rest or stream.read(1)
        if not head:
            return
        if zipped:
            if len(head) < 24:
                head += stream.read(24 - len(head))
            if len(head) >= 24 and head[:3] == b"\x1f\x8b\x08" and head[3] == 4 and head[12:14] == b"sl":
                size = struct.unpack_from("<I", head, 16)[0]
                first = min(size, HEAD_BYTES)
                if len(head) < first:
                    head += _exactly(stream, first - len(head))
                member, rest = head[:size], head[size:]
                z = zlib.decompressobj(-15)
                raw = z.decompress(member[24:], HEAD_BYTES)
                while b"\r\n\r\n" not in raw and not z.eof:
                    more = z.unconsumed_tail
                    if not more and len(member) < size:
                        more = _exactly(stream, min(size - len(member), HEAD_BYTES))
                        member += more
                    now = z.decompress(more, HEAD_BYTES)
                    if not now and not more:
                        break
                    raw += now
                top, _, block = raw.partition(b"\r\n\r\n")
                headers = parse_headers(top)
                if not wanted(headers) or not payload:
                    _skip(stream, size - len(member))
                    if not wanted(headers):
                        continue
                    block = b""
                else:
                    more = z.unconsumed_tail
                    if len(member) < size:
                        more += _exactly(stream, size - len(member))
                    block += z.decompress(more)
                    if not z.eof:
                        raise ValueError("a gzip member is cut off")
                    block = block[:int(headers.get("Content-Length", 0))]
            else:
                got, block, rest = _foreign(stream, head, wanted, payload)
                if got is None:
                    continue
                headers = got
        else:
            while b"\r\n\r\n" not in head:
                more = stream.read(HEAD_BYTES)
                if not more:
                    if head.strip():
                        raise ValueError("a WARC header is cut off")
                    return
                head += more
            top, _, body = head.partition(b"\r\n\r\n")
            headers = parse_headers(top.lstrip(b"\r\n"))
            size = int(headers.get("Content-Length", 0)) + 4
            if wanted(headers) and payload:
                body = body if len(body) >= size else body + _exactly(stream, size - len(body))
                block, rest = body[:size - 4], body[size:]
            else:
                rest, left = body[size:], size - len(body)
                if left > 0:
                    stream.seek(stream.tell() + left)
                if not wanted(headers):
                    continue
                block = b""
        yield headers, block if payload else None


def _payload(headers: dict[str, str], block: bytes | None) -> bytes | None:
    """The payload of a block: what follows the HTTP head, if there is one."""
    if block is not None and headers.get("Content-Type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.payload = options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                values = f.value if isinstance(f, In) else [f.value]
                self.tests.append((PUSHED[f.attribute[0]], frozenset(v for v in values if v is not None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, root = _file_system(self.path)
        found = system.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File
                       and re.search(r"\.warc(\.gz)?$", f.path) and "/." not in f.path[len(root):])
        parts: list[InputPartition] = []
        now: list[str] = []
        size = 0
        for p, n in files:
            if now and size + n > self.split:
                parts.append(_Files(now))
                now, size = [], 0
            now.append(p)
            size += n
        return [*parts, *([_Files(now)] if now or not parts else [])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(self.path)

        def wanted(h: dict[str, str]) -> bool:
            return all(h.get(k) in v for k, v in self.tests)

        rows: list[tuple] = []
        size = 0
        for path in partition.files if isinstance(partition, _Files) else []:
            zipped = path.endswith(".gz")
            opened = system.open_input_file(path)
            with io.BufferedReader(opened, 1 << 20) if zipped else opened as stream:
                for h, block in records(stream, zipped, wanted, self.payload):
                    body = _payload(h, block)
                    rows.append((*(h.get(PUSHED[c]) for c in _FIELDS.names[:6]), list(h.items()), body))
                    size += 512 + len(body or b"")
                    if size >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _FIELDS, strict=True)], schema=_FIELDS)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Writes (record_type, record_id, target_uri, refers_to, payload_digest,
    payload_length, payload); a null payload writes no block."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.zipped = options.get("compression", "gzip") == "gzip"
        self.date = options.get("date") or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        self.work = f".writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = _file_system(self.path)
        system.create_dir(f"{root}/{self.work}", recursive=True)
        name, files, out, size = uuid.uuid4().hex, [], None, 0
        pack = gzip_member if self.zipped else bytes
        try:
            for batch in iterator:
                for r in batch.to_pylist():
                    if out is None or size >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        files.append(f"{name}-{len(files):04d}.warc" + ".gz" * self.zipped)
                        out = system.open_output_stream(f"{root}/{self.work}/{files[-1]}", compression=None, buffer_size=1 << 20)
                        size = out.write(pack(record_bytes({"WARC-Type": "warcinfo", "WARC-Date": self.date,
                                                            "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
                                                            "Content-Type": "application/warc-fields"}, b"format: WARC/1.1\r\n"))) or 0
                    size += out.write(pack(self._record(r))) or 0
        finally:
            if out is not None:
                out.close()
        return _Written(files)

    def _record(self, r: dict[str, Any]) -> bytes:
        body = r.get("payload")
        revisit = r["record_type"] == "revisit"
        headers = {"WARC-Type": r["record_type"], "WARC-Record-ID": r["record_id"], "WARC-Date": self.date,
                   "WARC-Target-URI": r.get("target_uri"), "WARC-Refers-To": r.get("refers_to"),
                   "WARC-Payload-Digest": r.get("payload_digest"),
                   "WARC-Payload-Length": None if r.get("payload_length") is None else str(r["payload_length"]),
                   "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
                   "Content-Type": "application/http; msgtype=response"}
        raw = body.encode() if isinstance(body, str) else bytes(body or b"")
        return record_bytes(headers, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + raw)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _file_system(self.path)
        for m in messages:
            for f in m.files if isinstance(m, _Written) else []:
                system.move(f"{root}/{self.work}/{f}", f"{root}/{f}")
        self._clear(system, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_file_system(self.path))

    def _clear(self, system: pafs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/{self.work}").type == pafs.FileType.Directory:
            system.delete_dir(f"{root}/{self.work}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: Any, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("the warc format appends; choose a new folder to replace an archive")
        return WarcWriter({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known and allow filters to be pushed to it."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# --- page archives --------------------------------------------------------

def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 (160 bits: 8 groups of 20 bits)."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record per page to ``path``.

    Who revisits whom is decided on (id, digest) rows only, first aggregated
    by digest; page bodies are shuffled once, by row and not by digest, so a
    payload that a third of all pages share is no hot key for them."""
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    src = src.withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("rk", row_key("page_id", "html"))
    keys = landed(src.select("rk", "page_id", "digest").distinct(), "page-keys")
    last = keys.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = keys.join(last, "digest").filter(~F.col("page_id").eqNullSafe(F.col("last"))).select("rk", "last")
    rows = src.join(again.withColumn("again", F.lit(True)), "rk", "left")
    revisit = F.coalesce("again", F.lit(False))
    records_ = rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), _urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"), F.when(revisit, _urn(F.col("last"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.octet_length("html").cast("long").alias("payload_length"), F.when(~revisit, F.col("html")).alias("payload"))
    register(pages.sparkSession)
    records_.write.format("warc").mode("append").save(path)


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """The page records of an archive.  Length and digest of a response come
    from the payload that was read, those of a revisit from its headers."""
    register(spark)
    got = spark.read.format("warc").load(path).filter(F.col("record_type").isin("response", "revisit"))
    response = F.col("record_type") == "response"
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'x-page:(-?[0-9]+)>', 1) as long)")
    return got.select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.element_at("headers", "WARC-Payload-Length").cast("long"))
        .cast("long").alias("payload_bytes"),
        F.when(response, base32_sha1(F.col("payload"))).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type", number("refers_to").alias("refers_to"))


def warc_report(pages: DataFrame) -> DataFrame:
    """Write all pages to an archive in the shared folder, then read it."""
    spark = pages.sparkSession
    path = scratch_path(spark, "llm-warc")
    archive_pages(pages, path)
    return archived_pages(spark, path)
