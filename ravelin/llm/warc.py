"""WARC archives as a Python data source.

``register(spark)`` makes the format ``ravelin_warc`` known. Reading plans one partition for each file (the writer
starts a new one every ``fileBytes``); it takes predicates on header columns (``=``, ``IN`` and their like), parses a
record's headers first, and neither inflates nor decodes the rest of a record that a predicate rejects. Writing makes gzip members
of one record each. A member carries its own lengths in the ``sl`` extra field that the WARC standard's annex on gzip
describes, so that a reader may step over it; members without the field are inflated and thrown away.

Files are written under new names and become visible through a manifest that the driver writes last, so that failed or repeated tasks
leave nothing that a reader sees.
"""

from __future__ import annotations

import base64
import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from ravelin.scratch import materialize, remove

FORMAT = "ravelin_warc"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, content_length bigint, http_length bigint, payload binary"
#: Header columns, and the header field each comes from
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
_HEAD = 1 << 16
#: What is read at once of a block whose payload is not wanted: enough for usual HTTP headers; longer ones are read to their end
_SHORT = 1 << 12
#: A table of repeated digests (some 80 bytes a row) goes to every executor up to so many rows, and is shuffled beyond
_SENT = 500_000


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def gzip_member(raw: bytes, level: int = 6) -> bytes:
    """One gzip member with the lengths of its compressed and plain bytes in an ``sl`` extra field."""
    coder = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = coder.compress(raw) + coder.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(raw) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def record(record_id: str, record_type: str, uri: str | None, date: str, payload: bytes | None, digest: str, length: int, refers_to: str | None = None) -> bytes:
    """An HTTP response or a revisit of one, which has the HTTP headers of the response but not its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"" if record_type == "response" else b"")
    fields = [("WARC-Type", record_type), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest)]
    if uri:
        fields.insert(2, ("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in uri)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n" + block + b"\r\n\r\n"


def sha1_digest(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def digest_hex(digest: str | None) -> str | None:
    """The bare lower-case hex of a labelled digest, whether written in base 32 or hex."""
    if not digest:
        return None
    value = digest.rpartition(":")[2]
    try:
        return base64.b32decode(value.upper()).hex() if len(value) == 32 else bytes.fromhex(value).hex()
    except ValueError:
        return None


@dataclass
class Head:
    fields: dict[str, str]
    size: int


def parse_head(raw: bytes) -> Head | None:
    """The named fields at the start of a record; None if they do not end in ``raw``."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = raw[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in " \t" and last:
            fields[last] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        last = name.strip().lower()
        fields.setdefault(last, value.strip())
    return Head(fields, end + 4)


def header_columns(fields: dict[str, str]) -> dict[str, str | None]:
    out = {c: fields.get(f) for c, f in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        if out[c]:
            out[c] = out[c].removeprefix("<").removesuffix(">")
    out["payload_digest"] = digest_hex(out["payload_digest"])
    return out


class Stream:
    """Reads a file piece by piece."""

    def __init__(self, file, chunk: int = 1 << 18):
        self.file, self.chunk, self.hold = file, chunk, b""

    def need(self, n: int) -> bytes:
        while len(self.hold) < n:
            more = self.file.read(max(self.chunk, n - len(self.hold)))
            if not more:
                break
            self.hold += more
        return self.hold

    def drop(self, n: int) -> None:
        if n <= len(self.hold):
            self.hold = self.hold[n:]
        else:
            self.file.seek(self.file.tell() + n - len(self.hold))
            self.hold = b""


def _member_head(raw: bytes) -> tuple[int, int]:
    """The size of a gzip header, and the whole member's from an ``sl`` field (0: not told)."""
    flags, at, total = raw[3], 10, 0
    if flags & 4:
        n = struct.unpack_from("<H", raw, at)[0]
        sub, end = at + 2, at + 2 + n
        while sub + 4 <= end:
            size = struct.unpack_from("<H", raw, sub + 2)[0]
            if raw[sub : sub + 2] == b"sl" and size == 8:
                total = struct.unpack_from("<I", raw, sub + 4)[0]
            sub += 4 + size
        at = end
    for flag in (8, 16):
        if flags & flag:
            at = raw.index(b"\0", at) + 1
    return at + 2 * bool(flags & 2), total


def read_records(stream: Stream, wanted, payloads: bool) -> Iterator[tuple[Head, dict, bytes]]:
    """Records whose header columns ``wanted`` takes, with their blocks (unless ``payloads``: only how they begin)."""
    while stream.need(2):
        if stream.hold[:2] == b"\x1f\x8b":
            yield from _gzip_record(stream, wanted, payloads)
            continue
        if stream.hold[:2] == b"\r\n":
            stream.drop(2)
            continue
        size, head = _HEAD, None
        while (head := parse_head(stream.need(size))) is None:
            if len(stream.hold) < size:
                raise ValueError("a record's headers do not end")
            size *= 2
        length = int(head.fields.get("content-length", 0))
        columns = header_columns(head.fields)
        if wanted(columns):
            told = length if payloads else min(length, _SHORT)
            block = stream.need(head.size + told)[head.size : head.size + told]
            while told < length and not _headers_end(block):
                told = min(length, 2 * told)
                block = stream.need(head.size + told)[head.size : head.size + told]
            yield head, columns, block
        stream.drop(head.size + length)


def _headers_end(block: bytes) -> bool:
    """Whether a block that begins like HTTP has the end of its headers in it."""
    return not block.startswith(b"HTTP/") or b"\r\n\r\n" in block


def _gzip_record(stream: Stream, wanted, payloads: bool):
    at, total = _member_head(stream.need(1 << 12))
    if total:
        coder, start, fed, head = zlib.decompressobj(-15), bytearray(), at, None

        def more() -> bool:
            nonlocal fed
            part = stream.need(min(total, fed + 4096))[fed : min(total, fed + 4096)]
            fed += len(part)
            start.extend(coder.decompress(part))
            return bool(part)

        while (head := parse_head(bytes(start))) is None and more():
            pass
        if head is not None:
            columns = header_columns(head.fields)
            want = wanted(columns)
            if not want or not payloads:
                if want:
                    while not _headers_end(bytes(start[head.size :])) and more():
                        pass
                    end = start.find(b"\r\n\r\n", head.size) - head.size + 4
                    yield head, columns, bytes(start[head.size : head.size + max(_SHORT, end)])
                stream.drop(total)
                return
    coder, raw, fed = zlib.decompressobj(-15), bytearray(), at
    stream.drop(at)
    while not coder.eof:
        part = stream.need(1)
        if not part:
            raise ValueError("a gzip member ends early")
        raw += coder.decompress(part)
        stream.drop(len(part) - len(coder.unused_data))
        fed += len(part) - len(coder.unused_data)
    if struct.unpack("<II", stream.need(8)[:8]) != (zlib.crc32(raw), len(raw) & 0xFFFFFFFF):
        raise ValueError("a gzip member's checksum is wrong")
    stream.drop(8)
    head = parse_head(bytes(raw[: raw.find(b"\r\n\r\n") + 4]))
    if head is None:
        raise ValueError("a record's headers do not end")
    columns = header_columns(head.fields)
    if wanted(columns):
        length = int(head.fields.get("content-length", 0))
        end = raw.find(b"\r\n\r\n", head.size) - head.size + 4
        yield head, columns, bytes(raw[head.size : head.size + (length if payloads else min(length, max(_SHORT, end)))])


def split_http(block: bytes) -> tuple[int | None, bytes]:
    """The Content-Length that the HTTP headers tell, and what follows them."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return None, block
    for line in block[:end].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value), block[end + 4 :]
    return None, block[end + 4 :]


class WarcSource(DataSource):
    """Options: ``path``; for reads ``payload`` (``true``: decode, ``false``: null, but HTTP lengths are still read); for writes ``level``, ``fileBytes``.

    Written rows have the columns record_id, record_type, target_uri, date, refers_to, payload_digest (SHA-1, hex), http_length and payload.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options), overwrite)


class FilePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() == "true"
        self.equal: list[tuple[str, tuple]] = []
        self.prefix: list[tuple[str, str]] = []
        self.told: list[str] = []
        self.schema = schema

    def pushFilters(self, filters: list[Filter]):
        """Equality, membership and prefixes of header columns are taken; the rest goes back to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if column in HEADERS and isinstance(f, EqualTo):
                self.equal.append((column, (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.equal.append((column, tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.prefix.append((column, f.value))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.told.append(column)
            else:
                yield f

    def partitions(self) -> Sequence[FilePartition]:
        fs, path = filesystem(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.File:
            return [FilePartition(self.path)]
        names = [f.base_name for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))]
        listed = [n for n in names if n.startswith("_manifest-")]
        if listed:
            names = []
            for n in sorted(listed):
                with fs.open_input_stream(f"{path}/{n}") as f:
                    names += json.loads(f.read())
        found = [FilePartition(posixpath.join(self.path, n)) for n in sorted(names) if n.endswith((".warc", ".warc.gz"))]
        return found or [FilePartition("")]

    def wanted(self, columns: dict) -> bool:
        return all(columns[c] in values for c, values in self.equal) and all((columns[c] or "").startswith(p) for c, p in self.prefix) and all(columns[c] is not None for c in self.told)

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        names = self.schema.names
        arrow = pa.schema([(n, {"bigint": pa.int64(), "binary": pa.binary()}.get(self.schema[n].dataType.simpleString(), pa.string())) for n in names])
        rows, size = [], 0
        if partition.path:
            fs, path = filesystem(partition.path)
            with fs.open_input_file(path) as f:
                for head, columns, block in read_records(Stream(f), self.wanted, self.payload):
                    length, payload = split_http(block)
                    row = columns | {"content_length": int(head.fields.get("content-length", 0)), "http_length": length, "payload": payload if self.payload else None}
                    rows.append({n: row[n] for n in names})
                    size += len(payload) if self.payload else 0
                    if len(rows) >= 5000 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.level, self.most = int(options.get("level", 6)), int(options.get("filebytes", options.get("fileBytes", 256 << 20)))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, path = filesystem(self.path)
        fs.create_dir(path, recursive=True)
        files, out, size = [], None, 0
        try:
            for b in batches:
                for r in b.to_pylist():
                    if out is None or size > self.most:
                        if out is not None:
                            out.close()
                        files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{path}/{files[-1]}", compression=None), 0
                    raw = gzip_member(record(r["record_id"], r["record_type"], r["target_uri"], r["date"], r["payload"], sha1_digest(r["payload_digest"]), r["http_length"], r["refers_to"]), self.level)
                    out.write(raw)
                    size += len(raw)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = filesystem(self.path)
        fs.create_dir(path, recursive=True)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(path)):
                if f.base_name.startswith("_manifest-"):
                    fs.delete_file(f.path)
        with fs.open_output_stream(f"{path}/_manifest-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps([n for m in messages if m for n in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = filesystem(self.path)
        for m in messages:
            for n in m.files if m else ():
                fs.delete_file(f"{path}/{n}")


def archive_pages(pages, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record for each row: of equal payloads of at least ``least`` bytes the one with the largest id is the response, the others revisit it.

    A null payload is empty; a null url leaves the field out. Rows that repeat the largest id of their payload are all responses. Which payloads repeat is told by digests,
    lengths and ids alone. The table of those that do is written down and counted, and sent to the executors as long as it is small, so that no payload is shuffled; a
    larger one is joined by digest, where Spark splits the payloads of a hot digest. Other columns are not read, and an empty table gives an empty archive.
    """
    rows, repeated = hashed(pages, page_id, url, html, least)
    records(rows, repeated, date).write.format(FORMAT).mode("append").save(path)
    remove(repeated)


def hashed(pages, page_id: str, url: str, html: str, least: int):
    """The pages with their digests and lengths, and a table of the digests that repeat."""
    raw = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("string").alias("id"), F.col(page_id).alias("page"), F.col(url).alias("target_uri"), raw.alias("payload")).withColumn("http_length", F.length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    repeated = materialize(rows.where(F.col("http_length") >= least).groupBy("payload_digest", "http_length").agg(F.max("page").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "http_length", "kept"), "digests")
    return rows, repeated


def records(rows, repeated, date: str):
    """The rows of the archive."""
    joined = rows.join(F.broadcast(repeated) if repeated.count() <= _SENT else repeated, ["payload_digest", "http_length"], "left")
    revisit = F.col("kept").isNotNull() & ~F.col("page").eqNullSafe(F.col("kept"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c, F.lit("")))
    return joined.select(
        urn(F.col("id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit(date).alias("date"),
        F.when(revisit, urn(F.col("kept").cast("string"))).alias("refers_to"),
        "payload_digest",
        "http_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
