"""WARC data source and sink, both in Python.

Reading plans one partition a file, and several byte ranges of a large uncompressed file.  Ranges are cut at records,
which are found by their lengths from the file's beginning on, as text in a payload can look like a record.  Predicates on ``warc_type`` and on header columns are pushed down: a record's headers are
parsed first, and the payload of a record that they turn away is skipped, in an uncompressed file by seeking past it.
With the option ``payload`` false no payload is decoded at all; with ``binary`` its bytes come undecoded in ``body``.

A payload's text is decoded by the charset that its HTTP header or, in HTML, a meta element states, else as UTF-8, and
as Windows-1252 where it isn't any of these.  Gzip and deflate encodings and chunks are undone.

Records that are broken don't end the job: ``error`` says what is wrong.  After a length that is no number, or that
reaches past the end of its file or gzip member, reading goes on at the next line that begins a record; after bytes
that don't inflate, at the next gzip member.

Set ``spark.sql.python.filterPushdown.enabled`` for the push-down; without it Spark filters the rows itself.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from gneiss.llm.shared import made

SCHEMA = "warc_type string, record_id string, target_uri string, date string, content_type string, http_status int, http_content_type string, error string, body binary, payload string"
HEADERS = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type"}
_ARROW = pa.schema([("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("http_status", pa.int32()), ("http_content_type", pa.string()), ("error", pa.string()), ("body", pa.binary()), ("payload", pa.string())])
_MEMBER = b"\x1f\x8b\x08"
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
_RECORD = re.compile(rb"WARC/\d+\.\d+[ \t]*\r?\n")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
_META = re.compile(rb"<meta[^<>]{0,200}?charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
RANGE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:/"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pafs.LocalFileSystem(), path


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the WARC files there; names that begin with a dot or an underscore aren't complete."""
    fs, root = _filesystem(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name.endswith((".warc", ".warc.gz")) and f.base_name[0] not in "._")


class _Inflated(io.RawIOBase):
    """Bytes of a gzip file of any number of members, in pieces; it can't seek.

    It ends where a member is broken.  `resume` goes on with the next one, if there is any.
    """

    def __init__(self, raw: object, rest: bytes = b"") -> None:
        self.raw, self.rest, self.inflate, self.ready, self.broken = raw, rest, zlib.decompressobj(31), b"", False

    def readable(self) -> bool:
        return True

    def readinto(self, into: memoryview) -> int:
        while not self.ready:
            data = b"" if self.broken else self.rest or self.raw.read(1 << 16)
            if not data:
                return 0
            try:
                self.ready = self.inflate.decompress(data)
                self.rest = self.inflate.unused_data
            except zlib.error:
                self.broken, self.rest = True, data
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
        n = min(len(into), len(self.ready))
        into[:n], self.ready = self.ready[:n], self.ready[n:]
        return n

    def resume(self) -> _Inflated | None:
        if not self.broken:
            return None
        data = self.rest[1:]
        while (at := data.find(_MEMBER)) < 0:
            more = self.raw.read(1 << 16)
            if not more:
                return None
            data = data[-len(_MEMBER) + 1 :] + more
        return _Inflated(self.raw, data[at:])


@dataclass
class WarcPartition(InputPartition):
    path: str
    start: int
    end: int


def _parse(lines: bytes) -> dict[str, str]:
    """Header fields with lower-case names; a continued line belongs to the field before, of equal names the last counts."""
    out: dict[str, str] = {}
    name = ""
    for line in lines.split(b"\n"):
        text = line.rstrip(b"\r").decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            out[name] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _header_block(stream: io.BufferedIOBase) -> bytes:
    parts = []
    while (line := stream.readline()) not in (b"", b"\r\n", b"\n"):
        parts.append(line)
    return b"".join(parts)


def _test(f: Filter):  # noqa: ANN202
    """A function of the headers for a filter that headers alone decide; None for any other."""
    if not isinstance(f, (EqualTo, In, IsNull, IsNotNull, StringContains, StringEndsWith, StringStartsWith)) or len(f.attribute) != 1:
        return None
    key = HEADERS.get(f.attribute[0].lower())
    if key is None:
        return None
    match f:
        case EqualTo():
            return lambda h: h.get(key) == f.value
        case In():
            return lambda h: h.get(key) in f.value
        case IsNull():
            return lambda h: key not in h
        case IsNotNull():
            return lambda h: key in h
        case StringContains():
            return lambda h: key in h and f.value in h[key]
        case StringStartsWith():
            return lambda h: key in h and h[key].startswith(f.value)
        case _:
            return lambda h: key in h and h[key].endswith(f.value)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower()
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[WarcPartition]:
        out = []
        for path, size in _files(self.path):
            if path.endswith(".gz") or size <= self.range_bytes:
                out.append(WarcPartition(path, 0, size))
            else:
                with _filesystem(self.path)[0].open_input_file(path) as raw:
                    cuts = [*_cuts(raw, size, self.range_bytes), size]
                out += [WarcPartition(path, a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out or [WarcPartition("", 0, 0)]

    def read(self, partition: WarcPartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        tests = [_test(f) for f in self.filters]
        fs, _ = _filesystem(self.path)
        columns: list[list] = [[] for _ in _ARROW]
        held = 0
        with fs.open_input_file(partition.path) as raw:
            for row in _inflated(raw, tests, self.payload) if partition.path.endswith(".gz") else _records(raw, partition, tests, self.payload):
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
                held += len(row[-1] or "") + len(row[-2] or b"") + 200
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)
                    columns, held = [[] for _ in _ARROW], 0
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _inflated(raw: object, tests: list, payload: str) -> Iterator[tuple]:
    stream: _Inflated | None = _Inflated(raw)
    while stream:
        yield from _records(io.BufferedReader(stream, 1 << 18), None, tests, payload)
        stream = stream.resume()


def _length(head: dict[str, str]) -> int | None:
    """The stated length; None where there is none or it is no number."""
    text = head.get("content-length", "")
    return int(text) if text.isascii() and text.isdigit() and len(text) < 19 else None


def _read(stream: io.BufferedIOBase, size: int) -> bytes:
    """At most ``size`` bytes, without room for more than there are."""
    parts = []
    while size > 0 and (part := stream.read(min(size, 1 << 20))):
        parts.append(part)
        size -= len(part)
    return b"".join(parts)


def _records(stream: object, part: WarcPartition | None, tests: list, payload: str) -> Iterator[tuple]:
    """Rows of the records that begin within the part, or all of a stream that can't seek."""
    size_of_file = None
    if part is not None:
        size_of_file = stream.size()
        stream = io.BufferedReader(_Seekable(stream), 1 << 18)
        stream.seek(part.start)
    fresh_line = True
    while part is None or stream.tell() < part.end:
        line = stream.readline(1 << 16)
        if not line:
            return
        begins, fresh_line = fresh_line and _RECORD.fullmatch(line), line.endswith(b"\n")
        if not begins:
            continue
        head = _parse(_header_block(stream))
        size = _length(head)
        wanted = all(t(head) for t in tests)
        own = tuple(head.get(h) for h in HEADERS.values())
        if size is None or (size_of_file is not None and size > size_of_file - stream.tell()):
            if wanted:
                yield (*own, None, None, "length", None, None)
        elif not wanted or payload == "false":
            short = _skip(stream, size, part is not None)
            if wanted:
                yield (*own, None, None, "truncated" if short else None, None, None)
        else:
            data = _read(stream, size)
            error = "truncated" if len(data) < size else None
            content = head.get("content-type", "").lower()
            if content.replace(" ", "").startswith("application/http") and head.get("warc-type") == "response":
                status, kind, data, wrong = _http(data)
            else:
                status, kind, wrong = None, None, None
            body, text = (data, None) if payload == "binary" else (None, None if wrong else _text(data, kind or content))
            yield (*own, status, kind, error or wrong, body, text)


class _Seekable(io.RawIOBase):
    def __init__(self, file: pa.NativeFile) -> None:
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, to: int, whence: int = 0) -> int:
        self.file.seek(to, whence)
        return self.file.tell()

    def readinto(self, into: memoryview) -> int:
        data = self.file.read(len(into))
        into[: len(data)] = data
        return len(data)


def _skip(stream: io.BufferedIOBase, size: int, seek: bool) -> bool:
    """Whether the stream ended before."""
    if seek:
        stream.seek(size, 1)
        return False
    while size > 0 and (got := len(stream.read(min(size, 1 << 20)))):
        size -= got
    return size > 0


def _cuts(file: pa.NativeFile, size: int, step: int) -> list[int]:
    """0 and the first record at least ``step`` after each cut; only headers are read, and payloads sought past."""
    stream = io.BufferedReader(_Seekable(file), 1 << 13)
    out, at, fresh_line = [0], 0, True
    while at < size and (line := stream.readline(1 << 16)):
        begins, fresh_line = fresh_line and _RECORD.fullmatch(line), line.endswith(b"\n")
        if begins:
            if at - out[-1] >= step:
                out.append(at)
            length = _length(_parse(_header_block(stream))) or 0
            if length <= size - stream.tell():
                stream.seek(length, 1)
        at = stream.tell()
    return out


def _text(data: bytes, kind: str) -> str:
    """The text of a payload by the charset that is stated, else as UTF-8, else as Windows-1252."""
    stated = _CHARSET.search(kind)
    if not stated and "html" in kind.lower():
        meta = _META.search(data[:2048])
        stated = (meta[1].decode("ascii", "replace"),) * 2 if meta else None
    # the web takes latin-1 for Windows-1252
    name = {"iso-8859-1": "cp1252", "latin-1": "cp1252", "latin1": "cp1252", "us-ascii": "utf-8", "ascii": "utf-8"}.get(stated[1].lower(), stated[1]) if stated else "utf-8"
    for charset in dict.fromkeys((name, "utf-8")):
        try:
            return data.decode(charset)
        except (UnicodeError, LookupError, ValueError):
            continue
    return data.decode("cp1252", "replace")


def _unchunked(data: bytes) -> bytes:
    """The body of chunks; one that isn't of chunks, as archives can have undone them, as it is."""
    parts, at = [], 0
    while True:
        end = data.find(b"\r\n", at, at + 256)
        size = data[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,8}", size):
            return b"".join(parts) if parts and at >= len(data) else data
        n = int(size, 16)
        if n == 0:
            return b"".join(parts)
        if data[end + 2 + n : end + 4 + n] != b"\r\n":
            return data
        parts.append(data[end + 2 : end + 2 + n])
        at = end + 4 + n


def _http(data: bytes) -> tuple[int | None, str | None, bytes, str | None]:
    """(status, content type, body, what is wrong) of a response; data that is none is its own body."""
    found = re.search(rb"\r?\n\r?\n", data) if data.startswith(b"HTTP/") else None
    if not found:
        return None, None, data, None
    first, _, rest = data[: found.start()].partition(b"\n")
    body, fields, words = data[found.end() :], _parse(rest), first.split(None, 2)
    status = int(words[1]) if len(words) > 1 and words[1].isdigit() and len(words[1]) < 6 else None
    if "chunked" in fields.get("transfer-encoding", "").lower():
        body = _unchunked(body)
    kind, encoding = fields.get("content-type"), fields.get("content-encoding", "").lower().strip()
    try:
        # bytes that don't begin as gzip does have been inflated by whoever archived them
        if encoding in ("gzip", "x-gzip") and body.startswith(_MEMBER):
            body = gzip.decompress(body)
        elif encoding == "deflate":
            body = zlib.decompress(body, 15 if body[:1] == b"\x78" else -15)
        elif encoding not in ("", "identity", "gzip", "x-gzip"):
            return status, kind, body, f"encoding {encoding}"
    except (zlib.error, EOFError, OSError):
        return status, kind, body, f"encoding {encoding}"
    return status, kind, body, None


@dataclass
class WarcMessage(WriterCommitMessage):
    made: str | None
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    """One file a task, under a hidden name until the job commits; what a lost task wrote is never read."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool) -> None:
        self.path, self.compress = options["path"], options.get("compression", "gzip") == "gzip"
        self.names, self.overwrite, self.job = schema.names, overwrite, uuid.uuid4().hex
        missing = {"record_id", "target_uri", "payload"} - set(self.names)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WarcMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        hidden = f"{root}/.{self.job}-{uuid.uuid4().hex}"
        with fs.open_output_stream(hidden) as out:
            out.write(self._packed(_record("warcinfo", f"<urn:info:{self.job}>", None, "application/warc-fields", b"format: WARC File Format 1.1\r\n")))
            for b in iterator:
                for r in b.to_pylist():
                    if r["payload"] is None:
                        continue
                    uri = _one_line(r["target_uri"] or "")
                    ask = f"GET {uri} HTTP/1.1\r\n\r\n".encode()
                    body = r["payload"].encode()
                    ident = _one_line(r["record_id"]) if r["record_id"] is not None else f"<urn:sha1:{hashlib.sha1(uri.encode() + body).hexdigest()}>"
                    answer = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                    out.write(self._packed(_record("request", f"{ident}-request", uri, "application/http; msgtype=request", ask)))
                    out.write(self._packed(_record("response", ident, None if r["target_uri"] is None else uri, "application/http; msgtype=response", answer)))
        return WarcMessage(hidden, f"part-{task.partitionId():05d}-{self.job}.warc" + ".gz" * self.compress)

    def _packed(self, record: bytes) -> bytes:
        return gzip.compress(record, 1, mtime=0) if self.compress else record

    def commit(self, messages: list[WarcMessage | None]) -> None:
        fs, root = _filesystem(self.path)
        if self.overwrite:
            for path, _ in _files(self.path):
                fs.delete_file(path)
        for m in messages:
            if m is not None:
                fs.move(m.made, f"{root}/{m.name}")

    def abort(self, messages: list[WarcMessage | None]) -> None:
        fs, root = _filesystem(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.made)


def _one_line(value: str) -> str:
    """A header's value; control characters, which would end its line, are percent-encoded."""
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", value)


def _record(kind: str, ident: str, uri: str | None, content: str, body: bytes) -> bytes:
    digest = hashlib.sha1(body).hexdigest()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", f"WARC-Date: {datetime(2024, 1, 1, tzinfo=UTC):%Y-%m-%dT%H:%M:%SZ}", f"WARC-Block-Digest: sha1:{digest}", f"Content-Type: {content}", f"Content-Length: {len(body)}"]
    if uri is not None:
        lines.insert(3, f"WARC-Target-URI: {uri}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gneiss_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    import gneiss.llm.shared as shared_module
    import gneiss.llm.warc as module
    import gneiss.session as session_module

    # the workers that plan a data source don't get the driver's module path
    for m in (module, shared_module, session_module):
        cloudpickle.register_pickle_by_value(m)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_warc(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write (record_id, target_uri, payload) as a request and a response record a row.

    Rows with a null payload are left out, a null target_uri gives a record without one, a null record_id one made of
    address and payload, an empty payload an empty body.  Control characters of ids and addresses are percent-encoded.
    Repeated rows give records each, very long payloads are written whole.  An empty table gives a file without
    records or none at all.  Other columns are ignored.
    """
    register(pages.sparkSession)
    rows = pages.select("record_id", "target_uri", "payload")
    rows.write.format("gneiss_warc").option("compression", compression).mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool | str = True) -> DataFrame:
    """Records of the WARC files in a folder, in the columns of ``SCHEMA``; a field that a record lacks is null.

    ``payload`` may be "binary", for the bytes of each in ``body``.  ``error`` is null for a sound record, else "length",
    "truncated", or "encoding" and its name where a body can't be decoded.
    """
    register(spark)
    return spark.read.format("gneiss_warc").option("payload", str(payload).lower()).load(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC files and their responses read back, with predicates on type and address pushed down."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = made(spark, "warc")
    write_warc(pages.select(F.format_string("<urn:page:%d>", "page_id").alias("record_id"), F.col("url").alias("target_uri"), F.col("html").alias("payload")), path)
    found = read_warc(spark, path).where("warc_type = 'response' and target_uri like 'http%'")
    return found.select(F.regexp_extract("record_id", r"page:(\d+)", 1).cast("long").alias("page_id"), F.col("target_uri").alias("url"), "http_status", F.col("payload").alias("html"))


ORACLE = "SELECT page_id, url, CAST(200 AS INTEGER) AS http_status, html FROM pages WHERE html IS NOT NULL AND url LIKE 'http%'"
