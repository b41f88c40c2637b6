"""WARC archives as a PySpark Python data source."""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .shared import stored

#: Columns a read can ask for, in WARC's terms; a schema without ``payload`` never reads one, and one without ``payload_bytes`` either no HTTP header.
SCHEMA = "record_id string, page_id long, url string, record_type string, refers_to long, date string, payload_digest string, payload_bytes long, payload binary"
_TYPES = {"record_id": pa.string(), "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "date": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary()}
_DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadArchive(ValueError):
    """An archive that is no WARC file or ends within a record; names the file and the place."""


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it. Paths come with a scheme (see ``_qualified``)."""
    return fs.FileSystem.from_uri(path)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark's own file system gives it, so that all machines read and write the same place."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return "file://" + urlsplit(uri).path if uri.startswith("file:") else uri


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    """The page's number in a record's name, if it is one of ours; others have none."""
    number = (urn or "").strip("<>").removeprefix("urn:page:")
    return int(number) if number.lstrip("-").isdigit() else None


def _record(page_id, url, kind, refers, digest, length, body) -> bytes:
    """One record: WARC headers, HTTP headers and, for a response, the payload as it is."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + body if kind == "response" else http
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {_urn(page_id)}\r\nWARC-Date: {_DATE}\r\nWARC-Payload-Digest: sha256:{digest}\r\n"
    if url is not None:
        head += f"WARC-Target-URI: {_header_safe(url)}\r\n"
    if kind == "revisit":
        head += f"WARC-Refers-To: {_urn(refers)}\r\nWARC-Profile: {_PROFILE}\r\n"
    head += f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _header_safe(url: str) -> str:
    """Blanks and control characters as %XX; a header is one line."""
    return "".join(quote(c) if c <= " " or c == "\x7f" else c for c in url)


@dataclass
class _Written(WriterCommitMessage):
    file: str


@dataclass
class _Files(InputPartition):
    files: list


class WarcSource(DataSource):
    """``spark.read/write.format("warc")``: writes record tables, reads ``SCHEMA`` or any part of it. Options: path, partitionbytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], schema.fieldNames(), int(self.options.get("partitionbytes", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema.fieldNames())


class _Writer(DataSourceArrowWriter):
    """Each task writes a file that readers don't see, and the commit gives those of the tasks that counted their names: what a lost or
    repeated task leaves behind is never read. Each record is a gzip member of its own, as is usual, so any tool can read or skip it."""

    def __init__(self, path: str, names: list[str]) -> None:
        self.path, self.names = path, names

    def write(self, iterator) -> WriterCommitMessage:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        at = {n: i for i, n in enumerate(self.names)}
        with store.open_output_stream(f"{root}/_{name}", compression=None) as out:
            for batch in iterator:
                cols = [batch.column(at[n]) for n in ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "body")]
                for start in range(0, batch.num_rows, 256):
                    for *head, body in zip(*(c.slice(start, 256).to_pylist() for c in cols)):
                        out.write(gzip.compress(_record(*head, zstandard.ZstdDecompressor().decompress(body) if body else b""), 3, mtime=0))
        return _Written(name)

    def commit(self, messages) -> None:
        """While files get their names there is a mark in the folder, at which readers stop: a driver that is lost meanwhile leaves no half archive that looks whole."""
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        mark = f"{root}/{UNFINISHED}"
        store.open_output_stream(mark).close()
        for m in messages:
            if m:
                store.move(f"{root}/_{m.file}", f"{root}/{m.file}")
        store.delete_file(mark)

    def abort(self, messages) -> None:
        store, root = _open(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{root}/_{m.file}")


class _Reader(DataSourceReader):
    """Plans files (``.warc``, ``.warc.gz``; a folder's, or one) into partitions of about ``partition_bytes``; keeps equality predicates on the headers for itself."""

    def __init__(self, path: str, names: list[str], partition_bytes: int) -> None:
        self.path, self.names, self.partition_bytes = path, names, partition_bytes
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in _TYPES and not column.startswith("payload_bytes") and column != "payload":
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self):
        store, root = _open(self.path)
        found = store.get_file_info(root)
        if found.type == fs.FileType.Directory:
            infos = store.get_file_info(fs.FileSelector(root, recursive=True))
            if any(x.base_name == UNFINISHED for x in infos):
                raise BadArchive(f"{root} holds an archive whose writing has not ended")
            files = [(x.path, x.size) for x in infos if x.type == fs.FileType.File and x.path.endswith((".warc", ".warc.gz")) and not x.base_name.startswith(("_", "."))]
        else:
            files = [(found.path, found.size)]
        bins: list[list] = []
        filled = self.partition_bytes
        for name, size in sorted(files, key=lambda x: (-x[1], x[0])):
            if not bins or filled + size > self.partition_bytes:
                bins.append([])
                filled = 0
            bins[-1].append(name)
            filled += size
        return [_Files(b) for b in bins] or [_Files([])]

    def read(self, partition):
        store, _ = _open(self.path)
        rows: dict[str, list] = {n: [] for n in self.names}
        n, held = 0, 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(rows[c], _TYPES[c]) for c in self.names], names=self.names)

        for name in partition.files:
            with store.open_input_file(name) as f:
                source = _Source(f, name)
                while (head := source.headers("WARC/")) is not None:
                    length = source.number(head, "content-length")
                    row = {
                        "record_id": head.get("warc-record-id"), "page_id": _page(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "record_type": head.get("warc-type"),
                        "refers_to": _page(head.get("warc-refers-to")), "date": head.get("warc-date"), "payload_digest": (head.get("warc-payload-digest") or "").removeprefix("sha256:") or None,
                    }
                    left = length
                    if all(row[c] in v for c, v in self.wanted.items()):
                        if "payload_bytes" in rows or "payload" in rows:
                            left = self._payload(source, head, length, row)
                            held += len(row.get("payload") or b"")
                        for c in self.names:
                            rows[c].append(row.get(c))
                        n += 1
                    source.skip(left)
                    source.end_of_record()
                    if held > 8 << 20 or n >= 5000:
                        yield batch()
                        rows, n, held = {c: [] for c in self.names}, 0, 0
        yield batch()

    def _payload(self, source: _Source, head: dict, length: int, row: dict) -> int:
        """Fills in the payload and its size; returns how much of the block is left. An HTTP message's payload is its body, without
        its encodings; that of other blocks is the block. A revisit has none: its size is what the HTTP header says."""
        encodings: list[str] = []
        http = head.get("content-type", "").lower().startswith("application/http")
        if http:
            fields, size = source.http_headers(length)
            length -= size
            encodings = [x.strip().lower() for k in ("content-encoding", "transfer-encoding") for x in fields.get(k, "").split(",") if x.strip() and x.strip().lower() != "identity"]
            if row["record_type"] == "revisit":
                row["payload_bytes"] = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else None
                return length
        elif row["record_type"] == "revisit":
            return length
        if not encodings and "payload" not in self.names:
            row["payload_bytes"] = length
            return length
        body = _decoded(source.read(length), encodings)
        row["payload"], row["payload_bytes"] = body, len(body)
        return 0


def _decoded(body: bytes, encodings: list[str]) -> bytes:
    """An HTTP body without its content and transfer encodings; one that is unknown or broken stays as it is."""
    for name in reversed(encodings):
        try:
            if name == "chunked":
                body = _chunks(body)
            elif name in ("gzip", "x-gzip"):
                body = gzip.decompress(body)
            elif name == "deflate":
                body = zlib.decompress(body) if body[:1] == b"\x78" else zlib.decompress(body, -zlib.MAX_WBITS)
            elif name == "zstd":
                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            else:
                return body
        except (OSError, EOFError, ValueError, zlib.error, zstandard.ZstdError):
            return body
    return body


def _chunks(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


#: In a folder while its files get their names.
UNFINISHED = "_unfinished"
_HEADER_END = re.compile(rb"\r?\n\r?\n")


class _Source:
    """Bytes of a WARC file from front to back, plain or gzip (one member per record or a whole file), read in steps. What is
    skipped in a plain file is never read, and in a gzip file never kept."""

    def __init__(self, f, name: str, step: int = 1 << 16) -> None:
        self.f, self.name, self.step = f, name, step
        self.zipped = f.read(2) == b"\x1f\x8b"
        f.seek(0)
        self.size, self.buffer, self.at, self.unzip = f.size(), bytearray(), 0, None
        self.pending = b""

    def _more(self) -> bool:
        """Append the next bytes to the buffer; False at the end of the file."""
        del self.buffer[: self.at]  # what is left stays in place, so a long block is not copied at every step
        self.at = 0
        if not self.zipped:
            data = self.f.read(self.step)
            self.buffer += data
            return bool(data)
        while True:
            raw = self.pending or self.f.read(self.step)
            self.pending = b""
            if not raw:
                if self.unzip is not None:
                    self._bad("ends within a gzip member")
                return False
            if self.unzip is None:
                self.unzip = zlib.decompressobj(31)
            try:
                data = self.unzip.decompress(raw, 1 << 20)
            except zlib.error as e:
                self._bad(str(e))
            self.pending = self.unzip.unconsumed_tail or self.unzip.unused_data
            if self.unzip.eof:
                self.unzip = None
            if data:
                self.buffer += data
                return True

    def _bad(self, what: str):
        raise BadArchive(f"{self.name}, before byte {self.f.tell()}: {what}")

    def read(self, n: int) -> bytes:
        out = [bytes(self.buffer[self.at : self.at + n])]
        self.at += len(out[0])
        n -= len(out[0])
        while n:
            if not self._more():
                self._bad("ends within a record")
            part = bytes(self.buffer[:n])
            self.at = len(part)
            n -= len(part)
            out.append(part)
        return b"".join(out)

    def skip(self, n: int) -> None:
        here = min(n, len(self.buffer) - self.at)
        self.at += here
        n -= here
        if n and not self.zipped:
            if self.f.tell() + n > self.size:
                self._bad("ends within a record")
            self.f.seek(self.f.tell() + n)
            return
        while n:
            if not self._more():
                self._bad("ends within a record")
            self.at = min(n, len(self.buffer))
            n -= self.at

    def _line(self, most: int = 1 << 20) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            if len(self.buffer) - self.at > most:
                self._bad("has a header line without an end")
            if not self._more():
                if self.at < len(self.buffer):
                    self._bad("ends within a header")
                return None
        line = bytes(self.buffer[self.at : end])
        self.at = end + 1
        return line.removesuffix(b"\r")

    def headers(self, first: str) -> dict[str, str] | None:
        """The header of the next record, names in lower case; None at the end. Lines that begin with a blank go on with the last one."""
        line = self._line()
        while line == b"":
            line = self._line()
        if line is None:
            return None
        if not line.startswith(first.encode()):
            self._bad(f"has {line[:40]!r} where a record should begin")
        out: dict[str, str] = {}
        name = None
        while line := self._line():
            text = line.decode("utf-8", "replace")
            if text[0] in " \t" and name:
                out[name] += " " + text.strip()
            elif ":" in text:
                name, value = text.split(":", 1)
                name = name.strip().lower()
                out[name] = value.strip()
        if line is None:
            self._bad("ends within a header")
        return out

    def http_headers(self, length: int) -> tuple[dict[str, str], int]:
        """(fields, size) of the HTTP header within a block, whose lines end with CRLF or LF; a block without one is all body. Each byte is searched once."""
        seen = 0
        while not (found := _HEADER_END.search(self.buffer, self.at + seen, self.at + length)):
            seen = max(0, len(self.buffer) - self.at - 3)
            if len(self.buffer) - self.at >= length:
                return {}, 0
            if not self._more():
                self._bad("ends within a record")
        block, size = bytes(self.buffer[self.at : found.start()]), found.end() - self.at
        self.at = found.end()
        lines = [x.split(":", 1) for x in block.decode("latin-1").splitlines()[1:] if ":" in x]
        return {k.strip().lower(): v.strip() for k, v in lines}, size

    def number(self, head: dict[str, str], name: str) -> int:
        if not head.get(name, "").isdigit():
            self._bad(f"has a record without {name}")
        return int(head[name])

    def end_of_record(self) -> None:
        """Two line ends, CRLF or LF; the last record's may be missing, as the record itself is whole."""
        while len(self.buffer) - self.at < 4 and self._more():
            pass
        after = bytes(self.buffer[self.at : self.at + 4])
        for end in (b"\r\n\r\n", b"\n\n"):
            if after.startswith(end) or (len(after) < len(end) and end.startswith(after)):
                self.at += min(len(end), len(after))
                return
        self._bad("has a record that is longer than it says")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 100) -> None:
    """Archive every row of ``pages``: one record each, equal payloads of ``revisit_bytes`` or more once.

    Of rows with equal payloads, that with the smallest id is the response and the others are revisits that refer
    to it. The least id of a digest combines before the shuffle, and the join that brings it back has plain scans on
    both sides, so a payload that a third of all pages share is split. Payloads are compressed while they move; in the
    archive they are the html in UTF-8, within records that are gzip members.

    Null html is an empty payload; null urls have no target header. Rows with a null id are responses. Rows that repeat
    an id: each repeats its record, and equal payloads under one id are all responses. Other columns are not read. An empty table makes an archive without records,
    which reads as an empty table.
    """
    spark = pages.sparkSession
    register(spark)
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("raw"))
    large = rows.where((F.octet_length("raw") >= revisit_bytes) & F.col("page_id").isNotNull())
    firsts = stored(large.select("page_id", F.sha2("raw", 256).alias("d")).groupBy("d").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first <> last").drop("last"), "payloads")

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                raw = part.column(2).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()), pa.array([len(x) for x in raw], pa.int64()), pa.array([squeeze(x) for x in raw], pa.binary())],
                    names=["page_id", "url", "payload_digest", "payload_bytes", "body"],
                )

    packed = rows.mapInArrow(pack, "page_id long, url string, payload_digest string, payload_bytes long, body binary")
    joined = packed.join(firsts, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") >= revisit_bytes), "left")
    revisit = F.col("first").isNotNull() & (F.col("first") != F.col("page_id"))
    records = joined.select(
        "page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"),
        "payload_digest", "payload_bytes", F.when(~F.coalesce(revisit, F.lit(False)), F.col("body")).alias("body"),
    )
    records.write.format("warc").mode("append").option("path", _qualified(spark, path)).save()


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The records of an archive: a folder of ``.warc`` and ``.warc.gz`` files, or one file, of any maker.

    All record types come as rows; ``page_id`` and ``refers_to`` are null for records that are not named by a page's number.
    ``payload`` is an HTTP message's body without its encodings, or the block of another record. Predicates of equality on what
    is in a record's headers are tested there, and a payload is only read for a record that passes them, if ``payload`` is asked for; else
    it is skipped. A file that is cut off within a record or no WARC file raises ``BadArchive``, and so does a folder whose writing has not ended.
    """
    register(spark)
    fields = dict(x.split(" ") for x in SCHEMA.split(", "))
    return spark.read.format("warc").schema(", ".join(f"{n} {fields[n]}" for n in columns or fields)).option("path", _qualified(spark, path)).load()
