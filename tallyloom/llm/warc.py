"""WARC archives as a Python data source, and duplicate pages as revisit records.

    spark.dataSource.register(WarcDataSource)
    pages.write.format("warc").mode("append").save(folder)
    spark.read.format("warc").load(folder).where("record_type = 'response'")

Reading plans a partition for each file. It parses a record's headers first; a record that the pushed
filters on record_type or other header columns refuse is passed over without reading its block, and so is
every block if the option payload is "false".
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not, WriterCommitMessage
from pyspark.sql.types import StructType

from tallyloom.llm._shared import left_by_key, opened, output_file, scratch, split_by_members, written

SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
#: Columns that a record's headers give.
HEADER_COLUMNS = ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to")
#: The date of every record unless the option says otherwise, so that archives are the same in every run.
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a file after which a task begins the next one.
FILE_BYTES = 1 << 30
#: Names of files that count only if listed.
_OWN = re.compile(r"tallyloom-[0-9a-f]{32}\.")
_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One record: a response has HTTP headers and payload, a revisit the HTTP headers alone. size and digest are those of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    name = "null" if page_id is None else str(page_id)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{'null' if refers_to is None else refers_to}>", f"WARC-Profile: {REVISIT}"]
    lines += ["Content-Type: application/http; msgtype=response", f"X-Payload-Length: {size}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A record as one gzip member. Its extra field "sl" has the member's and the record's lengths, by which a reader passes over it."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    extra = b"sl" + struct.pack("<HII", 8, 10 + 2 + 12 + len(body) + 8, len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _page(value: bytes | None) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?\d+)>", value or b"")
    return int(found[1]) if found else None


class _Bytes:
    """Reads ahead in a file; skips by seeking where what is skipped isn't read yet."""

    def __init__(self, file: pa.NativeFile, ahead: int = 1 << 18):
        self.file, self.ahead, self.data, self.at = file, ahead, b"", 0

    def peek(self, n: int) -> bytes:
        """The next n bytes, fewer at the end of the file."""
        while len(self.data) - self.at < n and (more := self.file.read(max(self.ahead, n))):
            self.data, self.at = self.data[self.at :] + more, 0
        return self.data[self.at : self.at + n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        if len(out) < n:
            raise ValueError("a WARC file is cut short")
        self.at += n
        return out

    def skip(self, n: int) -> None:
        here = len(self.data) - self.at
        if n <= here:
            self.at += n
        else:
            self.data, self.at = b"", 0
            self.file.seek(self.file.tell() + n - here)

    def head(self, limit: int = 1 << 20) -> bytes:
        """Up to and with the next empty line; nothing at the end of the file."""
        n = 4096
        while (end := (seen := self.peek(n)).find(b"\r\n\r\n")) < 0:
            if len(seen) < n or n > limit:
                if seen.strip():
                    raise ValueError("a WARC record's headers do not end")
                return b""
            n *= 4
        return self.take(end + 4)


class _Records:
    """The records of a plain or gzip file, one after the other: head() parses no more than a record's headers, then block() reads the rest or next() passes over it."""

    def __init__(self, file: pa.NativeFile):
        self.data, self.left, self.inflate, self.begun = _Bytes(file), 0, None, b""

    def head(self) -> bytes:
        start = self.data.peek(12)
        if start[:2] != b"\x1f\x8b":
            self.inflate = None
            return self.data.head()
        length = None
        extra = self.data.peek(12 + struct.unpack_from("<H", start, 10)[0])[12:] if start[3] & 4 else b""
        while len(extra) >= 4:
            size = struct.unpack_from("<H", extra, 2)[0]
            if extra[:2] == b"sl" and size >= 4:
                length = struct.unpack_from("<I", extra, 4)[0]
            extra = extra[4 + size :]
        self.inflate = zlib.decompressobj(31)
        self.left, self.begun = length, b""
        while (end := self.begun.find(b"\r\n\r\n")) < 0:
            if not self._more(2048):
                raise ValueError("a WARC record's headers do not end")
        head, self.begun = self.begun[: end + 4], self.begun[end + 4 :]
        return head

    def _more(self, n: int) -> bool:
        """Inflates up to n more bytes of the member."""
        if self.inflate.eof:
            return False
        n = n if self.left is None else min(n, self.left)
        data = self.data.peek(n)
        if not data:
            raise ValueError("a WARC file is cut short")
        self.begun += self.inflate.decompress(data)
        used = len(data) - len(self.inflate.unused_data)
        self.data.skip(used)
        if self.left is not None:
            self.left -= used
        return True

    def block(self, size: int) -> bytes:
        if self.inflate is None:
            out = self.data.take(size)
            self.data.skip(4)
            return out
        while self._more(1 << 16):
            pass
        return self.begun[:size]

    def next(self, size: int) -> None:
        if self.inflate is None:
            self.data.skip(size + 4)
        elif self.left is not None:
            self.data.skip(self.left)
        else:
            self.block(size)


def _accepts(f: Filter, row: dict) -> bool:
    if isinstance(f, Not):
        return not _accepts(f.child, row)
    value = row[f.attribute[0]]
    if isinstance(f, EqualTo):
        return value is not None and value == f.value
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if isinstance(f, In):
        return value in f.value
    return (value is None) == isinstance(f, IsNull)


def _pushable(f: Filter) -> bool:
    # the negation of a comparison with null is not true in SQL, so only tests for null may be negated
    if isinstance(f, Not):
        return isinstance(f.child, (IsNull, IsNotNull)) and _pushable(f.child)
    return isinstance(f, (EqualTo, EqualNullSafe, In, IsNull, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS


@dataclass
class WarcFile(InputPartition):
    uri: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns = options["path"], schema.fieldNames()
        self.payload = options.get("payload", "true").lower() != "false" and "payload" in self.columns
        self.filters: list[Filter] = []
        self.passed_over = 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _pushable(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[WarcFile]:
        """One for each .warc or .warc.gz file below the path, however deep; of those that this module's writer has made, only what a finished write lists."""
        system, root = opened(self.path)
        found = [i.path for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File]
        listed = {n for p in found if p.endswith(".files") for n in system.open_input_stream(p).read().decode().split()}
        names = [p.removeprefix(root).lstrip("/") for p in found if p.endswith((".warc", ".warc.gz"))]
        return [WarcFile(f"{self.path}/{n}") for n in sorted(names) if (own := n.rpartition("/")[2]) in listed or not _OWN.match(own)]

    def records(self, file: pa.NativeFile) -> Iterator[tuple]:
        data = _Records(file)
        while head := data.head():
            if not head.startswith(b"WARC/"):
                raise ValueError("a WARC record does not begin where one is due")
            fields = {k.lower(): v for k, v in _HEADER.findall(head)}
            size, kind = int(fields[b"content-length"]), fields.get(b"warc-type", b"").decode()
            length, digest = fields.get(b"x-payload-length"), fields.get(b"warc-payload-digest", b"").decode().rpartition(":")[2] or None
            url = fields.get(b"warc-target-uri")
            row = {"page_id": _page(fields.get(b"warc-record-id")), "url": None if url is None else re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), url).decode("utf-8", "replace"), "record_type": kind, "payload_bytes": None if length is None else int(length), "payload_digest": digest, "refers_to": _page(fields.get(b"warc-refers-to")) if kind == "revisit" else None, "payload": None}
            if not all(_accepts(f, row) for f in self.filters):
                self.passed_over += 1
                data.next(size)
                continue
            if self.payload and kind == "response":
                row["payload"] = data.block(size).partition(b"\r\n\r\n")[2]
            else:
                data.next(size)
            yield tuple(row[c] for c in self.columns)

    def read(self, partition: WarcFile | None) -> Iterator[pa.RecordBatch]:
        """Arrow batches of some 4 MB of payload."""
        if partition is None:  # no archive
            return
        system, path = opened(partition.uri)
        with system.open_input_file(path) as file:
            held, size = [], 0
            for row in self.records(file):
                held.append(row)
                size += 256 + sum(len(x) for x in row if isinstance(x, bytes))
                if size >= 1 << 22:
                    yield self._batch(held)
                    held, size = [], 0
            if held:
                yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        types = {name: kinds[kind] for name, kind in (c.split() for c in SCHEMA.split(", "))}
        if not self.columns:
            return pa.RecordBatch.from_struct_array(pa.array([{}] * len(rows), pa.struct([])))
        return pa.RecordBatch.from_arrays([pa.array(c, types[n]) for n, c in zip(self.columns, zip(*rows))], self.columns)


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceWriter):
    """Writes rows (page_id, url, payload, payload_digest, record_type, refers_to), and payload_bytes where a revisit comes without its payload. Files count once commit lists them."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.date, self.columns = options["path"], options.get("date", DATE), schema.fieldNames()
        self.most = int(options.get("fileBytes", FILE_BYTES))
        self.gzip = options.get("compression", "gzip").lower() == "gzip"

    def write(self, rows: Iterator) -> _Written:
        names, file, size = [], None, 0
        for row in rows:
            if file is None or size >= self.most:
                if file is not None:
                    file.close()
                names.append(f"tallyloom-{uuid.uuid4().hex}.warc{'.gz' * self.gzip}")
                (file, _), size = output_file(self.path, names[-1]), 0
            payload = bytes(row["payload"] or b"")
            length = row["payload_bytes"] if "payload_bytes" in self.columns and row["payload_bytes"] is not None else len(payload)
            data = record(row["page_id"], row["url"], payload, length, row["payload_digest"] or hashlib.sha256(payload).hexdigest(), row["refers_to"], row["record_type"] == "revisit", self.date)
            data = member(data) if self.gzip else data
            file.write(data)
            size += len(data)
        if file is not None:
            file.close()
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        file, _ = output_file(self.path, f"{uuid.uuid4().hex}.files")
        with file:
            file.write("\n".join(n for m in messages if m for n in m.names).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        """Deletes the files that are known; those of tasks that failed stay unlisted, and so are never read."""
        system, root = opened(self.path)
        for name in (n for m in messages if m for n in m.names):
            system.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Makes format("warc") known, and lets Python data sources take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """pages' page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    payload is html in UTF-8, empty for null; a revisit has none. Of equal payloads of `least` bytes or more, the row with the
    smallest page_id is a response and the others are revisits that refer to it; shorter ones are all responses.
    Of rows that repeat the smallest page_id, each is a response. Null page_ids refer to the smallest one; if all
    of a payload's are null, all are responses. Other columns are not read.

    Groups are formed from digests and ids. Payloads stay where they are unless a bitmap of the repeated digests says that
    theirs may be one; of those, digests with a large share of the rows meet their group by broadcast.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(pages["html"].cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    first = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = written(first, "payloads")
    alone, maybe = split_by_members(rows, F.xxhash64("payload_digest"), first.select(F.xxhash64("payload_digest").alias("k")))
    joined = left_by_key(maybe, first, ["payload_digest", "payload_bytes"])
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    kept = ["page_id", "url", F.when(~other, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest"]
    decided = joined.select(*kept, F.when(other, "revisit").otherwise("response").alias("record_type"), F.when(other, F.col("first")).alias("refers_to"))
    return alone.withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("long")).unionByName(decided)


def archived(pages: DataFrame, folder: str | None = None, least: int = 100) -> DataFrame:
    """Writes a record for each row of pages, as revisits has them, and reads the archives' headers back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    register(spark)
    folder = folder or scratch(spark, "warc")
    revisits(pages, least).write.format("warc").mode("append").save(folder)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    # what a response's headers say of its payload is checked against the payload itself
    responses = spark.read.format("warc").load(folder).where("record_type = 'response'").withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    others = spark.read.format("warc").option("payload", "false").load(folder).where("record_type = 'revisit'")
    return responses.select(columns).unionByName(others.select(columns))
