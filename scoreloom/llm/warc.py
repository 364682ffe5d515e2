"""WARC archives as a Python data source, and archives of pages without repeated payloads.

Reading. Files are the partitions, small ones in groups. A record's headers are parsed first, from
the first bytes of its gzip member; predicates on record type and on other header columns are pushed
into the reader and decide there and then. A record that is not wanted, and the payload where the
asked schema has no ``payload``, is skipped by seeking: every member names its compressed size
in the ``sl`` field of its gzip header, as the format allows. Members without that field, and
plain archives, are read as well, only without seeking past compressed data.

Writing. Every task writes files of its own under names beginning with a dot, and the commit gives
them their final names, so a lost or repeated attempt leaves nothing that a reader would see.

Deduplication. Payload digests are grouped over all pages; of equal payloads of at least
``MIN_REVISIT`` bytes the page with the smallest id is written as a response, others as revisits
that name it. Only digests that occur more than once are joined back.

Defined cases: a very long payload is one record, held whole by the task that writes or decodes it. A null payload is an empty one; a null URL is left out of the headers and read as
null. Line breaks in header values are percent-encoded. Null page ids sort first. Repeated pages
are written as often as they come; those that share the smallest id and the payload are all
responses. Extra columns are not archived. No rows write no records; an empty folder reads as an
empty table.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull,
    StringStartsWith, WriterCommitMessage,
)

MIN_REVISIT = 100
FILE_BYTES = 64 << 20         # archives roll over at this size
PARTITION_BYTES = 32 << 20    # small archives share a partition up to this size
BATCH_BYTES = 4 << 20
HEAD_BYTES = 4096             # of a record, decompressed at a time until its headers are complete
DATE = "2000-01-01T00:00:00Z"
HEADERS = {                   # columns of the source and the header fields behind them
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
    "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To",
    "content_type": "Content-Type", "full_length": "X-Full-Payload-Length",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload binary"


def filesystem(path: str):
    """The file system and the path on it; a URI of any scheme that Arrow knows, or a local path."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def header_value(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def encode_record(row: dict) -> bytes:
    """A gzip member whose header tells its compressed and its plain size."""
    payload = row.get("payload") or b""
    block = (b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)) + payload
    lines = ["WARC/1.1"]
    lines += [f"{h}: {header_value(row[c])}" for c, h in HEADERS.items() if row.get(c) is not None]
    lines += [f"Content-Length: {len(block)}", "", ""]
    plain = "\r\n".join(lines).encode("utf-8") + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(plain) + packer.flush()
    trailer = struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(plain) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + trailer


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, file_bytes: int, overwrite: bool):
        self.path, self.file_bytes, self.overwrite = path, file_bytes, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, folder = filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    names.append(f"records-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{folder}/.{names[-1]}", compression=None), 0
                data = encode_record(row)
                out.write(data)
                size += len(data)
                if size >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        message = WriterCommitMessage()
        message.names = names
        return message

    def commit(self, messages) -> None:
        fs, folder = filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        if self.overwrite:
            for name in _archives(fs, folder):
                fs.delete_file(name[0])
        for message in messages:
            for name in message.names if message else ():
                fs.move(f"{folder}/.{name}", f"{folder}/{name}")

    def abort(self, messages) -> None:
        fs, folder = filesystem(self.path)
        for message in messages:
            for name in message.names if message else ():
                fs.delete_file(f"{folder}/.{name}")


def _archives(fs, folder: str) -> list[tuple[str, int]]:
    from pyarrow.fs import FileSelector, FileType

    info = fs.get_file_info(folder)
    if info.type == FileType.File:
        return [(info.path, info.size)]
    found = fs.get_file_info(FileSelector(folder, allow_not_found=True))
    return sorted(
        (f.path, f.size) for f in found if f.type == FileType.File and not f.base_name.startswith((".", "_"))
        and f.base_name.endswith((".warc", ".warc.gz")))


class Member:
    """One record of an archive, decoded only as far as it is asked for."""

    def __init__(self, file, gzipped: bool):
        self.file, self.gzipped = file, gzipped
        self.start, self.size = file.tell(), None
        self.unpack = zlib.decompressobj(31) if gzipped else None
        self.data = b""
        if gzipped:
            head = file.read(12)
            if head[3:4] and head[3] & 4:
                extra = file.read(struct.unpack("<H", head[10:12])[0])
                at = 0
                while at + 4 <= len(extra):
                    n = struct.unpack("<H", extra[at + 2: at + 4])[0]
                    if extra[at: at + 2] == b"sl" and n >= 4:
                        self.size = struct.unpack("<I", extra[at + 4: at + 8])[0] or None
                    at += 4 + n
            file.seek(self.start)

    def more(self, size: int = HEAD_BYTES) -> bool:
        """Decode a further part; false at the end of the record's data."""
        if not self.gzipped:
            part = self.file.read(size)
        else:
            if self.unpack.eof:
                return False
            raw = self.unpack.unconsumed_tail or self.file.read(size)
            part = self.unpack.decompress(raw, 4 * size)
            if not part and not raw:
                return False
        self.data += part
        return bool(part) or self.gzipped

    def headers(self) -> dict[str, str] | None:
        while b"\r\n\r\n" not in self.data.lstrip(b"\r\n"):
            if not self.more():
                return None
        self.data = self.data.lstrip(b"\r\n")
        head, _, rest = self.data.partition(b"\r\n\r\n")
        self.head_size, self.data = len(head) + 4, rest
        fields = {}
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        self.block = int(fields.get("content-length", 0))
        return fields

    def payload(self) -> bytes:
        parts, have = [self.data], len(self.data)
        while have < self.block:
            self.data = b""
            if not self.more(1 << 16):
                break
            parts.append(self.data)
            have += len(self.data)
        self.data = b"".join(parts)
        self.read = have
        block = self.data[: self.block]
        return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block

    def skip(self) -> None:
        """Stand at the next record."""
        if self.gzipped and self.size:
            self.file.seek(self.start + self.size)
        elif self.gzipped:
            while not self.unpack.eof and self.more(1 << 16):
                self.data = b""
            self.file.seek(self.file.tell() - len(self.unpack.unused_data))
        else:
            self.file.seek(self.file.tell() - len(self.data) + self.block)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], partition_bytes: int):
        self.path, self.columns, self.partition_bytes = path, columns, partition_bytes
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = getattr(f, "attribute", (None,))
            known = len(column) == 1 and column[0] in HEADERS
            if known and isinstance(f, EqualTo):
                self.tests.append((column[0], "in", [f.value]))
            elif known and isinstance(f, In):
                self.tests.append((column[0], "in", list(f.value)))
            elif known and isinstance(f, StringStartsWith):
                self.tests.append((column[0], "starts", f.value))
            elif known and isinstance(f, IsNotNull):
                self.tests.append((column[0], "known", None))
            else:
                yield f

    def partitions(self):
        fs, folder = filesystem(self.path)
        groups, size = [], None
        for name, bytes_ in _archives(fs, folder):
            if size is None or size + bytes_ > self.partition_bytes:
                groups.append([])
                size = 0
            groups[-1].append(name)
            size += bytes_
        return [InputPartition(json.dumps(g)) for g in groups]

    def wanted(self, values: dict[str, str | None]) -> bool:
        for column, kind, value in self.tests:
            have = values[column]
            if have is None or kind == "in" and have not in value or kind == "starts" and not have.startswith(value):
                return False
        return True

    def read(self, partition):
        fs, _ = filesystem(self.path)
        rows, size = {c: [] for c in self.columns}, 0
        types = {c: pa.binary() if c == "payload" else pa.string() for c in self.columns}

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[c], types[c]) for c in self.columns], names=self.columns)

        for name in json.loads(partition.value) if partition is not None else ():
            with fs.open_input_file(name) as file:
                end = file.size()
                source = io.BufferedReader(_Seekable(file), 1 << 18)
                gzipped = name.endswith(".gz")
                while source.tell() < end:
                    member = Member(source, gzipped)
                    fields = member.headers()
                    if fields is None:
                        break
                    values = {c: fields.get(h.lower()) for c, h in HEADERS.items()}
                    if self.wanted(values):
                        for c in self.columns:
                            v = member.payload() if c == "payload" else values[c]
                            rows[c].append(v)
                            size += len(v) if v else 8
                    member.skip()
                    if size >= BATCH_BYTES:
                        yield batch()
                        rows, size = {c: [] for c in self.columns}, 0
        if size:
            yield batch()


class _Seekable(io.RawIOBase):
    """An Arrow file as a raw Python file, to be buffered."""

    def __init__(self, file):
        self.file = file

    def readable(self):
        return True

    def seekable(self):
        return True

    def readinto(self, buffer):
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def seek(self, offset, whence=0):
        self.file.seek(offset, whence)
        return self.file.tell()

    def tell(self):
        return self.file.tell()


class WarcSource(DataSource):
    """Options: path; file_bytes for writing, partition_bytes for reading."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], schema.names,
                          int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The records of a file or folder; name columns without ``payload`` to leave payloads undecoded."""
    register(spark)
    reader = spark.read.format("warc").option("path", path)
    if columns:
        reader = reader.schema(", ".join(f"{c} {'binary' if c == 'payload' else 'string'}" for c in columns))
    return reader.load()


def write_warc(records: DataFrame, path: str) -> None:
    """Write records with columns of the source; missing ones are left out of the headers."""
    register(records.sparkSession)
    columns = [c for c in [*HEADERS, "payload"] if c in records.columns]
    records.select(*columns).write.format("warc").option("path", path).mode("append").save()


def page_records(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A WARC record for each page, with repeated payloads as revisits."""
    payload = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    df = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), payload.alias("payload"))
    df = df.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    seen = (
        df.where(F.col("size") >= MIN_REVISIT).groupBy("digest")
        .agg(F.min(F.struct("id")).alias("first"), F.max(F.struct("id")).alias("last"))
        .where("first < last").select("digest", F.col("first.id").alias("first_id"), F.lit(True).alias("shared"))
    )
    df = df.join(seen, "digest", "left")
    again = F.coalesce("shared", F.lit(False)) & ~F.col("id").eqNullSafe(F.col("first_id"))

    def name(c):
        return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))

    return df.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        name(F.col("id")).alias("record_id"), F.col("url").alias("target_uri"),
        F.lit(DATE).alias("date"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(again, name(F.col("first_id"))).alias("refers_to"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        F.col("size").cast("string").alias("full_length"),
        F.when(~again, F.col("payload")).alias("payload"))


def page_of(record_name):
    """The page id in a record name, as a string; null for a null id."""
    return F.nullif(F.regexp_extract(record_name, "^<urn:page:(.*)>$", 1), F.lit("null"))
