"""WARC archives as a Python data source (dealt operator 10).

``spark.write.format("warc")`` writes one record per row; ``spark.read.format("warc")`` plans one partition
per archive, takes predicates on ``record_type`` and on headers, reads a record's header block first and seeks past the
payload of records that aren't wanted. Archives lie in a folder of any file system that pyarrow opens by its
address (file, hdfs, s3, gs); a manifest names those of committed tasks, so files of lost tasks are never read.
"""
from __future__ import annotations

import base64
import binascii
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage,
)

from ..session import shared_folder
from .common import settled, typed

#: Payloads of fewer bytes are always written out.
REVISIT_BYTES = 1000
#: An archive is closed when it has grown beyond this.
ARCHIVE_BYTES = 256 << 20
MANIFEST = "manifest.json"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
WRITE_SCHEMA = "page_id bigint, url string, payload binary, digest string, length bigint, refers_to bigint, revisit boolean"
READ_SCHEMA = (
    "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, "
    "payload_bytes bigint, headers map<string,string>, payload binary"
)
#: Columns that a predicate may name, with the WARC header each stands for.
HEADER_OF = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To",
}


def _open(address: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in address and not address.startswith("file:"):
        return pafs.LocalFileSystem(), address
    if address.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + address[5:].lstrip("/")
    return pafs.FileSystem.from_uri(address)


def _header(value: str | None) -> str:
    """A value on one header line."""
    return " ".join((value or "").split())


def record(row: dict) -> bytes:
    """One WARC/1.1 response or revisit record."""
    block = HTTP % (row["length"] or 0)
    revisit = bool(row["revisit"])
    if not revisit:
        block += row["payload"] or b""
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{_id(row['page_id'])}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_header(row['url'])}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(binascii.unhexlify(row['digest'])).decode()}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{_id(row['refers_to'])}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _id(page_id: int | None) -> str:
    return "none" if page_id is None else str(page_id)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Archives of this attempt only; a retry takes new names and the manifest lists the attempt that was committed."""
        store, folder = _open(self.folder)
        store.create_dir(folder, recursive=True)
        names: list[str] = []
        out = None
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if out is None or out.tell() > self.most:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc")
                        out = store.open_output_stream(f"{folder}/{names[-1]}")
                        out.write(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\n"
                                  b"WARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\n"
                                  b"Content-Length: 18\r\n\r\nformat: WARC/1.1\r\n\r\n\r\n" % str(uuid.uuid4()).encode())
                    out.write(record(row))
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _open(self.folder)
        store.create_dir(folder, recursive=True)
        names = [n for m in messages if m for n in m.names]
        with store.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(sorted(names)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _open(self.folder)
        for m in messages:
            for n in m.names if m else ():
                store.delete_file(f"{folder}/{n}")


@dataclass
class Archive(InputPartition):
    name: str


class Wanted:
    """Predicates of one scan, applied to the header block."""

    def __init__(self):
        self.tests: list[tuple[str, str, tuple[str, ...]]] = []

    def take(self, f: Filter) -> bool:
        if not isinstance(f, (EqualTo, In, StringStartsWith)) or len(f.attribute) != 1 or f.attribute[0] not in HEADER_OF:
            return False
        values = tuple(f.value) if isinstance(f, In) else (f.value,)
        if any(not isinstance(v, str) for v in values):
            return False
        self.tests.append((f.attribute[0], "prefix" if isinstance(f, StringStartsWith) else "one of", values))
        return True

    def match(self, seen: dict[str, str | None]) -> bool:
        return all(
            seen[c] is not None and (seen[c] in v if how == "one of" else seen[c].startswith(v[0])) for c, how, v in self.tests
        )


def parse_head(source) -> dict[str, str] | None:
    """The next record's headers, or None at the end."""
    line = source.readline()
    while line in (b"\r\n", b"\n"):
        line = source.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record here: {line[:40]!r}")
    headers: dict[str, str] = {}
    while (line := source.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        headers[name.strip()] = value.strip()
    return headers


def skip(source, size: int) -> None:
    source.seek(size, 1)


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, payload: str):
        self.folder, self.payload, self.wanted = folder, payload, Wanted()

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Archive]:
        store, folder = _open(self.folder)
        with store.open_input_stream(f"{folder}/{MANIFEST}") as f:
            names = json.loads(f.read())
        return [Archive(n) for n in names] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[tuple]:
        if not partition.name:
            return
        store, folder = _open(self.folder)
        with _Buffered(store.open_input_file(f"{folder}/{partition.name}")) as source:
            while (headers := parse_head(source)) is not None:
                size = int(headers.get("Content-Length", 0))
                seen = {c: headers.get(h) for c, h in HEADER_OF.items()}
                if not self.wanted.match(seen):
                    skip(source, size)
                    continue
                kind = seen["record_type"]
                digest, length, body = _hex(headers.get("WARC-Payload-Digest")), None, None
                if kind in ("response", "revisit"):
                    before = source.tell()
                    length = _http_length(source)
                    left = size - (source.tell() - before)
                    if kind == "response" and self.payload != "none":
                        body = source.read(left)
                        if hashlib.sha1(body).hexdigest() != digest or len(body) != length:
                            raise ValueError(f"{seen['record_id']}: the payload isn't what its header says")
                        body = body if self.payload == "full" else None
                    else:
                        skip(source, left)
                elif self.payload == "full":
                    body = source.read(size)
                else:
                    skip(source, size)
                yield (*seen.values(), digest, length, headers, body)


class _Buffered:
    """Reads lines and blocks from a seekable file, a large block at a time."""

    def __init__(self, file, block: int = 1 << 20):
        self.file, self.block, self.data, self.at, self.base = file, block, b"", 0, 0

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def tell(self) -> int:
        return self.base + self.at

    def _more(self, least: int) -> bool:
        got = self.file.read(max(self.block, least))
        self.base += self.at
        self.data, self.at = self.data[self.at:] + got, 0
        return bool(got)

    def readline(self) -> bytes:
        while (end := self.data.find(b"\n", self.at)) < 0:
            if not self._more(0):
                end = len(self.data) - 1
                break
        line = self.data[self.at:end + 1]
        self.at = end + 1
        return line

    def read(self, n: int) -> bytes:
        if len(self.data) - self.at < n:
            self._more(n - (len(self.data) - self.at))
        out = self.data[self.at:self.at + n]
        self.at += len(out)
        return out

    def seek(self, n: int, _whence: int = 1) -> None:
        if self.at + n <= len(self.data):
            self.at += n
        else:
            to = self.tell() + n
            self.file.seek(to)
            self.data, self.at, self.base = b"", 0, to


def _http_length(source) -> int | None:
    length = None
    while (line := source.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            length = int(value)
    return length


def _hex(digest: str | None) -> str | None:
    return base64.b32decode(digest[5:]).hex() if digest and digest.startswith("sha1:") else None


class WarcSource(DataSource):
    """Options: ``path``; ``payload`` = full, checked (compared with its digest, not returned) or none; ``archive_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "full"))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("archive_bytes", ARCHIVE_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def planned(pages: DataFrame) -> DataFrame:
    """Rows for the writer: of equal payloads of at least REVISIT_BYTES bytes, the largest page_id is the response.

    Equal means equal by SHA-256 and length. Only digests travel to the group totals, and the totals of groups that have
    copies are settled before the join back, so Spark may split a digest that a third of all pages share. Null html is an
    empty payload. Rows with the winning page_id itself, repeated or not, are responses; a null page_id wins only if its group
    has no other, in which case all its rows are responses.
    """
    rows = typed(pages, page_id="long", url="string", html="string").select(
        "page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("same"), F.length("payload").cast("long").alias("length"))
    groups = settled(
        rows.filter(F.col("length") >= REVISIT_BYTES).groupBy("same").agg(F.max("page_id").alias("winner"), F.count("*").alias("n"))
        .filter("n > 1 and winner is not null").select("same", "winner"))
    return rows.join(groups, "same", "left").select(
        "page_id", "url", "payload", "digest", "length",
        F.when(~F.col("winner").eqNullSafe(F.col("page_id")), F.col("winner")).alias("refers_to"),
        (F.col("winner").isNotNull() & ~F.col("winner").eqNullSafe(F.col("page_id"))).alias("revisit"))


def write_warc(pages: DataFrame, folder: str) -> None:
    register(pages.sparkSession)
    planned(pages).write.format("warc").mode("append").option("path", folder).save()


def read_warc(spark: SparkSession, folder: str, payload: str = "full") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", folder).option("payload", payload).load()


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive the pages in the shared folder, read them back with payloads checked, one row per record."""
    spark = pages.sparkSession
    folder = shared_folder(spark)
    write_warc(pages, folder)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) as bigint)")
    got = read_warc(spark, folder, "checked").filter(F.col("record_type").isin("response", "revisit"))
    return got.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
