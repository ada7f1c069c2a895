"""Web archives: a Python data source and sink with their own framing of records.

Files are read one a task, as streams; gzip members are inflated as they come. HTTP headers stay in
the content. Written records are version 1.1, uncompressed, with SHA-1 digests of block and payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from lexloom.schemas import WARC
from lexloom.sources.source_docs import expand, open_stream

UNKNOWN_SOURCE = "unknown source"
DEFAULT_TYPES = ("response", "conversion")


class _Inflated:
    """A byte stream, inflated member by member if it is gzip. ``at`` is the place in the raw file of
    the member that is being read, or of the next byte of a plain file."""

    def __init__(self, stream, block: int = 1 << 20):
        self.stream, self.block, self.buffer, self.raw = stream, block, b"", b""
        self.base = 0  # plain bytes taken so far
        self.raw = stream.read(block)
        self.gzip = self.raw[:2] == b"\x1f\x8b"
        self.engine = zlib.decompressobj(31) if self.gzip else None
        if not self.gzip:
            self.buffer, self.raw = self.raw, b""

    def _more(self) -> bool:
        if not self.gzip:
            chunk = self.stream.read(self.block)
            self.buffer += chunk
            return bool(chunk)
        if not self.raw:
            self.raw = self.stream.read(self.block)
            if not self.raw:
                return False
        self.buffer += self.engine.decompress(self.raw)
        if self.engine.eof:
            self.raw = self.engine.unused_data
            self.engine = zlib.decompressobj(31)
        else:
            self.raw = b""
        return True

    def line(self) -> bytes:
        while (end := self.buffer.find(b"\n")) < 0:
            if not self._more():
                return self.take(len(self.buffer))
        return self.take(end + 1)

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        self.base += len(out)
        return out


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers, block, offset and length (both in uncompressed bytes) of all records."""
    source = _Inflated(stream)
    while True:
        start = source.base
        line = source.line()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue  # breaks between records
        headers: dict[str, str] = {}
        last = None
        while (line := source.line()).strip():
            if line[:1] in b" \t" and last:
                headers[last] += " " + line.strip().decode("utf-8", "replace")
                continue
            key, _, value = line.decode("utf-8", "replace").partition(":")
            last = key.strip()
            headers[last] = value.strip()
        lower = {k.lower(): v for k, v in headers.items()}
        block = source.take(int(lower.get("content-length", "0")))
        end = source.base
        source.take(4)
        yield headers, block, start, end - start


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [_File(p) for p, _ in expand(self.options["path"])]

    def read(self, partition):
        wanted = self.options.get("recordtypes", ",".join(DEFAULT_TYPES))
        types = {t.strip() for t in wanted.split(",") if t.strip()}
        content = self.options.get("includecontent", "true").lower() == "true"
        encoding = self.options.get("encoding", "utf-8")
        with open_stream(partition.path) as stream:
            for headers, block, start, length in read_records(stream):
                lower = {k.lower(): v for k, v in headers.items()}
                kind = lower.get("warc-type")
                if types and kind not in types:
                    continue
                day = lower.get("warc-date")
                text = block.decode(encoding, "replace") if content else None
                yield partition.path, start, kind, lower.get("warc-target-uri", UNKNOWN_SOURCE), day[:10] if day else None, lower.get("warc-record-id"), headers, text, start, length


def record_bytes(location: str | None, date: str | None, content: bytes, record_type: str = "conversion", refers_to: str | None = None) -> bytes:
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%d")
    digest = "sha1:" + base64.b32encode(hashlib.sha1(content).digest()).decode()
    head = {
        "WARC-Type": record_type,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Target-URI": location or UNKNOWN_SOURCE,
        "WARC-Date": f"{date}T00:00:00Z",
        "WARC-Refers-To": refers_to,
        "WARC-Payload-Digest": digest,
        "WARC-Block-Digest": digest,
        "Content-Type": "text/plain",
        "Content-Length": str(len(content)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + content + b"\r\n\r\n"


class _Written(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class WarcWriter(DataSourceWriter):
    """One file a task in a folder; null contents are skipped unless option writeEmpty is true."""

    def __init__(self, options: dict):
        self.options = options

    def write(self, rows):
        import os

        from pyspark import TaskContext

        folder = self.options["path"].removeprefix("file://")
        os.makedirs(folder, exist_ok=True)
        name = os.path.join(folder, f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc")
        kind, empty = self.options.get("recordtype", "conversion"), self.options.get("writeempty", "false").lower() == "true"
        with open(name, "wb") as out:
            for r in rows:
                r = r.asDict()
                if r["content"] is None and not empty:
                    continue
                out.write(record_bytes(r["location"], r["date"], (r["content"] or "").encode(), kind, r.get("record_id")))
        return _Written(name)

    def abort(self, messages):
        import os

        for m in messages:
            if m is not None and m.path:
                os.remove(m.path)


class Warc(DataSource):
    """``spark.read.format("warc_records")``; options recordTypes, includeContent, encoding."""

    @classmethod
    def name(cls) -> str:
        return "warc_records"

    def schema(self):
        return WARC

    def reader(self, schema) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()})


def read_warc(spark: SparkSession, path: str, record_types: tuple[str, ...] = DEFAULT_TYPES, **options) -> DataFrame:
    """Records of the given types, all with an empty tuple; a missing date is today."""
    spark.dataSource.register(Warc)
    df = spark.read.format("warc_records").options(recordTypes=",".join(record_types), **options).load(path)
    return df.withColumn("date", F.coalesce("date", F.date_format(F.current_date(), "yyyy-MM-dd")))


def write_warc(df: DataFrame, path: str, write_empty: bool = False, single: bool = False, **options) -> None:
    df.sparkSession.dataSource.register(Warc)
    order = [c for c in ("path", "doc_ord") if c in df.columns]
    df = df.repartition(1) if single else df
    df = df.sortWithinPartitions(*order) if order else df
    df = df.select("location", "date", "content", *[c for c in ("record_id",) if c in df.columns])
    df.write.format("warc_records").options(writeEmpty=str(write_empty).lower(), **options).mode("append").save(path)
