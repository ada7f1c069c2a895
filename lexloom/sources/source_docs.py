"""Header-delimited documents: a Python data source and a text sink.

A file is read in byte ranges. A range reads the documents whose header starts in it, the last one to
its end, so large files are read in parallel; ``doc_ord`` is the header's byte offset, which orders
the documents of a file. Reading streams: a task holds one document at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexloom.schemas import DOCUMENTS

RANGE_BYTES = 128 << 20
#: An opening tag, an inner tag and two closing ones are at least this long.
SHORTEST_HEADER = 22
_LOCATION, _DATE = re.compile(r"<location>(.*?)</location>"), re.compile(r"<date>(.*?)</date>")
_OPTIONAL = (re.compile(r"<encoding>.*?</encoding>"), re.compile(r'<languages(?: ls-version="[\d.]+")?>.*?</languages>'))


def is_header(line: str | bytes) -> bool:
    a, b = ("<source><", "></source>") if isinstance(line, str) else (b"<source><", b"></source>")
    line = line.rstrip("\r\n" if isinstance(line, str) else b"\r\n")
    return len(line) >= SHORTEST_HEADER and line.startswith(a) and line.endswith(b)


def is_header_column(line: Column) -> Column:
    return (F.length(line) >= SHORTEST_HEADER) & line.rlike("^<source><.*></source>$")


def parse_header(line: str) -> tuple[str | None, str | None, list[str]] | None:
    """location, date, further tags; None if it has neither location nor date."""
    line = line.rstrip("\r\n")
    place, day = _LOCATION.search(line), _DATE.search(line)
    if place is None and day is None:
        return None
    inner = line.removeprefix("<source>").removesuffix("</source>")
    for m in (_LOCATION, _DATE):
        inner = m.sub("", inner, count=1)
    extra = []
    if len(inner) >= 5:
        for pattern in _OPTIONAL:
            if m := pattern.search(inner):
                extra.append(m.group())
                inner = inner[: m.start()] + inner[m.end() :]
        extra += [inner] if inner else []
    return place and place[1], day and day[1], extra


def header_text(location: str | None, date: str | None, extra: list[str] = ()) -> str:
    return f"<source><location>{location or ''}</location><date>{date or ''}</date>{''.join(extra)}</source>\n"


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def expand(path: str, suffixes: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """Files of a path, folder or pattern with their sizes, sorted."""
    import glob

    from pyarrow import fs

    names = sorted(glob.glob(path)) if any(c in path for c in "*?[") else [path]
    out = []
    for name in names:
        system, inner = fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.Directory:
            files = [f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        elif info.type == fs.FileType.NotFound:
            raise FileNotFoundError(name)
        else:
            files = [info]
        prefix = name[: name.index("://") + 3] if "://" in name else ""
        out += [(prefix + f.path if prefix and not f.path.startswith(prefix) else f.path, f.size) for f in sorted(files, key=lambda f: f.path)]
    return out


def open_stream(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def _lines(stream, at: int, block: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Offsets and lines (with their breaks) from byte ``at`` on."""
    stream.seek(at)
    rest = b""
    while chunk := stream.read(block):
        parts = (rest + chunk).split(b"\n")
        rest = parts.pop()
        for p in parts:
            yield at, p + b"\n"
            at += len(p) + 1
    if rest:
        yield at, rest


def read_range(path: str, start: int, stop: int, encoding: str = "utf-8", content: bool = True) -> Iterator[tuple]:
    """Documents whose header starts in ``start <= offset < stop``."""
    with open_stream(path) as stream:
        first = start
        if start:  # a line that starts in the range: the one after the break before it
            stream.seek(start - 1)
            first = next((at + len(line) for at, line in _lines(stream, start - 1)), stop)
        meta, begin, body, end = None, None, [], first
        for at, line in _lines(stream, first):
            if is_header(line):
                if meta is not None:
                    yield path, begin, *meta, b"".join(body).decode(encoding) if content else None, begin, at - begin
                if at >= stop:
                    return
                # bytes before a file's first header belong to the first document's extent
                begin = 0 if begin is None and not start else at
                meta, body = parse_header(line.decode(encoding)), []
            elif meta is not None and content:
                body.append(line)
            elif meta is None and at >= stop:
                return
            end = at + len(line)
        if meta is not None:
            yield path, begin, *meta, b"".join(body).decode(encoding) if content else None, begin, end - begin


class SourceDocsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.encoding = options.get("encoding", "utf-8")
        self.content = options.get("includeContent", "true").lower() == "true"
        self.step = int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self):
        return [_Range(p, a, min(size, a + self.step)) for p, size in expand(self.path) for a in range(0, max(1, size), self.step)]

    def read(self, partition):
        yield from read_range(partition.path, partition.start, partition.stop, self.encoding, self.content)


class SourceDocs(DataSource):
    """``spark.read.format("source_docs").load(path)``; options encoding, includeContent, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "source_docs"

    def schema(self):
        return DOCUMENTS

    def reader(self, schema) -> SourceDocsReader:
        return SourceDocsReader({k.lower() if k.lower() == "path" else {"includecontent": "includeContent", "rangebytes": "rangeBytes"}.get(k.lower(), k.lower()): v for k, v in self.options.items()})


def read_source(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(SourceDocs)
    return spark.read.format("source_docs").options(**options).load(path)


def source_text(location: Column, date: Column, content: Column, extra: Column | None = None) -> Column:
    """A document as it is written, without the line break at its end; a null content is the header
    alone."""
    empty = F.lit("")
    tail = F.array_join(F.coalesce(extra, F.array().cast("array<string>")), "") if extra is not None else empty
    head = F.concat(F.lit("<source><location>"), F.coalesce(location, empty), F.lit("</location><date>"), F.coalesce(date, empty), F.lit("</date>"), tail, F.lit("</source>"))
    body = F.concat(F.lit("\n"), F.regexp_replace(content, r"\n\z", ""))
    return F.when(content.isNull(), head).otherwise(F.concat(head, body))


def write_source(df: DataFrame, path: str, order: list[str] | None = None, single: bool = False, partition_by: list[str] | None = None, mode: str = "error") -> None:
    """Documents in the order of ``order`` within each file; ``single`` makes one file."""
    order = order if order is not None else [c for c in ("path", "doc_ord") if c in df.columns]
    extra = F.col("extra") if "extra" in df.columns else None
    keys = partition_by or []
    df = df.repartition(1) if single else (df.repartitionByRange(*order) if order and not keys else df)
    if order or keys:
        df = df.sortWithinPartitions(*keys, *order)
    df.select(*keys, source_text(F.col("location"), F.col("date"), F.col("content"), extra).alias("value")).write.mode(mode).partitionBy(*keys).text(path)
