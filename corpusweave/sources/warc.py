"""Web archives, read record by record by their declared lengths.

A record ends where its ``Content-Length`` says, whatever its page holds.  An archive above
``SPLIT_BYTES`` is read by several tasks: a first pass, one task per archive, walks from record
to record without looking into them and notes where ranges of about that size begin; plain
archives are hopped through by seeking, compressed ones are inflated member by member.
"""

from __future__ import annotations

import codecs
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusweave.sources.arrow_ipc import file_system

CRLF2 = "\r\n\r\n"
#: Larger archives are read by several tasks.
SPLIT_BYTES = 256 << 20
#: Bytes read at a time, bytes of records handed on at a time, and the longest line of a head.
CHUNK, BATCH_BYTES, LINE_BYTES = 1 << 20, 8 << 20, 1 << 16
#: A record must fit a row.
MAX_BODY = (1 << 31) - (1 << 20)
PAGES = ("response", "conversion")
# Names of the encodings that Spark decodes itself.
LATIN = ("iso-8859-1", "latin-1", "latin1", "iso8859-1", "iso_8859-1")
UTF8 = ("utf-8", "utf8", "us-ascii", "ascii")
#: Bytes of a page in which its own declaration of the encoding is looked for.
DECLARED_WITHIN = 1024


class PlainBytes:
    """The bytes of an archive as they are; every position can begin a range."""

    def __init__(self, file, start: int):
        self.file, self.held, self.after = file, b"", start
        self.size = file.size()

    def start(self) -> int:
        return self.after - len(self.held)

    def more(self) -> bool:
        if self.after >= self.size:
            return False
        self.file.seek(self.after)
        new = self.file.read(min(CHUNK, self.size - self.after))
        self.held, self.after = self.held + new, self.after + len(new)
        return bool(new)

    def take(self, n: int) -> bytes:
        out, self.held = self.held[:n], self.held[n:]
        if len(out) < n and self.after < self.size:
            self.file.seek(self.after)
            new = self.file.read(min(n - len(out), self.size - self.after))
            out, self.after = out + new, self.after + len(new)
        return out

    def skip(self, n: int) -> int:
        inside = min(n, len(self.held))
        self.held = self.held[inside:]
        rest = min(n - inside, self.size - self.after)
        self.after += rest
        return inside + rest


class GzipBytes:
    """The inflated bytes of an archive; a range can begin where a gzip member does."""

    def __init__(self, file, start: int):
        self.file, self.held, self.packed, self.after = file, b"", b"", start
        self.size, self.inflate = file.size(), None

    def start(self) -> int | None:
        """Where the next member begins, if all before it has been taken."""
        while not self.held and self.inflate and not self.inflate.eof and self._inflate():
            pass
        between = self.inflate is None or self.inflate.eof
        return self.after - len(self.packed) if between and not self.held else None

    def _read(self) -> bool:
        if not self.packed and self.after < self.size:
            self.file.seek(self.after)
            self.packed = self.file.read(min(CHUNK, self.size - self.after))
            self.after += len(self.packed)
        return bool(self.packed)

    def _inflate(self) -> bool:
        """Some more of the present member; False at the end of the file."""
        if not self._read():
            return False
        self.held += self.inflate.decompress(self.packed, CHUNK)
        self.packed = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def more(self) -> bool:
        before = len(self.held)
        while len(self.held) == before:
            if self.inflate is None or self.inflate.eof:
                # Zeros may pad the file.
                self.packed = self.packed.lstrip(b"\0")
                while not self.packed and self._read():
                    self.packed = self.packed.lstrip(b"\0")
                if not self.packed:
                    return False
                self.inflate = zlib.decompressobj(31)
            if not self._inflate():
                return False
        return True

    def take(self, n: int) -> bytes:
        parts, got = [], 0
        while got < n and (self.held or self.more()):
            part, self.held = self.held[: n - got], self.held[n - got :]
            parts.append(part)
            got += len(part)
        return b"".join(parts)

    def skip(self, n: int) -> int:
        got = 0
        while got < n and (self.held or self.more()):
            part = min(n - got, len(self.held))
            self.held, got = self.held[part:], got + part
        return got


def open_archive(path: str, start: int = 0) -> PlainBytes | GzipBytes:
    # Spark writes local paths as they are, without the escapes of a URI.
    local = path.startswith("file:")
    fs, inside = file_system("/" + path.removeprefix("file:").lstrip("/") if local else path)
    file = fs.open_input_file(inside)
    file.seek(0)
    return (GzipBytes if file.read(2) == b"\x1f\x8b" else PlainBytes)(file, start)


def _line(source: PlainBytes | GzipBytes) -> bytes:
    """The next line with its end; of a longer line the first ``LINE_BYTES``."""
    while (at := source.held.find(b"\n")) < 0 and len(source.held) < LINE_BYTES and source.more():
        pass
    return source.take(at + 1 if 0 <= at < LINE_BYTES else LINE_BYTES)


def records(source: PlainBytes | GzipBytes, end: int | None = None) -> Iterator[tuple[bytes, int, int | None]]:
    """``head, length, at`` of the records that begin before ``end``; the caller takes or skips
    the body before it asks for the next one.  ``at`` is where a range may begin with it.

    Between records, lines that begin no record are passed over: blank ones, and whatever
    follows a record that is longer than declared.
    """
    while True:
        at = source.start()
        if end is not None and at is not None and at >= end:
            return
        line = _line(source)
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        head = [line]
        while (line := _line(source)).strip():
            head.append(line)
        head = b"".join(head)
        declared = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
        yield head, int(declared[1]) if declared else 0, at


def range_starts(path: str, split_bytes: int) -> list[int]:
    """Where the ranges of an archive begin: at records, about ``split_bytes`` apart."""
    source, starts = open_archive(path), [0]
    for _, length, at in records(source):
        if at is not None and at >= starts[-1] + split_bytes:
            starts.append(at)
        source.skip(length)
    return starts


@dataclass
class ArchiveRange(InputPartition):
    path: str
    start: int
    end: int | None


SCHEMA = "head string, body binary, length bigint"


class WarcReader(DataSourceReader):
    def __init__(self, ranges: list):
        self.ranges = ranges

    def partitions(self) -> list[InputPartition]:
        return [ArchiveRange(*r) for r in self.ranges] or [ArchiveRange("", 0, 0)]

    def read(self, partition: ArchiveRange) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("head", pa.string()), ("body", pa.binary()), ("length", pa.int64())])
        rows: list[tuple] = []
        held = 0
        if not partition.path:
            return
        source = open_archive(partition.path, partition.start)
        for head, length, _ in records(source, partition.end):
            kind = re.search(rb"(?im)^warc-type:[ \t]*([a-z]+)", head)
            if not kind or kind[1].lower().decode() not in PAGES:
                source.skip(length)
                continue
            if length > MAX_BODY:
                source.skip(length)
                body = b""
            else:
                body = source.take(length)
            rows.append((head.decode("utf-8", "replace"), body, length))
            held += len(head) + len(body)
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)


class WarcSource(DataSource):
    """``spark.read.format("warc_records").option("ranges", json).load()``."""

    @classmethod
    def name(cls) -> str:
        return "warc_records"

    def schema(self):
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(json.loads(self.options["ranges"]))


def archive_ranges(spark: SparkSession, path, split_bytes: int = SPLIT_BYTES) -> list[tuple]:
    """``path, start, end`` of the ranges that one task each reads; ``end`` is None at the end."""
    # Spark lists the files, with its globs and folders; their content is not read here.
    files = spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").collect()
    large = [(f["path"],) for f in files if f["length"] > split_bytes]
    starts = {}
    if large:
        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name in batch["path"].to_pylist():
                    found = range_starts(name, split_bytes)
                    names = [name] * len(found)
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(found, pa.int64())], names=["path", "start"])

        paths = spark.createDataFrame(large, "path string").repartition(len(large), "path")
        for r in paths.mapInArrow(walk, "path string, start bigint").collect():
            starts.setdefault(r["path"], []).append(r["start"])
    ranges = []
    for f in files:
        own = sorted(starts.get(f["path"], [0]))
        ranges += [(f["path"], a, b) for a, b in zip(own, [*own[1:], None])]
    return ranges


def _header(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*?)[ \t]*$", 1), F.lit(""))


def _other_charset(body: Column, charset: Column) -> Column:
    """Bytes in any encoding that Python knows; null where the name is unknown."""

    @F.pandas_udf("string")
    def decode(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bodies, names in pairs:
            out = []
            for raw, name in zip(bodies, names):
                try:
                    out.append(raw.decode(codecs.lookup(name).name, "replace") if name else None)
                except (LookupError, TypeError, AttributeError):
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return decode(body, charset)


def read_warc(spark: SparkSession, path, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of web archives as ``id, url, date, text, charset, lossy, truncated``.

    Archives (plain or gzipped, told apart by their first bytes) of any version; only
    ``response`` and ``conversion`` records hold page text, and of a response the HTTP head is
    dropped.  Files are read through Arrow's file systems (local, HDFS, object stores); a
    gzipped archive is split between tasks if its records are members of their own.

    ``charset`` is what the server or else the page declares; without either, and with an
    unknown name, the text is read as UTF-8.  ``lossy`` marks a text in which bytes could not
    be decoded and became U+FFFD.  ``truncated`` marks a record that is shorter than its
    declared length because the archive ends early, or too long for a row (its text is empty).
    """
    spark.dataSource.register(WarcSource)
    ranges = json.dumps(archive_ranges(spark, path, split_bytes))
    raw = spark.read.format("warc_records").option("ranges", ranges).load()
    records = raw.select(
        F.lower(_header(F.col("head"), "WARC-Type")).alias("type"),
        _header(F.col("head"), "WARC-Record-ID").alias("id"),
        _header(F.col("head"), "WARC-Target-URI").alias("url"),
        _header(F.col("head"), "WARC-Date").alias("date"),
        "body",
        "length",
    )
    response = F.col("type") == "response"
    pages = records.withColumn(
        "http_head", F.when(response, F.substring_index(F.col("body").cast("string"), CRLF2, 1))
    )
    payload = F.when(
        response,
        F.substring(
            F.col("body"),
            F.octet_length("http_head") + F.lit(len(CRLF2) + 1),
            F.octet_length("body"),
        ),
    ).otherwise(F.col("body"))

    def declared(text: Column) -> Column:
        name = F.regexp_extract(text, r"(?i)charset=[\"\']?([\w:.-]+)", 1)
        return F.nullif(F.lower(name), F.lit(""))

    start = F.decode(F.substring("payload", 1, DECLARED_WITHIN), "ISO-8859-1")
    charset = F.coalesce(
        declared(F.col("http_head")), F.when(response, declared(F.regexp_extract(start, r"(?i)<meta[^>]*charset[^>]*>", 0)))
    )
    pages = pages.withColumn("payload", payload).withColumn("charset", charset)
    own = F.coalesce("charset", F.lit("utf-8"))
    strange = ~own.isin(*LATIN, *UTF8)
    valid = F.make_valid_utf8(F.col("payload").cast("string"))
    text = (
        F.when(own.isin(*LATIN), F.decode("payload", "ISO-8859-1"))
        .when(strange, F.coalesce("other", valid))
        .otherwise(valid)
    )
    # Only rows in other encodings reach Python; the rest travel as nulls.
    other = _other_charset(F.when(strange, F.col("payload")), F.when(strange, own))
    added = F.octet_length(F.col("payload").cast("string")) > 0
    bad = F.contains("text", F.lit("\ufffd")) & ~F.coalesce(
        F.contains(F.col("payload").cast("string"), F.lit("\ufffd")) & F.is_valid_utf8(F.col("payload").cast("string")),
        F.lit(False),
    )
    return (
        pages.withColumn("other", other)
        .withColumn("text", text)
        .select(
            "id", "url", "date", "text", "charset", (bad & added).alias("lossy"),
            (F.octet_length("body") < F.col("length")).alias("truncated"),
        )
    )
