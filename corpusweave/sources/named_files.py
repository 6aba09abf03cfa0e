"""JSON Lines files with names of one's own, such as ``result_${rank}``.

Tasks write into a folder beside the final files, one that readers pass over; once all have
succeeded, the files get their names in one go.  A failed or repeated task leaves nothing.
"""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from string import Template

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from corpusweave.sources.arrow_ipc import file_system

#: Digits of a file's number.
RANK_DIGITS = 5
MODES = ("append", "error", "errorifexists", "ignore", "overwrite")


@dataclass
class Written(WriterCommitMessage):
    """Temporary files of one task, each with what replaces the names' placeholders."""

    partition: int
    files: list[tuple[str, tuple[str, ...]]]


class NamedJsonWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.template = options["path"].rstrip("/"), options["filename"]
        self.fields = [f for f in options["fields"].split(",") if f]
        self.zipped, self.overwrite = options["compression"] == "gzip", overwrite
        self.unfinished = f"{self.folder}/_unfinished-{uuid.uuid4().hex}"

    def _place(self, location: str) -> tuple[pafs.FileSystem, str]:
        return file_system(location)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = self._place(self.unfinished)
        fs.create_dir(folder)
        files: list[tuple[str, tuple[str, ...]]] = []
        raw = out = None

        def close() -> None:
            if out is not None:
                out.close()
                raw.close()

        for batch in batches:
            lines = batch.column(0).to_pylist()
            values = zip(*[c.to_pylist() for c in batch.columns[1:]]) if self.fields else [()] * len(lines)
            for line, value in zip(lines, values):
                # Rows come sorted by these values, so each file is written in one piece.
                if not files or files[-1][1] != value:
                    close()
                    files.append((f"{folder}/{uuid.uuid4().hex}", value))
                    raw = fs.open_output_stream(files[-1][0])
                    out = gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) if self.zipped else raw
                out.write(line.encode() + b"\n")
        close()
        return Written(TaskContext.get().partitionId(), files)

    def names(self, messages: list[Written]) -> dict[str, str]:
        """Final name of every temporary file; tasks without rows get no number."""
        found: dict[str, str] = {}
        told = sorted((m for m in messages if m and m.files), key=lambda m: m.partition)
        for rank, message in enumerate(told):
            for path, values in message.files:
                known = dict(zip(self.fields, values)) | {"rank": f"{rank:0{RANK_DIGITS}d}"}
                name = Template(self.template).substitute(known)
                if self.zipped and not name.endswith(".gz"):
                    name += ".gz"
                if name in found.values():
                    raise ValueError(f"two files would be named {name!r}")
                found[path] = name
        return found

    def commit(self, messages: list[Written]) -> None:
        fs, folder = self._place(self.folder)
        names = self.names(messages)
        fs.create_dir(folder)
        unfinished = self._place(self.unfinished)[1]
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(folder)):
                if old.path.rstrip("/") != unfinished:
                    (fs.delete_file if old.is_file else fs.delete_dir)(old.path)
        for path, name in names.items():
            final = f"{folder}/{name}"
            fs.create_dir(final.rsplit("/", 1)[0])
            fs.move(path, final)
        self._remove(fs, unfinished)

    def abort(self, messages: list[Written]) -> None:
        fs, unfinished = self._place(self.unfinished)
        self._remove(fs, unfinished)

    @staticmethod
    def _remove(fs: pafs.FileSystem, folder: str) -> None:
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)


class NamedJsonSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_json"

    def schema(self):
        raise NotImplementedError("read the files as JSON")

    def writer(self, schema, overwrite: bool) -> NamedJsonWriter:
        return NamedJsonWriter(dict(self.options), overwrite)


def write_named_json(
    df: DataFrame, folder: str, filename: str, mode: str = "errorifexists", compression: str | None = "gzip"
) -> None:
    """JSON Lines in files named by ``filename``, with nulls written.

    ``${rank}`` is the five-digit number of a task's file, from 00000 without gaps; ``${column}``
    the text of a column (null: empty), whose rows then share files of their own.  Without a
    rank, all rows of a name are brought together in one file.  ``.gz`` is added when missing.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    if compression not in ("gzip", "none", None):
        raise ValueError(f"compression must be gzip or none, got {compression!r}")
    fields = sorted({a or b for a, b in re.findall(r"\$(?:\{(\w+)\}|(\w+))", filename)} - {"rank"})
    unknown = sorted(set(fields) - set(df.columns))
    if unknown or "/../" in f"/{filename}/":
        raise ValueError(f"no columns for the placeholders {unknown} of {filename!r}")
    fs, place = file_system(folder)
    exists = fs.get_file_info(place).type != pafs.FileType.NotFound
    if exists and mode in ("error", "errorifexists"):
        raise FileExistsError(folder)
    if exists and mode == "ignore":
        return
    if "rank" not in re.findall(r"\$\{?(\w+)", filename):
        df = df.repartition(*fields) if fields else df.coalesce(1)
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    values = [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")).alias(f"_v{i}") for i, f in enumerate(fields)]
    rows = df.select(line.alias("line"), *values)
    if fields:
        rows = rows.sortWithinPartitions(*[f"_v{i}" for i in range(len(fields))])
    df.sparkSession.dataSource.register(NamedJsonSource)
    options = {"path": folder, "filename": filename, "fields": ",".join(fields), "compression": compression or "none"}
    target = "overwrite" if mode == "overwrite" else "append"
    rows.write.format(NamedJsonSource.name()).options(**options).mode(target).save()
