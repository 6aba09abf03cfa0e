"""Arrow IPC files as a Spark data source."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

#: A larger file is read by several tasks, each taking a range of its record batches.
SPLIT_BYTES = 128 << 20


@dataclass
class BatchRange(InputPartition):
    """Share ``part`` of ``parts`` of the record batches of one file."""

    path: str
    part: int
    parts: int


def file_system(location: str) -> tuple[pafs.FileSystem, str]:
    """File system of a path or URI, and the path inside it."""
    uri = urlparse(location)
    if uri.scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(uri.path) if uri.scheme else location
    return pafs.FileSystem.from_uri(location)


def _files(location: str) -> list[pafs.FileInfo]:
    fs, path = file_system(location)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(location)
    found = [info]
    if info.type == pafs.FileType.Directory:
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
    return sorted(
        (f for f in found if f.is_file and not f.base_name.startswith(("_", "."))),
        key=lambda f: f.path,
    )


def _open(location: str, path: str) -> pa.ipc.RecordBatchFileReader:
    return pa.ipc.open_file(file_system(location)[0].open_input_file(path))


class ArrowIpcReader(DataSourceReader):
    def __init__(self, location: str):
        self.location = location

    def partitions(self) -> list[InputPartition]:
        ranges = []
        for f in _files(self.location):
            parts = max(1, -(-f.size // SPLIT_BYTES))
            ranges += [BatchRange(f.path, part, parts) for part in range(parts)]
        return ranges

    def read(self, partition: BatchRange) -> Iterator[pa.RecordBatch]:
        reader = _open(self.location, partition.path)
        n = reader.num_record_batches
        for i in range(
            n * partition.part // partition.parts, n * (partition.part + 1) // partition.parts
        ):
            yield reader.get_batch(i)


class ArrowIpcSource(DataSource):
    """``spark.read.format("arrow_ipc").load(file_or_folder)``."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self):
        files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no Arrow files in {self.options['path']}")
        return from_arrow_schema(_open(self.options["path"], files[0].path).schema)

    def reader(self, schema) -> DataSourceReader:
        return ArrowIpcReader(self.options["path"])
