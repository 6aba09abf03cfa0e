"""Readers: every one returns a DataFrame and leaves scheduling to Spark."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.operators.sampling import train_test_split
from corpusweave.sources.arrow_ipc import ArrowIpcSource
from corpusweave.sources.warc import read_warc

__all__ = [
    "load_splits",
    "read_csv",
    "read_ipc",
    "read_json",
    "read_parquet",
    "read_snapshot",
    "read_warc",
]


def read_csv(spark: SparkSession, path, schema=None, multi_line: bool | None = None, **options):
    """CSV with a header, doubled quotes and significant outer blanks.

    ``multi_line`` allows line breaks inside quoted fields, at the price of one task per
    file; without it files are split.  Unless given, a scan for lines with an open quotation
    mark finds out whether there are such fields.
    """
    if multi_line is None:
        quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
        multi_line = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    reader = spark.read.options(header=True, quote='"', escape='"', multiLine=multi_line)
    reader = reader.options(
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options
    )
    return (reader.schema(schema) if schema else reader).csv(path)


def read_json(spark: SparkSession, path, schema=None, **options) -> DataFrame:
    """JSON Lines, compressed or not.  Without a schema the input is read once more to infer it."""
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).json(path)


def read_parquet(spark: SparkSession, path, columns: Sequence[str] | None = None, **options):
    df = spark.read.options(**options).parquet(path)
    return df.select(*columns) if columns else df


def read_ipc(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Arrow IPC files, whole record batches at a time."""
    spark.dataSource.register(ArrowIpcSource)
    reader = spark.read.format(ArrowIpcSource.name())
    return (reader.schema(schema) if schema else reader).load(path)


_SNAPSHOT_FORMATS = {"parquet": read_parquet, "jsonl": read_json, "json": read_json, "csv": read_csv}


def _files(spark: SparkSession, folder: str) -> list[str]:
    """Paths below a folder, relative to it, listed without reading anything."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    inside = urlparse(folder).path.rstrip("/") + "/"
    return sorted(unquote(urlparse(f).path).partition(inside)[2] for f in listing.inputFiles())


def read_snapshot(
    spark: SparkSession, root: str, split: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """One split of a dataset stored as ``<root>/<split>/*.{parquet,jsonl,json,csv}``."""
    folder = f"{root.rstrip('/')}/{split}"
    suffixes = {f.removesuffix(".gz").rpartition(".")[2] for f in _files(spark, folder)}
    if len(suffixes) != 1 or not suffixes <= _SNAPSHOT_FORMATS.keys():
        raise ValueError(f"{folder} must hold files of one known format, found {sorted(suffixes)}")
    df = _SNAPSHOT_FORMATS[suffixes.pop()](spark, folder)
    return df.select(*columns) if columns else df


def load_splits(
    spark: SparkSession,
    path: str,
    test_size: float | None = None,
    key: str | None = None,
    seed: int = 42,
    schema=None,
    columns: Sequence[str] | None = None,
    multi_line: bool | None = None,
) -> dict[str, DataFrame]:
    """Load a dataset by its path suffix, as a dict of splits.

    ``jsonl``, ``json`` and ``gz`` mean JSON Lines, ``csv`` and ``parquet`` themselves; any
    other path is a snapshot folder with one sub-folder per split.  ``multi_line`` is that of
    ``read_csv``.  ``test_size`` splits
    ``train`` by the seeded hash of the unique ``key``, unless there is a ``test`` split.
    """
    if path.endswith(("jsonl", "json", "gz")):
        splits = {"train": read_json(spark, path, schema)}
    elif path.endswith("csv"):
        splits = {"train": read_csv(spark, path, schema, multi_line)}
    elif path.endswith("parquet"):
        splits = {"train": read_parquet(spark, path)}
    else:
        names = {f.partition("/")[0] for f in _files(spark, path)}
        splits = {name: read_snapshot(spark, path, name) for name in sorted(names)}
    if columns:
        splits = {name: df.select(*columns) for name, df in splits.items()}
    if test_size is not None and "train" in splits and "test" not in splits:
        if key is None:
            raise ValueError("splitting needs the name of a unique key column")
        train, test = train_test_split(splits["train"], key, test_size, seed)
        splits = {"train": train, "test": test}
    return splits
