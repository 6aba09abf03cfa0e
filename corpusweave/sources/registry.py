"""Readers and writers built from ``{type, kwargs}`` blocks of a job configuration."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession

from corpusweave.sources import readers, writers
from corpusweave.sources.columns import TextColumns

# Option names under which a configuration may give the location.
READ_LOCATIONS = ("data_folder", "path", "dataset")
WRITE_LOCATION = "output_folder"
# Options that only say how one machine goes about it, and change no row.
WITHOUT_EFFECT = {"shuffle_files", "batch_size"}
# Fixed value: an option that would change the result in a way that Spark's writers do not offer.
REFUSED = {"adapter"}


class Source(NamedTuple):
    read: Callable[[], DataFrame]
    text_key: str
    id_key: str
    use_adapter: bool

    def load(self) -> tuple[DataFrame, TextColumns]:
        """The table, with its key columns renamed when the adapter is on."""
        df = self.read()
        columns = TextColumns.of(df, self.text_key, self.id_key)
        return (columns.assign(df) if self.use_adapter else df), columns


class Sink(NamedTuple):
    write: Callable[[DataFrame], None]
    use_adapter: bool

    def save(self, df: DataFrame, columns: TextColumns | None = None) -> None:
        """Write, restoring the original columns when the adapter is on."""
        self.write(columns.restore(df) if self.use_adapter and columns else df)


def _snapshot(spark: SparkSession, path: str, dataset_options: dict | None = None, columns=None):
    return readers.read_snapshot(spark, path, (dataset_options or {}).get("split", "train"), columns)


READERS: dict[str, Callable[..., DataFrame]] = {
    "csv": readers.read_csv,
    "ipc": readers.read_ipc,
    "warc": readers.read_warc,
    "json": readers.read_json,
    "parquet": readers.read_parquet,
    "huggingface": _snapshot,
}
WRITERS: dict[str, Callable[..., None]] = {
    "json": writers.write_json,
    "parquet": writers.write_parquet,
    "huggingface": writers.write_snapshot,
}
ROLES = {"reader": READERS, "writer": WRITERS}


def create_io_object(
    spark: SparkSession, cfg: dict[str, Any], role: str, use_adapter: bool = False
) -> Source | Sink:
    """A source or sink; unknown roles and types raise ``ValueError`` naming the choices."""
    if role not in ROLES:
        raise ValueError(f"role must be one of {sorted(ROLES)}, got {role!r}")
    if cfg["type"] not in ROLES[role]:
        raise ValueError(f"unknown {role} type {cfg['type']!r}, choose from {list(ROLES[role])}")
    make = ROLES[role][cfg["type"]]
    kwargs = {k: v for k, v in (cfg.get("kwargs") or {}).items() if k not in WITHOUT_EFFECT}
    refused = sorted(k for k in REFUSED & kwargs.keys() if kwargs[k] is not None)
    if refused:
        raise ValueError(f"options that are not supported: {refused}")
    kwargs = {k: v for k, v in kwargs.items() if k not in REFUSED}
    if role == "writer":
        folder = kwargs.pop(WRITE_LOCATION)
        return Sink(lambda df: make(df, folder, **kwargs), use_adapter)
    text_key, id_key = kwargs.pop("text_key", "text"), kwargs.pop("id_key", "id")
    location = next((kwargs.pop(k) for k in READ_LOCATIONS if k in kwargs), None)
    if location is None:
        raise ValueError(f"a reader needs one of {READ_LOCATIONS}")
    limit, skip = kwargs.pop("limit", -1), kwargs.pop("skip", 0)

    def read() -> DataFrame:
        """Rows in the order of the scan, after ``skip`` and up to ``limit`` (-1: all)."""
        df = make(spark, location, **kwargs)
        df = df.offset(skip) if skip else df
        return df.limit(limit) if limit is not None and limit >= 0 else df

    return Source(read, text_key, id_key, use_adapter)


def create_reader_and_writer(
    spark: SparkSession, config: dict[str, Any], use_adapter_key: str = "use_column_info_adapter"
) -> tuple[Source, Sink]:
    use_adapter = config.get(use_adapter_key, False)
    return (
        create_io_object(spark, config["reader"], "reader", use_adapter),
        create_io_object(spark, config["writer"], "writer", use_adapter),
    )
