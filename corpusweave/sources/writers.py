"""Writers, and the two-way writer for kept and dropped rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.plans.staging import stage
from corpusweave.sources.named_files import write_named_json

Writer = Callable[[DataFrame], None]


def write_json(
    df: DataFrame, folder: str, mode: str = "errorifexists", output_filename: str | None = None, **options
) -> None:
    """Gzipped JSON Lines; nulls are written, so that every row has every column.

    ``output_filename`` names the files, as ``write_named_json`` describes.
    """
    if output_filename:
        return write_named_json(df, folder, output_filename, mode, **options)
    options = {"compression": "gzip", "ignoreNullFields": False} | options
    df.write.mode(mode).options(**options).json(folder)


def write_parquet(
    df: DataFrame, folder: str, mode: str = "errorifexists", partition_by=(), **options
) -> None:
    df.write.mode(mode).options(**options).partitionBy(*partition_by).parquet(folder)


def write_snapshot(df: DataFrame, root: str, split: str = "train", mode: str = "errorifexists"):
    """One split of a dataset folder that ``read_snapshot`` understands."""
    write_parquet(df, f"{root.rstrip('/')}/{split}", mode)


def split_by_verdict(judged: DataFrame, staged: bool = False) -> tuple[DataFrame, DataFrame]:
    """Kept and dropped rows of a table with a ``keep`` column.

    ``staged`` writes the judged rows to the shared folder first; worth it when a verdict is
    expensive (a model call), not when the verdicts are built-in expressions.
    """
    judged = stage(judged, "judged") if staged else judged
    return judged.where("keep"), judged.where(~F.col("keep"))


def write_with_exclusions(
    judged: DataFrame, write_kept: Writer, write_dropped: Writer, staged: bool = False
) -> None:
    """Kept rows go to one writer, dropped rows, with their reasons, to the other."""
    kept, dropped = split_by_verdict(judged, staged)
    write_kept(kept.drop("keep", "drop_step", "drop_reason"))
    write_dropped(dropped.drop("keep"))
