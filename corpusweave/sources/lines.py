"""Export the non-null values of whole datasets as lines of text."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)

Splits = Mapping[str, DataFrame]


def _as_line(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.BooleanType):
        return F.initcap(F.col(field.name).cast("string"))
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(field.name)
    return F.col(field.name).cast("string")


def text_lines(datasets: Mapping[str, Callable[[], Splits]]) -> DataFrame:
    """``dataset, split, column_name, column_no, line`` of all non-null values.

    Every split is scanned once; inside a task of its scan the lines come column by column,
    in row order.  A dataset that cannot be loaded is logged and skipped.
    """
    parts = []
    for dataset, load in datasets.items():
        try:
            splits = load()
        except Exception as error:
            log.error("skipping dataset %s: %s", dataset, error)
            continue
        for split, df in splits.items():
            cells = [
                F.struct(
                    F.lit(field.name).alias("column_name"),
                    F.lit(number).alias("column_no"),
                    _as_line(field).alias("line"),
                )
                for number, field in enumerate(df.schema.fields)
            ]
            rows = df.select(F.monotonically_increasing_id().alias("_row"), F.array(*cells).alias("_cells"))
            lines = rows.select("_row", F.inline("_cells")).where("line is not null")
            parts.append(
                lines.sortWithinPartitions("column_no", "_row").select(
                    F.lit(dataset).alias("dataset"),
                    F.lit(split).alias("split"),
                    "column_name",
                    "column_no",
                    "line",
                )
            )
    if not parts:
        raise ValueError("no dataset could be loaded")
    return reduce(DataFrame.unionByName, parts)


def with_file_number(lines: DataFrame, max_bytes: int) -> DataFrame:
    """Number the file each line goes to: ``part`` (the task) and ``file_no`` inside it.

    A file is closed when the next line, with its line break, would exceed ``max_bytes``;
    a single longer line gets a file of its own.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_no, used, at = 0, 0, 0
        for batch in batches:
            sizes = pc.add(pc.binary_length(batch["line"]), 1).to_pylist()
            files = []
            for size in sizes:
                if used and used + size > max_bytes:
                    file_no, used = file_no + 1, 0
                used += size
                files.append(file_no)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["line"],
                    batch["part"],
                    pa.array(files, pa.int64()),
                    pa.array(range(at, at + len(files)), pa.int64()),
                ],
                names=["line", "part", "file_no", "line_no"],
            )
            at += len(files)

    numbered = lines.select("line", F.spark_partition_id().alias("part"))
    return numbered.mapInArrow(place, "line string, part int, file_no bigint, line_no bigint")


def export_text_lines(lines: DataFrame, folder: str, max_bytes: int = -1) -> None:
    """Write lines as text files, rolled at ``max_bytes`` when that is positive."""
    if max_bytes <= 0:
        lines.select("line").write.text(folder)
        return
    placed = with_file_number(lines, max_bytes)
    placed.sortWithinPartitions("part", "file_no", "line_no").select(
        "line", "part", "file_no"
    ).write.partitionBy("part", "file_no").text(folder)
