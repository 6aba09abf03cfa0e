"""Apply string functions to listed fields of a table."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.repair import fix_text
from corpusweave.plans.partitions import spread

ColumnFn = Callable[[Column], Column]

_MAP_FIELD = re.compile(r"""^(?P<name>\w+)\[['"](?P<key>.+)['"]\]$""")


def field(path: str) -> Column:
    """Column for ``name``, ``struct.name`` or ``map['key']``."""
    in_map = _MAP_FIELD.match(path)
    return F.col(in_map["name"])[in_map["key"]] if in_map else F.col(path)


def set_field(df: DataFrame, path: str, value: Column) -> DataFrame:
    """Replace the field at ``path``, leaving its neighbours alone."""
    in_map = _MAP_FIELD.match(path)
    if in_map:
        name, key = in_map["name"], in_map["key"]
        others = F.map_filter(name, lambda k, _: k != key)
        return df.withColumn(name, F.map_concat(others, F.create_map(F.lit(key), value)))
    if "." in path and path not in df.columns:
        name, inner = path.split(".", 1)
        return df.withColumn(name, F.col(name).withField(inner, value))
    return df.withColumn(path, value)


def format_fields(df: DataFrame, fn: ColumnFn, fields: str | Sequence[str] = "text") -> DataFrame:
    """Apply ``fn`` to each listed field in order, in place."""
    for path in [fields] if isinstance(fields, str) else fields:
        df = set_field(df, path, fn(field(path)))
    return df


def repair_fields(df: DataFrame, fields: str | Sequence[str] = "text", **switches) -> DataFrame:
    """Repair the listed text fields; ``switches`` are those of ``fix_text``."""
    return format_fields(spread(df), lambda text: fix_text(text, **switches), fields)


def map_rows(df: DataFrame, fn: Callable[..., DataFrame], **kwargs) -> DataFrame:
    """Row mapping with keyword arguments; ``fn`` adds or replaces columns."""
    return df.transform(fn, **kwargs)


def python_formatter(fn: Callable[[str], str]) -> ColumnFn:
    """Wrap a Python ``str -> str`` function as an Arrow-batched column function.

    Prefer a column function: it stays inside generated code.
    """

    @F.pandas_udf("string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(fn, na_action="ignore")

    return apply
