"""Tokenizer statistics: computing, adding, comparing and formatting them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusweave.operators.tokenizers import Tokenizer
from corpusweave.plans.partitions import spread

# Names of the statistics, in report order.
STATISTICS = (
    "total_unk_tokens",
    "overall_sentences",
    "total_sentences_with_unk",
    "overall_tokens",
    "overall_chars",
)
# Fixed value: shown where a statistic is missing.
MISSING = "—"


def tokenizer_stats(
    df: DataFrame | Mapping[str, DataFrame],
    columns: Sequence[str],
    tokenizers: Mapping[str, Tokenizer],
) -> DataFrame:
    """One row of counters per tokenizer; every non-null cell of ``columns`` is a sentence.

    All tokenizers run in one pass and only counters are shuffled.  Works on a stream, in
    complete mode.
    """
    if not isinstance(df, DataFrame):
        raise ValueError(f"choose one split, available are {sorted(df)}")
    if not df.isStreaming:
        df = spread(df.select(*columns))
    texts = df.select(F.explode(F.array(*columns)).alias("text")).where("text IS NOT NULL")
    names = list(tokenizers)
    encoded = texts.select(
        F.char_length("text").alias("chars"),
        *[tokenizers[name].encode(F.col("text")).alias(f"ids{i}") for i, name in enumerate(names)],
    )
    sums = []
    for i, name in enumerate(names):
        unk_id = tokenizers[name].unk_id
        unk_id = -1 if unk_id is None else unk_id
        unk = F.size(F.filter(f"ids{i}", lambda t: t == unk_id))  # noqa: B023
        sums.append(
            F.struct(
                F.coalesce(F.sum(unk), F.lit(0)).alias(STATISTICS[0]),
                F.count("*").alias(STATISTICS[1]),
                F.count_if(unk > 0).alias(STATISTICS[2]),
                F.coalesce(F.sum(F.size(f"ids{i}")), F.lit(0)).alias(STATISTICS[3]),
                F.coalesce(F.sum("chars"), F.lit(0)).alias(STATISTICS[4]),
            ).alias(f"t{i}")
        )
    rows = F.array(
        *[F.struct(F.lit(n).alias("tokenizer"), f"t{i}.*") for i, n in enumerate(names)]
    )
    return encoded.agg(*sums).select(F.inline(rows))


def merge_stats(*parts: DataFrame, key: str = "tokenizer") -> DataFrame:
    """Add records of the same key; parts with different statistics raise ``ValueError``."""
    names = parts[0].columns
    for part in parts[1:]:
        if set(part.columns) != set(names):
            raise ValueError(f"statistics differ: {sorted(names)} and {sorted(part.columns)}")
    values = [n for n in names if n != key]
    stacked = reduce(DataFrame.unionByName, parts)
    return stacked.groupBy(key).agg(*[F.sum(v).alias(v) for v in values])


def stats_to_json(stats: DataFrame, key: str = "tokenizer") -> DataFrame:
    values = [c for c in stats.columns if c != key]
    return stats.select(key, F.to_json(F.struct(*values)).alias("stats"))


def stats_from_json(
    rows: DataFrame, names: Sequence[str] = STATISTICS, key: str = "tokenizer"
) -> DataFrame:
    schema = ", ".join(f"{n} bigint" for n in names)
    return rows.select(key, F.from_json("stats", schema).alias("s")).select(key, "s.*")


def format_key(key: Column) -> Column:
    """``overall_chars`` becomes ``Overall Chars``."""
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def format_value(value: Column, data_type: T.DataType) -> Column:
    """Thousands separators, two decimals for fractions, brackets around lists."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.format_number(value, 2)
    if isinstance(data_type, T.IntegralType):
        return F.format_number(value, 0)
    if isinstance(data_type, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(value.cast("array<string>"), ", "), F.lit("]"))
    return value.cast("string")


def compare_stats(
    stats: DataFrame, names: Sequence[str], key: str = "tokenizer"
) -> DataFrame:
    """``position, parameter`` and a formatted column per name; a missing value shows a dash."""
    fields = [f for f in stats.schema.fields if f.name != key]
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("name"),
                format_value(F.col(f.name), f.dataType).alias("value"),
            )
            for i, f in enumerate(fields)
        ]
    )
    long = stats.select(key, F.inline(rows))
    wide = long.groupBy("position", "name").pivot(key, list(names)).agg(F.first("value"))
    return wide.select(
        "position",
        format_key(F.col("name")).alias("parameter"),
        *[F.coalesce(F.col(f"`{n}`"), F.lit(MISSING)).alias(n) for n in names],
    )


def mean_generated_length(df: DataFrame, ids_col: str, pad_id: int) -> DataFrame:
    """Mean number of non-padding ids per row."""
    length = F.size(F.filter(ids_col, lambda t: t != pad_id))
    return df.agg(F.avg(length).alias("gen_len"))


def unmask_labels(df: DataFrame, labels_col: str, pad_id: int, ignored: int = -100) -> DataFrame:
    """Replace ignored label positions by padding."""
    return df.withColumn(
        labels_col,
        F.transform(labels_col, lambda t: F.when(t == ignored, F.lit(pad_id)).otherwise(t)),
    )
