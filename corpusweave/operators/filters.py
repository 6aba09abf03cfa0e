"""Row filters as verdicts: a keep flag plus the reason for dropping."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.text import word_count
from corpusweave.operators.formatting import field


class Verdict(NamedTuple):
    """``keep`` is never null; ``reason`` is null for kept rows and unreasoned drops."""

    keep: Column
    reason: Column


def _two(fields: Sequence[str]) -> tuple[Column, Column]:
    if len(fields) != 2:
        raise ValueError(f"exactly two fields are compared, got {len(fields)}")
    return field(fields[0]), field(fields[1])


def _verdict(keep: Column, *reasons: tuple[Column, str]) -> Verdict:
    """``reasons`` are tried in order; the first that holds drops the row."""
    reason = F.lit(None).cast("string")
    for condition, name in reversed(reasons):
        reason = F.when(condition, F.lit(name)).otherwise(reason)
    return Verdict(reason.isNull() & F.coalesce(keep, F.lit(False)), reason)


def length_ratio(
    fields: Sequence[str], ratio_threshold: float, calc_method: str = "chars"
) -> Verdict:
    """Keep pairs whose longer side is at most ``ratio_threshold`` times the shorter one."""
    first, second = _two(fields)
    measures = {"chars": F.char_length, "words": word_count}
    if calc_method not in measures:
        raise ValueError(f"calc_method must be one of {sorted(measures)}, got {calc_method!r}")
    n, m = measures[calc_method](first), measures[calc_method](second)
    return _verdict(
        F.greatest(n, m) / F.least(n, m) <= ratio_threshold,
        (first.isNull() | second.isNull(), "missing_text"),
        (F.least(n, m) == 0, "empty_text"),
    )


def regex_counter(fields: Sequence[str], pattern: str, unicode: bool = True) -> Verdict:
    """Keep pairs in which ``pattern`` matches the same multiset of strings on both sides.

    With one group the group is compared, with several all of them, as ``re.findall`` does.
    """
    first, second = _two(fields)
    groups = re.compile(pattern).groups
    rx = F.lit(f"(?U){pattern}" if unicode else pattern)

    def matches(text: Column) -> Column:
        if groups < 2:
            found = F.regexp_extract_all(text, rx, F.lit(groups))
        else:
            parts = [
                F.regexp_extract_all(text, rx, F.lit(g)).alias(f"g{g}")
                for g in range(1, groups + 1)
            ]
            found = F.arrays_zip(*parts)
        return F.sort_array(found)

    return _verdict(
        matches(first) == matches(second),
        (first.isNull() | second.isNull(), "missing_text"),
    )


def with_verdict(df: DataFrame, verdict: Verdict) -> DataFrame:
    """Add ``keep`` and ``drop_reason``."""
    return df.withColumns({"keep": verdict.keep, "drop_reason": verdict.reason})


def apply_filters(df: DataFrame, steps: Mapping[str, Verdict]) -> DataFrame:
    """Run named verdicts in order; a row is charged to the first step that drops it.

    Adds ``keep``, ``drop_step`` and ``drop_reason``.  A step sees nulls in place of rows
    that an earlier step has dropped, so that a model in a later step does not work on them.
    """
    given = [F.col(f"`{c}`") for c in df.columns]
    judged = df.withColumns(
        {"_given": F.struct(*given), "_step": F.lit(None).cast("string"), "_why": F.lit(None).cast("string")}
    )
    for i, (name, verdict) in enumerate(steps.items()):
        if i:
            alive = F.col("_step").isNull()
            judged = judged.withColumns({c: F.when(alive, F.col(f"`{c}`")) for c in df.columns})
        judged = judged.withColumns({"_keep": verdict.keep, "_reason": verdict.reason})
        first = F.col("_step").isNull() & ~F.col("_keep")
        judged = judged.withColumns(
            {
                "_step": F.when(first, F.lit(name)).otherwise(F.col("_step")),
                "_why": F.when(first, F.col("_reason")).otherwise(F.col("_why")),
            }
        )
    added = {"keep": F.col("_step").isNull(), "drop_step": F.col("_step"), "drop_reason": F.col("_why")}
    names = [c for c in df.columns if c not in added]
    return judged.select(
        *[F.col("_given").getField(c).alias(c) for c in names],
        *[column.alias(name) for name, column in added.items()],
    )


def filter_summary(judged: DataFrame, steps: Sequence[str]) -> DataFrame:
    """Per step: rows that reached it, rows it forwarded and rows it dropped.

    One aggregation with a counter per step, so nothing but counters is shuffled.
    """
    position = F.lit(len(steps))
    for i, name in reversed(list(enumerate(steps))):
        position = F.when(F.col("drop_step") == name, F.lit(i)).otherwise(position)
    counters = judged.select(position.alias("_at")).agg(
        *[F.count_if(F.col("_at") >= i).alias(f"_t{i}") for i in range(len(steps) + 1)]
    )
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("step"),
            F.col(f"_t{i}").alias("total"),
            F.col(f"_t{i + 1}").alias("forwarded"),
            (F.col(f"_t{i}") - F.col(f"_t{i + 1}")).alias("dropped"),
        )
        for i, name in enumerate(steps)
    ]
    return counters.select(F.inline(F.array(*rows)))


def drop_reasons(judged: DataFrame) -> DataFrame:
    """Row counts per step and reason; kept rows have a null step."""
    return judged.groupBy("drop_step", "drop_reason").agg(F.count("*").alias("n_rows"))
