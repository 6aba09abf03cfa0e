"""Exact-size, reproducible splits and samples."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.plans.ordering import first_by_hash, first_by_key


def train_test_split(
    df: DataFrame, key: str, test_size: float | int, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Random split; a fraction is rounded up to whole test rows, an integer is their number.

    Both parts are narrow filters on the seeded hash of the unique ``key``.
    """
    total = df.count()
    n_test = test_size if isinstance(test_size, int) else math.ceil(total * test_size)
    if not 0 < n_test < total:
        raise ValueError(f"test_size={test_size} leaves a part of {total} rows empty")
    in_test = first_by_hash(df, key, n_test, seed)
    return df.where(~in_test), df.where(in_test)


def sample_rows(
    df: DataFrame,
    mode: str,
    key: str,
    num_samples: int | None = None,
    ratio: float | None = None,
    seed: int = 42,
) -> DataFrame:
    """First rows in key order (``sequential``) or a seeded random sample without replacement.

    The size is ``num_samples`` or ``int(rows * ratio)``; exactly one must be given.
    """
    if (num_samples is None) == (ratio is None):
        raise ValueError("give exactly one of num_samples and ratio")
    if mode not in ("sequential", "random"):
        raise ValueError(f"mode must be 'sequential' or 'random', got {mode!r}")
    total = df.count()
    n = num_samples if num_samples is not None else int(total * ratio)
    if n > total:
        raise ValueError(f"cannot take {n} of {total} rows")
    chosen = first_by_key(df, key, n) if mode == "sequential" else first_by_hash(df, key, n, seed)
    return df.where(chosen)


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Cheap sample of about ``fraction`` of the rows."""
    return df.sample(fraction, seed=seed)


def select_eval_split(
    splits: Mapping[str, DataFrame],
    key: str,
    train_split: str = "train",
    test_size: float | None = None,
    eval_split: str | None = None,
    eval_data: Mapping[str, DataFrame] | None = None,
    eval_data_split: str = "train",
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Training and evaluation rows: a share of the training split, a named split, or other
    data, tried in this order."""
    if test_size:
        if "test" in splits:
            return splits["train"], splits["test"]
        return train_test_split(splits[train_split], key, test_size, seed)
    if eval_split:
        return splits[train_split], splits[eval_split]
    if eval_data:
        return splits[train_split], eval_data[eval_data_split]
    raise ValueError("give test_size, eval_split or eval_data")


def label_split(train: DataFrame, held_out: DataFrame) -> DataFrame:
    """Both parts in one table with a ``split`` column."""
    return train.withColumn("split", F.lit("train")).unionByName(
        held_out.withColumn("split", F.lit("test"))
    )
