"""What several operators of this folder need."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: Most rows and bytes that a Python worker holds of one Arrow batch (long texts fill the bytes first).
BATCH_ROWS, BATCH_BYTES = 512, "8m"


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that very long texts do not add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def utf8(text: Column) -> Column:
    """The UTF-8 bytes of a text; a null is an empty text."""
    return F.coalesce(text, F.lit("")).cast("binary")


def per_text(fn: Callable[[bytes], object], spark_type: DataType) -> Callable[[Column], Column]:
    """A column function that applies ``fn`` to the UTF-8 bytes of each text."""

    @F.pandas_udf(spark_type)
    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series([fn(t) for t in texts], dtype=object if len(texts) == 0 else None)

    return lambda text: apply(utf8(text))


def crc_fold(key: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of a key written as text; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def whole_row(df: DataFrame) -> tuple[Column, list[Column]]:
    """All columns as one struct ``row``, and a 128-bit key ``h0, h1`` made from them."""
    names = [F.col(f"`{c}`") for c in df.columns]
    plain = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]
    # xxhash64 skips nulls, so which columns are null is hashed as well.
    nulls = [c.isNull() for c in plain]
    keys = [F.xxhash64(F.lit(i), *plain, *nulls).alias(f"h{i}") for i in (0, 1)]
    return F.struct(*names).alias("row"), keys


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


def fit_logistic(
    x: np.ndarray,
    y: np.ndarray,
    l2: float = 1.0,
    prior: np.ndarray | None = None,
    rounds: int = 50,
) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression (Newton steps).

    The ridge penalty draws the weights to ``prior`` (zeros unless given); the intercept is
    hardly penalised.  Without rows the prior itself comes back.
    """
    design = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(design.shape[1], float(l2))
    penalty[-1] = 1e-2
    centre = np.zeros(design.shape[1])
    if prior is not None:
        centre[:-1] = prior
    w = centre.copy()
    for _ in range(rounds):
        p = sigmoid(design @ w)
        slope = design.T @ (p - y) + penalty * (w - centre)
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    folds: int,
    held_out: int,
    limit: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``text, label`` of at most ``limit`` labelled rows outside the held-out fold.

    Rows are chosen by a hash of their key, alike in every run, among the documents that are in
    the table.  A key labelled twice counts with its largest label, a key of several rows with
    one of them; null keys and null labels are no labels.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
        .where(crc_fold(F.col(id_col), folds) != held_out)
        .groupBy(F.col(id_col).alias("_key"))
        .agg(F.max(label).cast("int").alias("label"))
    )
    texts = docs.select(F.col(id_col).alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Only labels of documents in the table count; of the table just its keys are read here.
    here = known.join(texts.select("_key").distinct(), "_key", "left_semi")
    chosen = here.orderBy(F.xxhash64(F.lit("sample"), F.col("_key")), "_key").limit(limit)
    # Bounded by ``limit`` rows of two numbers.
    found = texts.join(F.broadcast(chosen), "_key")
    # One row of a key, the smallest by a hash of its text; combined in each task first.
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("one")
    return found.groupBy("_key").agg(one).select("one.text", "one.label")
