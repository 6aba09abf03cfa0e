"""Document fingerprints by quartile bucket digests.

Byte triplets (a byte and those three and eight places on, around the end of the text) are
hashed to buckets and counted.  A bucket is written as the number of distinct quartiles of all
counts that it exceeds, in two bits; the logarithm of the length leads.  Two digests are
compared bucket by bucket: differences weigh more the further apart they are, are related to
the buckets that either digest uses, and from a bound on mean no likeness at all.

Defined cases: a null text is an empty text, whose digest is all zeros; equal texts have equal
digests and the likeness 1; texts of any length are read whole.  Other columns may have any
name.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StringType

from corpusweave.llm.common import bounded_batches, per_text
from corpusweave.plans.ordering import with_row_index

BUCKETS = 256
#: Ratio of two lengths that differ by one step.
LENGTH_STEP = math.log(1.15)
#: Weight of a difference of 0 to 3 levels, and of each further step of length.
LEVEL_WEIGHTS = np.array([0, 1, 2, 4])
LENGTH_WEIGHT = 0.04
#: Mean weighted difference of a used bucket from which two texts are not alike at all.
BOUND = 2.0
#: Rows that one task of ``edit_fingerprints`` gets, about.
ROWS_PER_TASK = 20_000

_QUARTILES = [BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4]


def digest(text: bytes) -> tuple[int, np.ndarray]:
    """Length step, and the level of each bucket."""
    if not text:
        return 0, np.zeros(BUCKETS, np.uint8)
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    # Odd multipliers from the golden ratio, one per place; the top eight bits are kept.
    h = b * np.uint32(0x9E3779B1)
    h ^= np.roll(b, -3) * np.uint32(0x85EBCA77)
    h ^= np.roll(b, -8) * np.uint32(0xC2B2AE3D)
    h *= np.uint32(0x27D4EB2F)
    counts = np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    quartiles = np.unique(np.partition(counts, _QUARTILES)[_QUARTILES])
    levels = np.searchsorted(quartiles, counts, side="left")
    return min(255, int(math.log(len(text) + 1) / LENGTH_STEP)), levels.astype(np.uint8)


def write_digest(d: tuple[int, np.ndarray]) -> str:
    """Hexadecimal digits: the length step, then four buckets to a byte."""
    quads = d[1].reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8)
    return f"{d[0]:02x}" + quads.astype(np.uint8).tobytes().hex()


def read_digest(written: str) -> tuple[int, np.ndarray]:
    quads = np.frombuffer(bytes.fromhex(written[2:]), np.uint8)
    return int(written[:2], 16), (quads[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).ravel()


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """From 0 to 1; 1 for equal digests."""
    apart = np.abs(a[1].astype(np.int8) - b[1].astype(np.int8))
    used = max(1, int(((a[1] | b[1]) > 0).sum()))
    difference = float(LEVEL_WEIGHTS[apart].sum()) / used
    difference += LENGTH_WEIGHT * max(0, abs(a[0] - b[0]) - 1)
    return max(0.0, 1.0 - difference / BOUND)


fingerprint = per_text(lambda text: write_digest(digest(text)), StringType())


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many first code points of another."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _deal(rows: DataFrame, rows_per_task: int) -> DataFrame:
    """``id, text, ahead`` in descending order of id, cut into sorted partitions.

    The first row of each partition also ends the partition before, marked ``ahead``, and the
    first of all ends the last, so that every row finds its next one in its own partition.
    One exchange moves the texts; where to cut is learned from the ids alone.
    """
    spark = rows.sparkSession
    placed = with_row_index(rows.select("id").where("id is not null"), ["id"], "at")
    n = placed.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // rows_per_task))
    step = max(1, -(-n // tasks))
    # One id per task: the largest of its partition.
    heads = sorted({r["id"] for r in placed.where((n - 1 - F.col("at")) % step == 0).collect()})
    parts = max(1, len(heads))
    order = [F.col("ahead"), F.col("id").desc_nulls_last(), F.col("text")]
    if parts == 1:
        own = rows.withColumn("ahead", F.lit(False))
        return own.repartitionById(1, F.lit(0)).sortWithinPartitions(*order)

    @F.pandas_udf(IntegerType())
    def place(ids: pd.Series) -> pd.Series:
        """Twice the partition of an id, and one more if the id is its first."""
        at = [bisect_left(heads, i) for i in ids]
        return pd.Series(
            [2 * (parts - 1 - k) + (heads[k] == i) for k, i in zip(at, ids)], dtype="int32"
        )

    known = F.coalesce("id", F.lit(heads[0]))
    code = F.when(F.col("id").isNull(), 2 * (parts - 1)).otherwise(place(known))
    own = F.floor(F.col("code") / 2).cast("int")
    before = F.pmod(own - 1, F.lit(parts))

    def dealt(part: Column, ahead: bool) -> Column:
        return F.struct(part.alias("part"), F.lit(ahead).alias("ahead"))

    twice = F.when(
        F.col("code") % 2 == 1, F.array(dealt(own, False), dealt(before, True))
    ).otherwise(F.array(dealt(own, False)))
    return (
        rows.withColumn("code", code)
        .select("id", "text", F.explode(twice).alias("d"))
        .select("id", "text", "d.part", "d.ahead")
        .repartitionById(parts, "part")
        .drop("part")
        .sortWithinPartitions(*order)
    )


def edit_fingerprints(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Each text and its edited text, fingerprinted and compared.

    ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``;
    the next document is that with the next smaller id, and after the last the first.  Rows
    of equal id follow each other by text, rows without id come last.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )

    def compare(held: tuple, following: tuple) -> tuple:
        key, text, own = held
        new = edited(text, following[1]).encode()
        changed = digest(new)
        return (
            key, len(text), hashlib.sha256(new).hexdigest(), write_digest(own),
            write_digest(changed), likeness(own, changed), likeness(own, following[2]),
        )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = held = None
        for batch in batches:
            out = []
            for key, text, ahead in zip(*(c.to_pylist() for c in batch.columns)):
                row = (key, text, digest(text.encode()))
                if held is not None:
                    out.append(compare(held, row))
                first = first or row
                held = row
                if ahead:
                    held = None
                    break
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)], names=names
                )
            if first is not None and held is None:
                break
        if held is not None:
            last = [compare(held, first)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*last), types)], names=names
            )

    names = [f.split()[0] for f in schema.split(", ")]
    id_type = to_arrow_type(rows.schema["id"].dataType)
    types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return _deal(rows, rows_per_task).select("id", "text", "ahead").mapInArrow(walk, schema)
