"""Sets of ids as inclusive ranges and as masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.plans.ordering import with_row_index

#: A longer range is cut before its ids are listed, so that tasks stay even.
CHUNK = 1 << 18


def compress_ranges(df: DataFrame, id_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Maximal runs of consecutive ids as ``start, end``, per group; repeats are ignored.

    Inside a run, id minus global position is constant, and it differs between runs of a
    group.  Positions need no single-task sort and runs are combined map-side.
    """
    keys = list(group_cols)
    ids = df.select(*keys, F.col(id_col).cast("bigint").alias("id")).where("id IS NOT NULL")
    placed = with_row_index(ids.distinct(), [*keys, "id"], "at")
    return (
        placed.groupBy(*keys, (F.col("id") - F.col("at")).alias("run"))
        .agg(F.min("id").alias("start"), F.max("id").alias("end"))
        .drop("run")
    )


def flat_ranges_to_table(spark: SparkSession, ranges: Sequence[int]) -> DataFrame:
    """A flat ``[start, end, start, end, ...]`` list as a table; odd lengths raise."""
    if len(ranges) % 2:
        raise ValueError("expected start, end pairs, got an odd number of values")
    pairs = [(ranges[i], ranges[i + 1]) for i in range(0, len(ranges), 2)]
    return spark.createDataFrame(pairs, "start bigint, end bigint")


def expand_ranges(ranges: DataFrame, n: int) -> DataFrame:
    """Distinct ids in ``[0, n)`` that some range covers; inverted ranges cover nothing."""
    clamped = ranges.select(
        F.greatest(F.lit(0).cast("bigint"), "start").alias("s"),
        F.least(F.lit(n - 1).cast("bigint"), "end").alias("e"),
    ).where("s <= e")
    # Ranges of one start are one range; so many ranges may begin at the lower end.
    longest = clamped.groupBy("s").agg(F.max("e").alias("e"))
    chunks = longest.select(
        F.explode(F.sequence("s", "e", F.lit(CHUNK).cast("bigint"))).alias("from"), "e"
    )
    ids = F.sequence("from", F.least("e", F.col("from") + (CHUNK - 1)))
    # Chunks that begin alike are one chunk again.
    chunks = chunks.groupBy("from").agg(F.max("e").alias("e"))
    return chunks.select(F.explode(ids).alias("id")).distinct()


def ids_to_mask(ids: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """``id, member`` for every id in ``[0, n)``."""
    members = ids.select(F.col(id_col).cast("bigint").alias("id")).distinct()
    members = members.withColumn("member", F.lit(True))
    return (
        ids.sparkSession.range(n)
        .join(members, "id", "left")
        .select("id", F.coalesce("member", F.lit(False)).alias("member"))
    )


def ranges_to_mask(ranges: DataFrame, n: int) -> DataFrame:
    return ids_to_mask(expand_ranges(ranges, n), n)
