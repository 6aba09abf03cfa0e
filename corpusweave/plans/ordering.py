"""Global positions and order statistics without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.plans.staging import stage


def with_row_index(df: DataFrame, order_by: Sequence[str], name: str = "row_index") -> DataFrame:
    """Add the 0-based position of each row in ``order_by`` order.

    Rows are range-partitioned and sorted inside each partition; a row's position is its
    place in the partition plus the sizes of the earlier partitions.  Only one count per
    partition is ever gathered.
    """
    order_by = list(order_by)
    # monotonically_increasing_id = (partition << 33) + place; it is stored with the row,
    # so both parts stay consistent whatever happens to the sorted partitions afterwards.
    placed = stage(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_at", F.monotonically_increasing_id()),
        "row-index",
    )
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .count()
        .withColumn(
            "_offset",
            F.coalesce(
                F.sum("count").over(
                    Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .select("_part", "_offset")
    )
    # One row per partition: the broadcast is bounded by the partition count.
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + place)
        .drop("_part", "_offset", "_at")
    )


def seeded_hash(seed: int, key: Column) -> Column:
    """Reproducible pseudo-random sort key, equal in every engine that has SHA-1."""
    return F.sha1(F.concat(F.lit(f"{seed}:"), key.cast("string")))


#: So many rows are sorted at most to find the last one taken.
EDGE_ROWS = 1 << 20


def first_by_hash(df: DataFrame, key: str, n: int, seed: int, edge_rows: int = EDGE_ROWS) -> Column:
    """Predicate that holds for exactly the ``n`` rows with the smallest seeded hash.

    ``key`` must be unique.  Histograms over hash prefixes (at most 65 536 counts each) find
    the prefix in which the n-th row lies, four digits at a time until few rows share it; only
    those are sorted.  The returned predicate compares with a literal, so applying it needs no
    shuffle.
    """
    if n <= 0:
        return F.lit(False)
    hashed = df.select(seeded_hash(seed, F.col(key)).alias("h"), F.col(key).alias("k"))
    rest, prefix = n, ""
    while True:
        inside = hashed.where(F.col("h").startswith(prefix))
        found = inside.groupBy(F.substring("h", 1, len(prefix) + 4).alias("prefix")).count()
        running = found.withColumn("upto", F.sum("count").over(Window.orderBy("prefix")))
        cut = running.where(F.col("upto") >= rest).orderBy("prefix").limit(1).first()
        if cut is None:
            return F.lit(True)
        rest, prefix = rest - (cut["upto"] - cut["count"]), cut["prefix"]
        if cut["count"] <= edge_rows or len(prefix) == 40:
            break
    edge = (
        hashed.where(F.col("h").startswith(prefix))
        .orderBy("h", "k")
        .offset(rest - 1)
        .limit(1)
        .first()
    )
    h = seeded_hash(seed, F.col(key))
    return (h < edge["h"]) | ((h == edge["h"]) & (F.col(key) <= F.lit(edge["k"])))


def first_by_key(df: DataFrame, key: str, n: int, bins: int = 4096) -> Column:
    """Predicate that holds for exactly the ``n`` rows with the smallest unique ``key``.

    For an integer key, histograms of ever narrower ranges find the n-th key; nothing is
    sorted or moved but their counts.  Other keys are put in order.
    """
    if n <= 0:
        return F.lit(False)
    if df.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        edge = with_row_index(df.select(key), [key], "_i").where(F.col("_i") == n - 1).first()
        return F.lit(True) if edge is None else F.col(key) <= F.lit(edge[key])
    keys = df.select(F.col(key).cast("decimal(20,0)").alias("k")).where("k is not null")
    low, high, total = keys.agg(F.min("k"), F.max("k"), F.count("*")).first()
    if total < n:
        return F.lit(True)
    low, high, rest = int(low), int(high), n
    while low < high:
        width = (high - low) // bins + 1
        place = F.floor((F.col("k") - F.lit(low)) / F.lit(width)).cast("int")
        counts = keys.where(F.col("k").between(low, high)).groupBy(place.alias("bin")).count()
        for r in sorted(counts.collect()):
            if r["count"] >= rest:
                low, high = low + r["bin"] * width, min(high, low + (r["bin"] + 1) * width - 1)
                break
            rest -= r["count"]
    return F.col(key) <= F.lit(low)
