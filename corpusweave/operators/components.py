"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.plans.skew import HOT_ROWS, join_facts
from corpusweave.plans.staging import remove, stage_observed


def _stage_edges(edges: DataFrame, label: str) -> tuple[DataFrame, dict]:
    """Written edges, with their number and an order-free checksum."""
    checksum = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return stage_observed(edges, label, edges=F.count("*"), checksum=checksum)


def _smallest_neighbour(edges: DataFrame, hot_rows: int, total: int) -> DataFrame:
    """``u, v`` plus the smallest neighbour ``m`` of ``u``; the minimum is combined map-side."""
    facts = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    return join_facts(edges, facts, ["u"], "degree", ["m"], hot_rows, total_rows=total)


def connected_components(
    edges: DataFrame, src: str, dst: str, max_rounds: int = 60, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``node, component`` for every node of an edge, with the smallest node as component.

    Alternates the large-star and small-star steps (Kiveris et al., "Connected components in
    MapReduce and beyond", 2014) until the edges form one star per component.  The number
    of edges never grows, hubs are joined without a hot task, and each round is a written
    table, so a lost executor costs at most one round.
    """
    stars, seen = _stage_edges(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        total = seen["edges"]
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _smallest_neighbour(both, hot_rows, 2 * total)
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        # Every neighbour but the smallest moves under the smallest; u moves there once.
        small = _smallest_neighbour(large, hot_rows, total).select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
            F.col("m").alias("v"),
        )
        before, done = seen, stars
        stars, seen = _stage_edges(small.distinct(), "stars")
        # Only the last round is ever read again.
        remove(done)
        if seen == before:
            leaves = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
            roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component"))
            return leaves.unionByName(roots.distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
