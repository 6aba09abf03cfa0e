"""Cells of vectors around pivots, and angle bounds that say which cells can hold a match.

Every vector lives in the cell of its nearest pivot.  Angles obey the triangle inequality, so a
cell whose pivot is farther away than the reach of a vector and the radius of the cell together
holds nothing for it.  Where one table of pivots would grow too large to be sent to all tasks,
cells are divided a second time around pivots of their own, which travel with the rows of the
cell only; so the number of cells follows the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.plans.staging import remove, stage, stage_observed

#: Rows that a cell should hold, and the most pivots in one table.
CELL_ROWS, MAX_PIVOTS = 4096, 1024
#: Rows of a divided cell that one task compares with the cell's pivots.
PLACE_ROWS = 16_384
#: Rows on either side of a score tile inside a task.
TILE = 1024
#: What rounding errors of angles and of scores may amount to.
SLACK, SCORE_SLACK = 1e-6, 1e-8
#: Decimals of a score, so that equal directions tie in every block.
DECIMALS = 9


def matrix_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def squared_length(vec: str) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def angles(matrix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles between rows and unit pivots."""
    return np.arccos(np.clip(unit_rows(matrix) @ pivots.T, -1.0, 1.0))


def reach_of(matrix: np.ndarray, largest: float, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The angle within which a vector of length up to ``largest`` can have a product above the
    threshold, and whether there can be any."""
    reach = np.linalg.norm(matrix, axis=1) * largest
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(reach > 0, threshold / reach, np.inf if threshold >= 0 else -np.inf)
    theta = np.arccos(np.clip(cosine, -1.0, 1.0))
    # A product of zero vectors is zero, whatever the angle.
    return np.where(threshold < 0, np.pi, theta), cosine < 1


def _sample(rows: DataFrame, wanted: int) -> np.ndarray:
    """Unit vectors of a hashed sample; their number is bounded."""
    some = rows.select("n", "vec").orderBy(F.xxhash64("n"), "n").limit(wanted).collect()
    return unit_rows(np.array([r["vec"] for r in some], dtype=np.float64)) if some else np.empty((0, 0))


def _placed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``n, vec, cell, away``: the nearest pivot of every row and the angle to it."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            away = angles(matrix_of(batch["vec"]), pivots)
            cell = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch["n"], batch["vec"], pa.array(cell, pa.int64()), pa.array(away.min(axis=1))],
                names=["n", "vec", "cell", "away"],
            )

    kind = rows.schema["vec"].dataType.simpleString()
    return rows.select("n", "vec").mapInArrow(place, f"n bigint, vec {kind}, cell bigint, away double")


def _radii(placed: DataFrame, count: int) -> np.ndarray:
    """The angle of the farthest row of each cell, -1 for an empty one."""
    radius = np.full(count, -1.0)
    for r in placed.groupBy("cell").agg(F.max("away").alias("away")).collect():
        radius[r["cell"]] = r["away"]
    return radius


def _visits(placed: DataFrame, pivots: np.ndarray, radius: np.ndarray, largest: float, threshold: float) -> DataFrame:
    """``n, cell``: the cells of higher number that each row visits.

    With the largest norm M, a pair with ``x.y > t`` has an angle below ``acos(t / (|x| M))``.
    If y is nearer to its pivot q than to any other, then x is at most twice that angle
    farther from q than from its own pivot, and at most that angle farther from q than the
    farthest row of q; x visits just the cells that satisfy both.
    """

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = matrix_of(batch["vec"])
            theta, any_ = reach_of(matrix, largest, threshold)
            away, home = angles(matrix, pivots), batch["cell"].to_numpy()
            near = away <= away[np.arange(len(home)), home][:, None] + 2 * theta[:, None] + SLACK
            near &= away <= radius[None, :] + theta[:, None] + SLACK
            near &= (np.arange(len(pivots))[None, :] > home[:, None]) & (radius >= 0)[None, :]
            near &= any_[:, None]
            row, cell = np.nonzero(near)
            yield pa.RecordBatch.from_arrays(
                [batch["n"].take(pa.array(row)), pa.array(cell, pa.int64())], names=["n", "cell"]
            )

    return placed.mapInArrow(visit, "n bigint, cell bigint")


def bounds_prune(
    rows: DataFrame, cells: int, threshold: float, max_pivots: int, share: float
) -> bool:
    """Whether the angle bounds leave less than ``share`` of the cells open to a row, judged by a
    hashed sample of at most ``max_pivots`` rows; only the way of comparing depends on it."""
    longest = rows.agg(F.max(squared_length("vec"))).first()[0]
    some = rows.select("n", "vec").orderBy(F.xxhash64("n"), "n").limit(min(max_pivots, 2 * max(1, cells))).collect()
    matrix = np.array([r["vec"] for r in some], np.float64)
    theta, any_ = reach_of(matrix, math.sqrt(longest or 0.0), threshold)
    half = (len(matrix) + 1) // 2
    away = angles(matrix[half:], unit_rows(matrix[:half]))
    if not away.size:
        return True
    near = away <= away.min(axis=1, keepdims=True) + 2 * theta[half:, None] + SLACK
    return bool((near & any_[half:, None]).mean() < share)


def _with_vectors(visits: DataFrame, placed: DataFrame) -> DataFrame:
    """``visits`` with the vector of each ``n``.

    Few bytes of a written table hold very many visits, so neither side is ever broadcast.
    """
    return visits.join(placed.select("n", "vec").hint("merge"), "n")


def pivot_cells(
    rows: DataFrame, n: int, threshold: float, cell_rows: int = CELL_ROWS, max_pivots: int = MAX_PIVOTS
) -> tuple[DataFrame, DataFrame | None]:
    """``n, vec, cell`` of all rows at home, and of the rows that visit other cells.

    Every pair of ``rows`` (``n, vec``) with a product above ``threshold`` is in one cell at
    home, or one of the two visits the other's cell.  More than ``max_pivots`` cells are made
    in two levels.
    """
    longest = rows.agg(F.max(squared_length("vec"))).first()[0] if n else None
    largest = math.sqrt(longest or 0.0)
    cells = max(1, math.ceil(n / cell_rows))
    two = cells > max_pivots
    pivots = _sample(rows, min(max_pivots, math.ceil(math.sqrt(cells))) if two else cells)
    placed = _placed(rows, pivots) if len(pivots) else rows.select("n", "vec", F.lit(0).cast("bigint").alias("cell"))
    if len(pivots) <= 1:
        return placed.select("n", "vec", "cell"), None
    placed = stage(placed, "placed")
    radius = _radii(placed, len(pivots))
    open_cells = stage(_visits(placed, pivots, radius, largest, threshold), "visits")
    visits = _with_vectors(open_cells, placed).select("n", "vec", "cell")
    if not two:
        return placed.select("n", "vec", "cell"), visits
    return _divided(placed.select("n", "vec", "cell"), visits, pivots, largest, threshold, cell_rows, max_pivots)


def _divided(
    placed: DataFrame, visits: DataFrame, tops: np.ndarray, largest: float, threshold: float,
    cell_rows: int, max_pivots: int,
) -> tuple[DataFrame, DataFrame]:
    """The second level: home and visiting rows of cells that are divided around own pivots.

    Rows at home visit the later parts of their cell, visitors any part, as the bounds allow.
    """
    kind = placed.schema["vec"].dataType.simpleString()
    keyed = visits.withColumn("guest", F.lit(True)).unionByName(placed.withColumn("guest", F.lit(False)))
    counts = keyed.groupBy("cell").agg(
        F.count("*").alias("here"), F.count_if(~F.col("guest")).alias("own")
    )
    # One row per cell of the first level, whose number is bounded.
    counts = F.broadcast(stage(counts, "cell-counts"))
    parts = F.least(F.lit(max_pivots - 1), F.ceil(F.col("own") / cell_rows))
    every = F.greatest(F.lit(1), F.floor(F.col("own") / parts)).cast("bigint")
    sampled = placed.join(counts, "cell").where(F.pmod(F.xxhash64(F.lit(2), "n"), every) == 0)
    # About ``max_pivots`` rows per cell at most; the cell's own pivot stands in front.
    own_pivots = sampled.groupBy("cell").agg(
        F.sort_array(F.collect_list(F.struct("n", F.col("vec").cast("array<double>").alias("vec")))).alias("p")
    )
    heads = placed.sparkSession.createDataFrame(
        [(i, p.tolist()) for i, p in enumerate(tops)], "cell bigint, head array<double>"
    )
    pivots = heads.join(own_pivots, "cell", "left").select(
        "cell",
        F.concat(F.array("head"), F.coalesce(F.col("p.vec"), F.array().cast("array<array<double>>"))).alias("pivots"),
    )
    pivots = stage(pivots, "cell-pivots")

    def together(rows: DataFrame, pivots: DataFrame, fn: Callable, schema: str) -> DataFrame:
        """``fn`` over bounded blocks of a cell's rows, each with the cell's pivots."""
        blocks = F.ceil(F.col("here") / PLACE_ROWS).cast("int")
        dealt = rows.join(counts, "cell").withColumn("block", F.pmod(F.xxhash64("n"), blocks).cast("int"))
        spread = pivots.join(counts, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        left = dealt.select(*rows.columns, "block").groupBy("cell", "block")
        return left.cogroup(spread.select(*pivots.columns, "block").groupBy("cell", "block")).applyInArrow(fn, schema)

    def of(table: pa.Table) -> np.ndarray:
        return unit_rows(np.array(table["pivots"][0].as_py(), np.float64))

    def place(rows: pa.Table, cell: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"n": pa.array([], pa.int64()), "vec": rows["vec"], "cell": rows["cell"],
                             "part": pa.array([], pa.int32()), "away": pa.array([], pa.float64())})
        away = angles(matrix_of(rows["vec"]), of(cell))
        part = pa.array(away.argmin(axis=1), pa.int32())
        return pa.table(
            {"n": rows["n"], "vec": rows["vec"], "cell": rows["cell"], "part": part, "away": away.min(axis=1)}
        )

    home = stage(
        together(placed, pivots, place, f"n bigint, vec {kind}, cell bigint, part int, away double"), "parts"
    )
    radii = home.groupBy("cell", "part").agg(F.max("away").alias("away"))
    radii = radii.groupBy("cell").agg(F.collect_list(F.struct("part", "away")).alias("radii"))
    known = stage(pivots.join(radii, "cell"), "part-pivots")

    def visit(rows: pa.Table, cell: pa.Table) -> pa.Table:
        empty = pa.table({"n": pa.array([], pa.int64()), "cell": pa.array([], pa.int64()), "part": pa.array([], pa.int32())})
        if not rows.num_rows or not cell.num_rows:
            return empty
        own = of(cell)
        radius = np.full(len(own), -1.0)
        for r in cell["radii"][0].as_py():
            radius[r["part"]] = r["away"]
        matrix, home_part = matrix_of(rows["vec"]), rows["part"].to_numpy()
        theta, any_ = reach_of(matrix, largest, threshold)
        away = angles(matrix, own)
        near = (away <= radius[None, :] + theta[:, None] + SLACK) & (radius >= 0)[None, :] & any_[:, None]
        # Visitors come with part -1; rows at home go by the distance to their own pivot as well.
        at_home = home_part >= 0
        here = away[np.arange(len(away)), np.maximum(home_part, 0)]
        near &= ~at_home[:, None] | (away <= here[:, None] + 2 * theta[:, None] + SLACK)
        near &= np.arange(len(own))[None, :] > home_part[:, None]
        row, part = np.nonzero(near)
        cells = np.full(len(row), cell["cell"][0].as_py(), np.int64)
        return pa.table({"n": rows["n"].take(pa.array(row)), "cell": cells, "part": pa.array(part, pa.int32())})

    asking = home.select("n", "vec", "cell", "part").unionByName(visits.withColumn("part", F.lit(-1)))
    open_parts = stage(together(asking, known, visit, "n bigint, cell bigint, part int"), "part-visits")
    number = F.col("cell") * F.lit(2 * max_pivots) + F.col("part")

    def numbered(df: DataFrame) -> DataFrame:
        return df.withColumn("cell", number).select("n", "vec", "cell")

    return numbered(home), numbered(_with_vectors(open_parts, placed))


def _best_of_cells(askers: DataFrame, offered: DataFrame, block: int) -> DataFrame:
    """``src, dst, score``: of every asker the best of its cells' targets, in bounded blocks."""

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))

    # One row per cell, whose number is bounded.
    sizes = F.broadcast(stage(blocks(askers, "rows").join(blocks(offered, "cols"), "cell"), "cells"))

    def own(n: str) -> Column:
        return F.pmod(F.xxhash64("n"), F.col(n)).cast("int")

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = askers.join(sizes, "cell").select(
        "cell", own("rows").alias("row"), each("cols").alias("col"), F.lit(True).alias("asks"), "n", "vec"
    )
    right = offered.join(sizes, "cell").select(
        "cell", each("rows").alias("row"), own("cols").alias("col"), F.lit(False).alias("asks"), "n", "vec"
    )
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("score", pa.float64())])

    def best(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("n")
        asks = cell["asks"].to_numpy()
        n, matrix = cell["n"].to_numpy(), unit_rows(matrix_of(cell["vec"]))
        a, b, ids = matrix[asks], matrix[~asks], n[~asks]
        if not len(a) or not len(b):
            return schema.empty_table()
        top, who = np.full(len(a), -np.inf), np.zeros(len(a), np.int64)
        for i in range(0, len(a), TILE):
            for j in range(0, len(b), TILE):
                scores = np.round(a[i : i + TILE] @ b[j : j + TILE].T, DECIMALS)
                at = scores.argmax(axis=1)
                found = scores[np.arange(len(at)), at]
                better = found > top[i : i + TILE]
                top[i : i + TILE] = np.where(better, found, top[i : i + TILE])
                who[i : i + TILE] = np.where(better, ids[j + at], who[i : i + TILE])
        return pa.table([n[asks], who, top], schema=schema)

    return left.unionByName(right).groupBy("cell", "row", "col").applyInArrow(
        best, "src bigint, dst bigint, score double"
    )


def _one_best(found: DataFrame) -> DataFrame:
    top = F.max(F.struct("score", (-F.col("dst")).alias("minus")))
    return found.groupBy("src").agg(top.alias("b")).select(
        "src", (-F.col("b.minus")).alias("dst"), F.col("b.score").alias("score")
    )


def nearest_targets(
    askers: DataFrame, offered: DataFrame, n: int, block: int, cell_rows: int = CELL_ROWS,
    max_pivots: int = MAX_PIVOTS, wide: int | None = None,
) -> DataFrame:
    """``src, dst, score``: the most similar of the ``n`` offered rows for every asker (both
    ``n, vec``), by cosine with nine decimals; the smallest number on a tie.

    Askers that would visit more cells than there are blocks of ``wide`` rows meet these blocks.
    """
    zero = squared_length("vec") == 0
    zeros = offered.where(zero).agg(F.min("n")).first()[0]
    smallest = offered.agg(F.min("n")).first()[0]
    some = offered.where(~zero)
    pivots = _sample(some, max(1, min(max_pivots, math.ceil(n / cell_rows)))) if n else np.empty((0, 0))

    def told(rows: DataFrame, dst: int | None) -> DataFrame:
        return rows.select(F.col("n").alias("src"), F.lit(dst).cast("bigint").alias("dst"), F.lit(0.0).alias("score"))

    # A zero vector is at cosine zero from all, and all are from it.
    flat = told(askers.where(zero), smallest).where("dst is not null")
    asking = askers.where(~zero)
    if not len(pivots):
        return flat.unionByName(told(asking, smallest).where("dst is not null"))
    homes = stage(_placed(some, pivots), "target-cells")
    radius = _radii(homes, len(pivots))
    filled = np.flatnonzero(radius >= 0)

    def own_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = angles(matrix_of(batch["vec"]), pivots[filled])
                cell = pa.array(filled[away.argmin(axis=1)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch["n"], batch["vec"], cell], names=["n", "vec", "cell"])

    kind = askers.schema["vec"].dataType.simpleString()
    placed = stage(
        asking.select("n", "vec").mapInArrow(own_cell, f"n bigint, vec {kind}, cell bigint"), "asker-cells"
    )
    targets = homes.select("n", "vec", "cell")
    first = stage(_one_best(_best_of_cells(placed, targets, block)), "first-best")

    def better_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            away = angles(matrix_of(batch["vec"]), pivots)
            # No target of a cell scores more than one in the asker's direction at its rim.
            most = np.cos(np.maximum(0.0, away - radius[None, :] - SLACK))
            near = (most >= batch["score"].to_numpy()[:, None] - SCORE_SLACK) & (radius >= 0)[None, :]
            near &= np.arange(len(pivots))[None, :] != batch["cell"].to_numpy()[:, None]
            row, cell = np.nonzero(near)
            yield pa.RecordBatch.from_arrays(
                [batch["n"].take(pa.array(row)), pa.array(cell, pa.int64())], names=["n", "cell"]
            )

    scored = placed.join(first.select(F.col("src").alias("n"), "score"), "n")
    again = scored.select("n", "vec", "cell", "score").mapInArrow(better_cells, "n bigint, cell bigint")
    again, seen = stage_observed(again, "asker-visits", visits=F.count("*"))
    wide = max(block, wide or block)
    blocks = math.ceil(n / wide)
    if n > wide and seen["visits"] > blocks * placed.count():
        asks = placed.join(again.select("n").distinct(), "n", "left_semi").withColumn("cell", F.lit(0))
        rest = _best_of_cells(asks.select("n", "vec", "cell"), targets.withColumn("cell", F.lit(0)), wide)
    else:
        rest = _best_of_cells(_with_vectors(again, placed).select("n", "vec", "cell"), targets, block)
    found = first.unionByName(rest).unionByName(flat)
    if zeros is not None:
        found = found.unionByName(told(asking, zeros))
    best = stage(_one_best(found), "nearest")
    remove(homes, placed, first, again)
    return best
