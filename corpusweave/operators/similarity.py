"""Vector similarity: range search, greedy duplicate removal, nearest translations.

A range search compares vectors only where they can match.  Pivots cut the space into cells
(each vector lives with its nearest pivot), and a vector visits just the cells that an exact
angle bound leaves open for it; cells that hold many rows are cut into blocks, so that a task
always multiplies two matrices of bounded size.  Exact copies are collapsed to their first row
beforehand, so that a group of copies costs one row however many rows it has.  Greedy removal
finds the matching pairs once and then decides rows in rounds over the pairs.

Ids may be of any type that can be ordered; inside, rows carry integers of the same order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.operators.components import connected_components
from corpusweave.operators.pivot_cells import (
    CELL_ROWS,
    MAX_PIVOTS,
    nearest_targets,
    bounds_prune,
    pivot_cells,
)
from corpusweave.operators.pivot_cells import matrix_of as _matrix
from corpusweave.operators.pivot_cells import squared_length as _squared
from corpusweave.plans.ordering import with_row_index
from corpusweave.plans.skew import join_facts
from corpusweave.plans.staging import remove, shared_path, stage, stage_observed

#: Upper bound on the bytes of one block as a float64 matrix, and on its rows.
BLOCK_BYTES, BLOCK_ROWS = 32 << 20, 4096
#: Rows of a block of which a task gives back no pairs, but one row each.
WIDE_ROWS = 1 << 15
#: Beyond so many rows, those that the angle bounds do not keep apart are compared in plain
#: blocks, and the greedy scan begins with prefixes of that many rows.
PLAIN_ROWS = 16_384
#: Share of the open rows that a prefix must settle for another one to be tried.
SETTLED = 0.25
#: Rows on either side of a score tile inside a task.
TILE = 1024
#: Hyperplanes of one random-projection table at most; bounds the number of buckets.
MAX_BITS = 14
#: Bytes of hot vectors, the keys of spread rows, that are broadcast at most.
HOT_BYTES = 8 << 20
#: Ids of a vector that one row holds at most, and those of copied vectors that are broadcast.
PART_IDS, SENT_IDS = 256, 100_000
#: Rounds before what is left is looked at component by component, and the pairs of a
#: component that one task scans at most.
ROUNDS, SCAN_PAIRS = 8, 1_000_000


def _dimension(vectors: DataFrame, vec_col: str) -> int:
    first = vectors.select(F.size(vec_col).alias("d")).first()
    return max(1, first["d"]) if first else 1


def _block_rows(dim: int, block_rows: int | None) -> int:
    return block_rows or max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))


def _stage_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    staged, seen = stage_observed(df, label, rows=F.count("*"))
    return staged, seen["rows"]


def _is_integer(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("byte", "short", "integer", "long")


def _with_number(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` with an integer ``n`` in the order of the unique ids: an integer id itself."""
    if _is_integer(df, id_col):
        return df.withColumn("n", F.col(id_col).cast("bigint"))
    return with_row_index(df, [id_col], "n")


def _tiles(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Score tiles ``A[i:i+TILE] @ B[j:j+TILE].T`` with their corners."""
    for i in range(0, len(a), TILE):
        for j in range(0, len(b), TILE):
            yield i, j, a[i : i + TILE] @ b[j : j + TILE].T


def _matching_pairs(
    ids_a, a, ids_b, b, same: bool, threshold: float, chosen: Callable | None = None
) -> Iterator[dict]:
    for i, j, scores in _tiles(a, b):
        x, y = np.nonzero(scores > threshold)
        p, q = ids_a[i + x], ids_b[j + y]
        keep = p < q if same else np.ones(len(p), dtype=bool)
        if chosen:
            keep &= chosen(i + x, j + y)
        yield {
            "src": np.minimum(p, q)[keep],
            "dst": np.maximum(p, q)[keep],
            "score": scores[x, y][keep],
        }


def _cell_pairs(
    placed: DataFrame, visits: DataFrame | None, threshold: float, block: int, chosen: Callable | None = None
) -> DataFrame:
    """``src, dst, score`` of all pairs above ``threshold`` inside cells.

    Of ``placed`` with a column ``codes``, only the pairs that ``chosen`` takes by their cell and
    codes are given.

    ``placed`` holds ``n, vec, cell``; ``visits`` the same for rows that meet the cell's own
    rows, but not each other.  Both are cut into blocks by the counted sizes of the cells.
    """
    def blocks(df: DataFrame, name: str) -> DataFrame:
        n = F.ceil(F.count("*") / block).cast("int")
        return df.groupBy("cell").agg(n.alias(name))

    sizes = blocks(placed, "own_blocks")
    if visits is None:
        sizes = sizes.withColumn("visit_blocks", F.lit(0))
    else:
        sizes = sizes.join(blocks(visits, "visit_blocks"), "cell", "left").fillna(0)
    # One row per cell.  The optimizer knows the size of the written table and sends it to all
    # tasks if it is small.
    sizes = stage(sizes, "cells")

    def own_block(name: str) -> Column:
        return F.pmod(F.xxhash64("n"), F.col(name)).cast("int")

    def each(name: str) -> Column:
        return F.when(F.col(name) > 0, F.sequence(F.lit(0), F.col(name) - 1))

    home = placed.join(sizes, "cell").withColumn("own", own_block("own_blocks"))
    inside = home.withColumn("other", F.explode(each("own_blocks"))).select(
        "cell", F.lit(False).alias("visit"),
        F.least("own", "other").alias("row"), F.greatest("own", "other").alias("col"),
        (F.col("own") <= F.col("other")).alias("is_row"), "n", "vec", *(["codes"] if chosen else []),
    )
    cells = inside
    if visits is not None:
        hosts = home.withColumn("other", F.explode(each("visit_blocks"))).select(
            "cell", F.lit(True).alias("visit"), F.col("own").alias("row"),
            F.col("other").alias("col"), F.lit(True).alias("is_row"), "n", "vec",
        )
        guests = visits.join(sizes, "cell").withColumn("own", own_block("visit_blocks"))
        guests = guests.withColumn("other", F.explode(each("own_blocks"))).select(
            "cell", F.lit(True).alias("visit"), F.col("other").alias("row"),
            F.col("own").alias("col"), F.lit(False).alias("is_row"), "n", "vec",
        )
        cells = inside.unionByName(hosts).unionByName(guests)
    empty = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("score", pa.float64())])

    def compare(cell: pa.Table) -> pa.Table:
        is_row = cell["is_row"].to_numpy()
        ids, matrix = cell["n"].to_numpy(), _matrix(cell["vec"])
        same = not cell["visit"][0].as_py() and cell["row"][0].as_py() == cell["col"][0].as_py()
        other = is_row if same else ~is_row
        keep = None
        if chosen:
            codes, number = _as_stored(cell["codes"]), cell["cell"][0].as_py()
            a, b = codes[is_row], codes[other]
            keep = lambda x, y: chosen(number, a[x], b[y])
        parts = _matching_pairs(ids[is_row], matrix[is_row], ids[other], matrix[other], same, threshold, keep)
        return pa.concat_tables([empty.empty_table(), *(pa.table(p, empty) for p in parts)])

    keys = ["cell", "visit", "row", "col"]
    return cells.groupBy(*keys).applyInArrow(compare, "src bigint, dst bigint, score double")


def exact_pairs(
    rows: DataFrame,
    n: int,
    threshold: float,
    block: int,
    cell_rows: int = CELL_ROWS,
    max_pivots: int = MAX_PIVOTS,
) -> DataFrame:
    """All pairs of ``rows`` (``n, vec``) with a product above ``threshold``, in pivot cells.

    Where the bounds would send a row of a large table to more cells than there are blocks, all
    blocks meet instead.
    """
    cells, blocks = math.ceil(n / cell_rows), math.ceil(n / block)
    if n > PLAIN_ROWS and not bounds_prune(rows, cells, threshold, max_pivots, 2 * blocks / cells):
        whole = rows.select("n", "vec", F.lit(0).cast("bigint").alias("cell"))
        return _cell_pairs(whole, None, threshold, block)
    placed, visits = pivot_cells(rows, n, threshold, cell_rows, max_pivots)
    return _cell_pairs(placed, visits, threshold, block)


def projected_pairs(
    rows: DataFrame, dim: int, threshold: float, block: int, tables: int, bits: int, seed: int = 1
) -> DataFrame:
    """Pairs above ``threshold`` that share a bucket of random hyperplanes; others are missed.

    Every pair that is given was checked by its own product.
    """
    if not 1 <= bits <= MAX_BITS:
        raise ValueError(f"bits must be from 1 to {MAX_BITS}")
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
    weights = 1 << np.arange(bits)

    kind = rows.schema["vec"].dataType.simpleString()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            side = _matrix(pa.chunked_array([batch["vec"]])) @ planes > 0
            codes = (side.reshape(len(side), tables, bits) @ weights).astype(np.int16)
            ends = pa.array(np.arange(len(side) + 1, dtype=np.int32) * tables)
            codes = pa.ListArray.from_arrays(ends, pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch["n"], batch["vec"], codes], names=["n", "vec", "codes"])

    rows = stage(rows.select("n", "vec").mapInArrow(coded, f"n bigint, vec {kind}, codes array<smallint>"), "codes")
    buckets = F.transform("codes", lambda c, t: t * F.lit(1 << bits) + c.cast("int"))
    # How often rows would travel to meet in their buckets, and to meet all others once.
    sizes = rows.select(F.explode(buckets).alias("cell")).groupBy("cell").count()
    sizes = sizes.agg(F.sum(F.col("count") * F.ceil(F.col("count") / block)).alias("apart")).first()
    n = rows.count()
    if n > PLAIN_ROWS and sizes["apart"] > n * math.ceil(n / block):
        whole = rows.select("n", "vec", "codes", F.lit(0).alias("cell"))
        return _cell_pairs(whole, None, threshold, block, lambda _, a, b: (a == b).any(axis=1))

    def here_first(cell: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A pair is given by the first table in which it shares a bucket."""
        before = cell >> bits
        return ~(a[:, :before] == b[:, :before]).any(axis=1)

    placed = rows.select("n", "vec", "codes", F.explode(buckets).alias("cell"))
    return _cell_pairs(placed, None, threshold, block, here_first)


def _pairs(
    distinct: DataFrame,
    n: int,
    threshold: float,
    block_rows: int | None,
    index: str,
    options: dict,
) -> DataFrame:
    dim = _dimension(distinct, "vec")
    block = _block_rows(dim, block_rows)
    if index == "exact":
        return exact_pairs(distinct, n, threshold, block, **options)
    if index == "projections":
        options = {"tables": 8, "bits": 10} | options
        return projected_pairs(distinct, dim, threshold, block, **options)
    raise ValueError("index is 'exact' or 'projections'")


def first_copies(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec, id, copies``: distinct vectors with their smallest id; combined map-side."""
    return (
        vectors.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(vec_col).alias("vec"))
        .agg(F.min(id_col).alias("id"), F.count("*").alias("copies"))
    )


def _distinct(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    numbered = _with_number(first_copies(vectors, id_col, vec_col), "id")
    return _stage_counted(numbered, "distinct-vectors")


def _copies_of(
    vectors: DataFrame, id_col: str, vec_col: str, firsts: DataFrame, payload: list[str]
) -> DataFrame:
    """``id`` and ``payload`` of the later copies of the vectors in ``firsts``; the rows of a
    vector that a third of all rows share are spread."""
    rows = vectors.select(F.col(vec_col).alias("vec"), F.col(id_col).alias("id"))
    hot = max(1, HOT_BYTES // (8 * _dimension(vectors, vec_col)))
    joined = join_facts(rows, firsts, ["vec"], "copies", payload, hot_keys=hot)
    return joined.where(F.col("id") > F.col("src")).select("id", *payload)


def _parts(rows: DataFrame) -> tuple[DataFrame, int]:
    """``n, vec, ids`` and their number: the vectors of ``key, vec``, each with up to ``PART_IDS``
    of its keys.

    Equal vectors stand together in the order of a hash and the key, so those of very many rows
    spread over tasks; a vector may come in several parts, each with a unique ``n``.  That is
    the first key where no two parts share it.
    """
    size, kind = PART_IDS, rows.schema["vec"].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hashed, matrix = batch["h"].to_numpy(), _as_stored(pa.chunked_array([batch["vec"]]))
            new = np.ones(batch.num_rows, dtype=bool)
            new[1:] = (hashed[1:] != hashed[:-1]) | (matrix[1:] != matrix[:-1]).any(axis=1)
            place = np.arange(len(new)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            starts = np.flatnonzero(place % size == 0)
            ends = pa.array(np.append(starts, len(new)), pa.int32())
            ids = pa.ListArray.from_arrays(ends, batch["key"])
            yield pa.RecordBatch.from_arrays([batch["vec"].take(pa.array(starts)), ids], names=["vec", "ids"])

    near = rows.withColumn("h", F.xxhash64("vec")).repartitionByRange("h", "key").sortWithinPartitions("h", "key")
    parts = near.mapInArrow(gather, f"vec {kind}, ids array<bigint>")
    parts, n = _stage_counted(parts.withColumn("n", F.monotonically_increasing_id()), "vector-parts")
    first = F.element_at("ids", 1)
    if parts.select(first.alias("n")).distinct().count() == n:
        parts = parts.withColumn("n", first)
    return parts, n


def _every_pair(
    vectors: DataFrame, id_col: str, vec_col: str, threshold: float, block_rows: int | None, index: str, options: dict
) -> DataFrame:
    """``src, dst, score`` of every pair of rows above ``threshold`` with ``src < dst``.

    Vectors are compared with the ids that share them put together, and the ids of copies paired
    afterwards, a bounded number with a bounded number in each step.
    """
    given = vectors.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull())
    given = given.select(F.col(id_col).alias("key"), F.col(vec_col).alias("vec"))
    names = None
    if _is_integer(vectors, id_col):
        rows = given.withColumn("key", F.col("key").cast("bigint"))
    else:
        ids = given.select(F.col("key").alias("id")).distinct()
        names = stage(with_row_index(ids, ["id"], "key"), "ids")
        rows = given.withColumnRenamed("key", "id").join(names, "id").select("key", "vec")
    parts, n = _parts(rows)
    found = _pairs(parts.select("n", "vec"), n, threshold, block_rows, index, options).select("src", "dst", "score")
    held = parts.where((F.size("ids") > 1) | (F.element_at("ids", 1) != F.col("n")))
    several = held.agg(F.sum(F.size("ids"))).first()[0]
    if several:
        for side in ("src", "dst"):
            ids = held.select(F.col("n").alias(side), F.col("ids").alias(f"{side}_ids"))
            ids = F.broadcast(ids) if several <= SENT_IDS else ids.hint("merge")
            found = found.join(ids, side, "left")
        ids = [F.coalesce(f"{side}_ids", F.array(side)) for side in ("src", "dst")]
        between = found.select(F.explode(ids[0]).alias("a"), ids[1].alias("ids"), "score")
        inside = held.where(F.size("ids") > 1).select("ids", _squared("vec").alias("score"))
        inside = inside.where(F.col("score") > threshold).select(F.explode("ids").alias("a"), "ids", "score")
        # Each pair of two parts is found once, of the rows of a part in both orders.
        between, inside = (df.select("a", F.explode("ids").alias("b"), "score") for df in (between, inside))
        both = between.where("a <> b").unionByName(inside.where("a < b"))
        found = both.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "score")
    if names is None:
        id_type = vectors.schema[id_col].dataType
        return found.select(*[F.col(c).cast(id_type).alias(c) for c in ("src", "dst")], "score")
    for side in ("src", "dst"):
        ids = names.select(F.col("key").alias(side), F.col("id").alias(f"{side}_id"))
        found = found.join(ids, side).drop(side).withColumnRenamed(f"{side}_id", side)
    return found.select("src", "dst", "score")


def similarity_join(
    vectors: DataFrame,
    id_col: str,
    vec_col: str,
    threshold: float = 0.9,
    block_rows: int | None = None,
    index: str = "exact",
    copies: str = "first",
    **options: int,
) -> DataFrame:
    """``src, dst, score`` with ``src < dst`` for all pairs above ``threshold``, by raw product.

    With ``copies="all"`` every pair of rows is listed, also those of copies; rows of the same
    id are no pair.  With "first", pairs are listed between the first rows of distinct vectors,
    and a further copy once, with its first row, if their own product is above the threshold.
    ``index`` is "exact" (option ``cell_rows``) or "projections" (``tables``, ``bits``), which
    may miss pairs.
    """
    if copies not in ("first", "all"):
        raise ValueError("copies is 'first' or 'all'")
    if copies == "all":
        return _every_pair(vectors, id_col, vec_col, threshold, block_rows, index, options)
    distinct, n = _distinct(vectors, id_col, vec_col)
    found = _pairs(distinct, n, threshold, block_rows, index, options)
    if _is_integer(vectors, id_col):
        id_type = vectors.schema[id_col].dataType
        found = found.withColumns({c: F.col(c).cast(id_type) for c in ("src", "dst")})
    else:
        for side in ("src", "dst"):
            names = distinct.select(F.col("n").alias(side), F.col("id").alias(f"{side}_id"))
            found = found.join(names, side).drop(side).withColumnRenamed(f"{side}_id", side)
    copied = (
        distinct.where("copies > 1")
        .select("vec", "copies", F.col("id").alias("src"), _squared("vec").alias("score"))
        .where(F.col("score") > threshold)
    )
    copies = _copies_of(vectors, id_col, vec_col, copied, ["src", "score"])
    return found.select("src", "dst", "score").unionByName(
        copies.select("src", F.col("id").alias("dst"), "score")
    )


def _dropped_by_scan(edges: DataFrame) -> DataFrame:
    """``n`` of the rows that the scan drops, component by component.

    ``edges`` holds ``component, src, dst``, and each component few enough for one task.
    """

    def scan(pairs: pa.Table) -> pa.Table:
        pairs = pairs.sort_by("dst")
        gone: set[int] = set()
        for a, b in zip(pairs["src"].to_pylist(), pairs["dst"].to_pylist()):
            if a not in gone:
                gone.add(b)
        return pa.table({"n": pa.array(sorted(gone), pa.int64())})

    return edges.groupBy("component").applyInArrow(scan, "n bigint")


def _decide_prefixes(named: DataFrame, scan_pairs: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """``n`` of rows dropped, the pairs left, and tables to remove, after deciding a prefix of
    each component.

    In the order of ``n``, a prefix is as long as about ``scan_pairs`` pairs, at least half of
    that, lie inside it.  A task scans those; all rows of the prefix are then decided, and later
    neighbours of the kept ones are dropped.
    """
    # Later ends by ranks 1, 1/2, 1/4 and so on; the digests are combined map-side.
    ranks = F.percentile_approx("dst", F.array(*[F.lit(0.5**i) for i in range(31)]), 10_000)
    cuts = named.groupBy("component").agg(F.count("*").alias("pairs"), ranks.alias("marks"))
    halved = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("pairs") / F.lit(float(scan_pairs))))).cast("int")
    cuts = stage(cuts.select("component", F.get("marks", F.least(halved, F.lit(30))).alias("until")), "prefixes")
    cut = named.join(cuts, "component")
    inside = cut.where(F.col("dst") <= F.col("until")).select("component", "src", "dst")
    gone = stage(_dropped_by_scan(inside), "prefix-dropped")
    # Every row up to the mark is decided: it was dropped, or it is kept.
    open_ = cut.where(F.col("dst") > F.col("until"))
    open_ = open_.join(gone.withColumnRenamed("n", "src"), "src", "left_anti")
    decided = F.col("src") <= F.col("until")
    later = stage(open_.where(decided).select(F.col("dst").alias("n")).distinct(), "prefix-neighbours")
    rest = open_.where(~decided)
    for side in ("src", "dst"):
        rest = rest.join(later.withColumnRenamed("n", side), side, "left_anti")
    return gone.unionByName(later), rest.select("component", "src", "dst"), [cuts, gone, later]


def _drop_later_neighbours(
    edges: DataFrame, left: int, rounds: int, scan_pairs: int, max_rounds: int
) -> DataFrame | None:
    """``n`` of the rows that a scan in the order of ``n`` drops, given the matching pairs.

    Up to ``scan_pairs`` pairs are scanned by one task.  Of more, in a round rows that are no
    later end of a pair are kept for good, and their neighbours dropped; pairs with a decided
    row go.  After ``rounds`` rounds, what is left are chains: components of up to
    ``scan_pairs`` pairs are scanned, of larger ones a prefix at a time.  Every round is a
    written table, and the one before it is removed.
    """
    spark = edges.sparkSession
    path, schema = shared_path(spark, "dropped"), "n bigint"
    if not left:
        return None
    if left <= scan_pairs:
        whole = edges.select(F.lit(0).alias("component"), "src", "dst")
        return stage(_dropped_by_scan(whole), "dropped")

    named = None
    for round_no in range(max_rounds):
        if not left:
            break
        if round_no >= rounds and scan_pairs:
            if named is None:
                parts = connected_components(edges, "src", "dst").withColumnRenamed("node", "src")
                named = stage(edges.join(parts, "src"), "named-pairs")
                remove(edges)
            dropped, rest, spent = _decide_prefixes(named, scan_pairs)
            dropped.write.parquet(f"{path}/round-{round_no}")
            done, (named, left) = named, _stage_counted(rest, "pairs")
            remove(done, *spent)
            continue
        later = edges.select(F.col("dst").alias("src")).distinct()
        kept = stage(edges.select("src").distinct().join(later, "src", "left_anti"), "kept")
        dropped = edges.join(kept, "src", "left_semi").select(F.col("dst").alias("n")).distinct()
        dropped.write.parquet(f"{path}/round-{round_no}")
        gone = spark.read.schema(schema).parquet(f"{path}/round-{round_no}")
        rest = (
            edges.join(kept, "src", "left_anti")
            .join(gone.withColumnRenamed("n", "src"), "src", "left_anti")
            .join(gone.withColumnRenamed("n", "dst"), "dst", "left_anti")
            .select("src", "dst")
        )
        done, (edges, left) = edges, _stage_counted(rest, "pairs")
        remove(done, kept)
    else:
        raise RuntimeError(f"duplicates were not settled in {max_rounds} rounds")
    # One folder per round: reading them back needs one scan however many rounds there were.
    return spark.read.schema(schema).parquet(f"{path}/*")


def _settle_prefixes(
    distinct: DataFrame, n: int, threshold: float, prefix: int | None = None
) -> tuple[DataFrame | None, DataFrame, int]:
    """``n`` of kept rows, the rows left open and their number, after scans of bounded prefixes.

    A task scans the first rows that are open; the kept ones, a bounded table, are sent to all
    others and drop their neighbours.  That goes on while more rows than a prefix are open and
    the last one settled a share of ``SETTLED``, so all rounds together write a few times the
    rows.  Where rows have few neighbours, one prefix is tried.
    """
    prefix = prefix or min(PLAIN_ROWS, max(1, BLOCK_BYTES // (8 * _dimension(distinct, "vec"))))
    first, open_, left = None, distinct, n
    while left > prefix:
        accuracy = min(1 << 30, max(10_000, 10 * left // prefix))
        until = open_.agg(F.percentile_approx("n", prefix / left, accuracy)).first()[0]

        def scan(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("n")
            return rows.select(["n", "vec"]).filter(pa.array(greedy_scan(_matrix(rows["vec"]), threshold)))

        kind = open_.schema["vec"].dataType.simpleString()
        head = open_.where(F.col("n") <= until).select(F.lit(0).alias("head"), "n", "vec")
        kept = stage(head.groupBy("head").applyInArrow(scan, f"n bigint, vec {kind}"), "prefix-kept")
        vectors = np.array([r["vec"] for r in kept.select("vec").collect()], np.float64)

        def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                matrix = _matrix(pa.chunked_array([batch["vec"]]))
                stays = np.ones(batch.num_rows, dtype=bool)
                for at in range(0, len(vectors), TILE):
                    some = np.flatnonzero(stays)
                    for i in range(0, len(some), TILE):
                        own = some[i : i + TILE]
                        stays[own] = ~(matrix[own] @ vectors[at : at + TILE].T > threshold).any(axis=1)
                yield batch.filter(pa.array(stays))

        rest = open_.where(F.col("n") > until)
        rest, more = _stage_counted(rest.mapInArrow(apart, rest.schema), "open")
        first = kept.select("n") if first is None else first.unionByName(kept.select("n"))
        if open_ is not distinct:
            remove(open_)
        settled, open_, left = 1 - more / left, rest, more
        if settled < SETTLED:
            break
    return first, open_, left


def greedy_dedup(
    vectors: DataFrame,
    id_col: str,
    vec_col: str,
    threshold: float = 0.9,
    block_rows: int | None = None,
    index: str = "exact",
    rounds: int = ROUNDS,
    scan_pairs: int = SCAN_PAIRS,
    max_rounds: int = 10_000,
    **options: int,
) -> DataFrame:
    """Ids kept by a scan in id order that drops every later neighbour of a kept row.

    The pairs above the threshold are found once, and rows then decided as the scan would: up
    to ``scan_pairs`` pairs by one task, more in rounds over the pairs.  Pairs still undecided
    after ``rounds`` rounds are scanned component by component, of a component about
    ``scan_pairs`` pairs at a time.

    The pairs of a large table are looked for among the rows only that prefixes of it have not
    settled, as long as a prefix settles a fair share; "projections", which may miss pairs, look
    for them among all.
    """
    distinct, n = _distinct(vectors, id_col, vec_col)
    first, open_, n_open = None, distinct, n
    if index == "exact":
        first, open_, n_open = _settle_prefixes(distinct, n, threshold)
    pairs = _pairs(open_, n_open, threshold, block_rows, index, options).select("src", "dst")
    edges, left = _stage_counted(pairs, "pairs")
    dropped = _drop_later_neighbours(edges, left, rounds, scan_pairs, max_rounds)
    keep = open_ if dropped is None else open_.join(dropped, "n", "left_anti")
    if first is not None:
        keep = keep.unionByName(distinct.join(first, "n", "left_semi").select(*keep.columns))
    # Copies of a vector are neighbours when its squared length exceeds the threshold;
    # otherwise they share the fate of the first one.
    apart = keep.where((F.col("copies") > 1) & (_squared("vec") <= threshold))
    apart = apart.select("vec", "copies", F.col("id").alias("src"))
    more = _copies_of(vectors, id_col, vec_col, apart, ["src"]).select("id")
    return keep.select("id").unionByName(more).select(F.col("id").alias(id_col))


def greedy_scan(matrix: np.ndarray, threshold: float, rows: int = 256, columns: int = 4096) -> np.ndarray:
    """Keep flags of the scan over the rows of one bounded matrix, in row order.

    Products are made in double precision, a tile at a time; the matrix itself stays as it is.
    """
    n = len(matrix)
    keep = np.ones(n, dtype=bool)
    for start in range(0, n, rows):
        stop = min(start + rows, n)
        tile = np.flatnonzero(keep[start:stop]) + start
        own = matrix[tile].astype(np.float64)
        near = own @ own.T > threshold
        stays = np.ones(len(tile), dtype=bool)
        for i in range(len(tile)):
            if stays[i]:
                stays[i + 1 :] &= ~near[i, i + 1 :]
        keep[tile] = stays
        own = own[stays]
        for at in range(stop, n, columns):
            open_ = np.flatnonzero(keep[at : at + columns]) + at
            keep[open_] = ~(own @ matrix[open_].astype(np.float64).T > threshold).any(axis=0)
    return keep


def _as_stored(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column in their own precision."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _with_batch(vectors: DataFrame, id_col: str, vec_col: str, batch_size: int) -> DataFrame:
    rows = vectors.where(F.col(vec_col).isNotNull()).select(id_col, vec_col)
    indexed = with_row_index(rows, [id_col])
    return indexed.withColumn("batch", F.floor(F.col("row_index") / batch_size))


def batched_dedup(
    vectors: DataFrame,
    id_col: str,
    vec_col: str,
    threshold: float = 0.9,
    batch_size: int = 100_000,
) -> DataFrame:
    """``id_col, batch`` kept by the scan inside each run of ``batch_size`` rows in id order.

    Duplicates in different batches both survive.  One task handles one batch.
    """
    id_type = vectors.schema[id_col].dataType.simpleString()

    def scan(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by(id_col)
        return batch.select([id_col, "batch"]).filter(
            pa.array(greedy_scan(_as_stored(batch[vec_col]), threshold))
        )

    batches = _with_batch(vectors, id_col, vec_col, batch_size).select(id_col, "batch", vec_col)
    return batches.groupBy("batch").applyInArrow(scan, f"`{id_col}` {id_type}, batch bigint")


def two_pass_dedup(
    vectors: DataFrame,
    id_col: str,
    vec_col: str,
    threshold: float = 0.9,
    batch_size: int = 100_000,
    block_rows: int | None = None,
    **options,
) -> DataFrame:
    """Ids kept by the scan over the survivors of the batches; raises on empty input.

    Further options are those of ``greedy_dedup``.
    """
    present = vectors.where(F.col(vec_col).isNotNull())
    if present.isEmpty():
        raise ValueError("there are no vectors to deduplicate")
    first = stage(batched_dedup(present, id_col, vec_col, threshold, batch_size), "first-pass")
    if first.where("batch > 0").isEmpty():
        return first.select(id_col)
    survivors = stage(present.join(first.select(id_col), id_col, "left_semi"), "survivors")
    return greedy_dedup(survivors, id_col, vec_col, threshold, block_rows, **options)


def nearest_both(
    sources: DataFrame, targets: DataFrame, id_col: str, vec_col: str, block_rows: int | None = None
) -> DataFrame:
    """``forth, src, dst, score``: the most similar target of each source (``forth``), and the
    most similar source of each target, by cosine; the smallest id on a tie."""
    forth = nearest(sources, targets, id_col, vec_col, block_rows)
    back = nearest(targets, sources, id_col, vec_col, block_rows)
    return forth.select(F.lit(True).alias("forth"), "*").unionByName(back.select(F.lit(False).alias("forth"), "*"))


def nearest(
    sources: DataFrame,
    targets: DataFrame,
    id_col: str,
    vec_col: str,
    block_rows: int | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``src, dst, score``: the most similar target of each source, the smallest id on a tie.

    Equal vectors are compared once.  A source first meets the targets of its own cell; what it
    finds there bounds the angle of anything better, and only cells that can hold such a target
    are visited.  A zero vector is equally far from all.
    """
    def given(df: DataFrame) -> DataFrame:
        return df.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(
            F.col(id_col).alias("id"), F.col(vec_col).alias("vec")
        )

    sources = given(sources)
    askers, _ = _stage_counted(
        with_row_index(sources.groupBy("vec").agg(F.count("*").alias("copies")), ["vec"], "n"), "askers"
    )
    # Numbers in the order of the ids, so that ties go by the id.
    offered = _with_number(given(targets).groupBy("vec").agg(F.min("id").alias("id")), "id")
    offered, n = _stage_counted(offered, "offered")
    block = _block_rows(_dimension(offered, "vec"), block_rows)
    wide = block_rows or max(block, min(WIDE_ROWS, BLOCK_BYTES // (8 * _dimension(offered, "vec"))))
    found = nearest_targets(
        askers.select("n", "vec"), offered.select("n", "vec"), n, block, cell_rows, wide=wide
    )
    named = found.join(offered.select(F.col("n").alias("dst"), F.col("id").alias("best")), "dst")
    named = named.select("src", "best", "score")
    facts = askers.join(named, F.col("n") == F.col("src")).select("vec", "copies", "best", "score")
    hot = max(1, HOT_BYTES // (8 * _dimension(offered, "vec")))
    joined = join_facts(sources, facts, ["vec"], "copies", ["best", "score"], hot_keys=hot)
    return joined.where("best is not null").select(
        F.col("id").alias("src"), F.col("best").alias("dst"), "score"
    )


def translation_retrieval_accuracy(
    pairs: DataFrame, id_col: str, source_vec: str, target_vec: str, block_rows: int | None = None
) -> DataFrame:
    """Share of rows whose nearest target (and nearest source) is their own counterpart."""
    sources = pairs.select(id_col, F.col(source_vec).alias("vec"))
    targets = pairs.select(id_col, F.col(target_vec).alias("vec"))
    hit = F.avg((F.col("src") == F.col("dst")).cast("double"))
    both = nearest_both(sources, targets, id_col, "vec", block_rows)
    way = F.when(F.col("forth"), "src2trg").otherwise("trg2src")
    return both.groupBy(way.alias("way")).agg(hit.alias("accuracy"))
