"""Lloyd's centroid clustering with heap-ordered bounds, on exact integer vectors.

Of a vector that was compared with all centroids, ``u`` is the distance to its own centroid and
``l`` that to the next one.  While the centroids move, ``u`` grows at most by the drift of its
own centroid and ``l`` shrinks at most by the largest drift of the others.  So each cluster adds
up one offset, and a vector enters its cluster's heap with the key ``l - u + offset``: as long as
the key lies above the offset, the vector stays where it is.  A round looks at the tops of the
heaps only, pops what has expired, compares that exactly with all centroids and pushes it into
the heap of the cluster it belongs to (Hamerly and Drake, "Accelerating Lloyd's algorithm for
k-means clustering", 2015).

The vectors lie in blocks of bounded size, each a row of a written table with the heaps of its
vectors; a round reads the blocks and writes them anew without a shuffle, so a lost executor costs
one round's share.  Only the changes of the clusters' sums travel, added up per task; the driver
holds the centroids and sums, whose size does not depend on the number of vectors.

Defined cases: vectors of another length, null vectors and vectors with null or non-finite
components are left out; a null id takes part, its hash is that of an empty id; rows with equal
ids are told apart by their vectors when centroids are chosen, and all come back; with fewer
vectors than centroids every vector is a centroid; equal centroids: the one with the smaller
number gets the vectors, the other stays; an empty table gives an empty table.  Components
beyond ``LIMIT`` after scaling count as ``LIMIT``: a squared distance would not fit a
long; an inertia that does not fit is null.  Only
the id and vector columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.common import bounded_batches
from corpusweave.plans.partitions import spread
from corpusweave.plans.staging import remove, stage

CLUSTERS, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, 2
#: Vectors of one block.
BLOCK = 4096
#: Largest scaled component; 64 squared differences of twice that fit a long.
LIMIT = 1 << 27
#: Products of smaller components add up exactly in double precision.
EXACT = 1 << 23
#: Relative margin of the bounds over their rounding errors.
MARGIN = 1e-12


def squared_distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer centroids."""
    if max(np.abs(rows).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        dots = (rows.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)
        return (rows * rows).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1) - 2 * dots
    return np.stack([((rows - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def nearest_with_gap(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: smaller number) and how much farther the next one is at least."""
    squared = squared_distances(rows, centroids)
    at = np.arange(len(rows))
    best = squared.argmin(axis=1)
    own = np.sqrt(squared[at, best].astype(np.float64))
    if len(centroids) == 1:
        return best, np.full(len(rows), np.inf)
    squared[at, best] = np.iinfo(np.int64).max
    other = np.sqrt(squared.min(axis=1).astype(np.float64))
    return best, other * (1 - MARGIN) - own * (1 + MARGIN)


class Heaps:
    """One heap of ``(key, row)`` per cluster, kept as flat arrays between rounds."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray, sizes: np.ndarray):
        ends = np.cumsum(sizes)
        entries = list(zip(keys.tolist(), rows.tolist()))
        self.heaps = [entries[end - size : end] for end, size in zip(ends.tolist(), sizes.tolist())]

    @classmethod
    def empty(cls, clusters: int) -> Heaps:
        return cls(np.empty(0), np.empty(0, np.int32), np.zeros(clusters, np.int32))

    def pop_expired(self, offsets: np.ndarray) -> np.ndarray:
        """Rows whose key no longer lies above their cluster's offset."""
        out = []
        for heap, offset in zip(self.heaps, (offsets * (1 + MARGIN)).tolist()):
            while heap and heap[0][0] * (1 - MARGIN) <= offset:
                out.append(heappop(heap)[1])
        return np.array(out, np.int64)

    def push(self, clusters: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> None:
        for cluster, key, row in zip(clusters.tolist(), keys.tolist(), rows.tolist()):
            heappush(self.heaps[cluster], (key, row))

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        entries = [e for heap in self.heaps for e in heap]
        return (
            np.array([e[0] for e in entries], np.float64),
            np.array([e[1] for e in entries], np.int32),
            np.array([len(h) for h in self.heaps], np.int32),
        )


def _scaled(batch: pa.RecordBatch, dim: int, scale: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and integer components of the vectors that count."""
    vecs = batch["vec"]
    usual = pc.fill_null(pc.equal(pc.list_value_length(vecs), dim), False)
    batch = batch.filter(usual)
    flat = batch["vec"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(batch.num_rows, dim)
    finite = np.isfinite(matrix).all(axis=1)
    scaled = np.clip(np.floor(matrix[finite] * float(scale)), -LIMIT, LIMIT)
    return batch["id"].filter(pa.array(finite)), scaled.astype(np.int64)


def _list_of_one(values: pa.Array) -> pa.ListArray:
    """A column of one row that holds all the values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _values(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch[name][row].values.to_numpy(zero_copy_only=False)


def _blocks(rows: DataFrame, dim: int, scale: int, clusters: int, block: int) -> DataFrame:
    """Blocks of vectors that no heap holds yet: the first round compares them all."""
    id_type = rows.schema["id"].dataType.simpleString()
    per_cluster = pa.array(np.zeros(clusters, np.int32))
    nothing = pa.array([], pa.float64()), pa.array([], pa.int32())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            ids, vecs = pa.concat_arrays([i for i, _ in held]), np.concatenate([v for _, v in held])
            columns = [ids, pa.array(vecs.ravel().astype(np.int32)), pa.array(np.full(len(ids), -1, np.int32))]
            lists = [_list_of_one(c) for c in (*columns, *nothing, per_cluster)]
            return pa.RecordBatch.from_arrays(lists, names=["id", "vec", "cluster", "key", "row", "size"])

        for batch in batches:
            ids, vecs = _scaled(batch, dim, scale)
            for at in range(0, len(ids), block):
                held.append((ids[at : at + block], vecs[at : at + block]))
                if sum(len(i) for i, _ in held) >= block:
                    yield packed()
                    held.clear()
        if any(len(i) for i, _ in held):
            yield packed()

    return rows.mapInArrow(
        pack,
        f"id array<{id_type}>, vec array<int>, cluster array<int>, key array<double>, row array<int>, "
        "size array<int>",
    )


def _assign(state: DataFrame, centroids: np.ndarray, offsets: np.ndarray) -> DataFrame:
    """The blocks after a round, and per block ``change``: for every cluster how its sums, its
    number of vectors and its number of exact comparisons change."""
    k, dim = centroids.shape

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                vecs = _values(batch, "vec", i).reshape(-1, dim).astype(np.int64)
                before = _values(batch, "cluster", i)
                heaps = Heaps(*(_values(batch, name, i) for name in ("key", "row", "size")))
                due = np.concatenate([heaps.pop_expired(offsets), np.flatnonzero(before < 0)])
                best, gap = nearest_with_gap(vecs[due], centroids)
                heaps.push(best, gap + offsets[best], due)
                change = np.zeros((k, dim + 2), np.int64)
                np.add.at(change[:, dim + 1], best, 1)
                left = before[due]
                moved = best != left
                rows = np.hstack([vecs[due[moved]], np.ones((int(moved.sum()), 1), np.int64)])
                np.add.at(change[:, : dim + 1], best[moved], rows)
                was = left[moved] >= 0
                np.subtract.at(change[:, : dim + 1], left[moved][was], rows[was])
                cluster = before.copy()
                cluster[due] = best
                arrays = [cluster.astype(np.int32), *heaps.flat(), change.ravel()]
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(i, 1), batch["vec"].slice(i, 1)]
                    + [_list_of_one(pa.array(a)) for a in arrays],
                    names=["id", "vec", "cluster", "key", "row", "size", "change"],
                )

    kinds = dict(state.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("id", "vec", "cluster", "key", "row", "size"))
    return state.mapInArrow(advance, f"{schema}, change array<bigint>")


def _changes(state: DataFrame, k: int, dim: int) -> np.ndarray:
    """The sum of the blocks' changes: one row per cluster, added up in every task first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * (dim + 2), np.int64)
        for batch in batches:
            if batch.num_rows:
                flat = batch["change"].flatten().to_numpy(zero_copy_only=False)
                total += flat.reshape(batch.num_rows, -1).sum(axis=0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "x"])

    summed = state.select("change").mapInArrow(add, "at bigint, x bigint").groupBy("at").agg(F.sum("x"))
    out = np.zeros(k * (dim + 2), np.int64)
    for at, x in summed.collect():
        out[at] = x
    return out.reshape(k, dim + 2)


def _first_centroids(state: DataFrame, clusters: int, dim: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of ``seed:id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("x.id").cast("string"), F.lit("")))
    components = F.transform("id", lambda _, i: F.slice("vec", i * dim + 1, dim))
    each = state.select(F.explode(F.arrays_zip("id", components.alias("vec"))).alias("x"))
    chosen = each.select(F.sha2(text, 256).alias("h"), "x.vec").orderBy("h", "vec").limit(clusters)
    return np.array([r["vec"] for r in chosen.collect()], np.int64).reshape(-1, dim)


def _placed(state: DataFrame, centroids: np.ndarray, id_type: str) -> DataFrame:
    """``id, cluster, distance`` of every vector."""
    dim = centroids.shape[1]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cluster = _values(batch, "cluster", i)
                away = _values(batch, "vec", i).reshape(-1, dim) - centroids[cluster]
                yield pa.RecordBatch.from_arrays(
                    [batch["id"][i].values, pa.array(cluster), pa.array((away * away).sum(axis=1))],
                    names=["id", "cluster", "distance"],
                )

    return state.select("id", "vec", "cluster").mapInArrow(
        measure, f"id {id_type}, cluster int, distance bigint"
    )


def cluster_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dim: int = DIM,
    scale: int = SCALE,
    seed: int = SEED,
    block: int = BLOCK,
    trace: list[int] | None = None,
) -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector.

    Components are ``floor(scale * x)``.  The first centroids are the vectors with the smallest
    SHA-256 of ``seed:id``; each round assigns every vector to its nearest centroid (squared
    Euclidean distance; ties: smaller number) and moves each non-empty centroid to the floor of
    its vectors' mean; then vectors are assigned once more.  ``trace`` receives the number of
    exact comparisons per assignment.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = spread(vectors).select(
        F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")
    )
    id_type = rows.schema["id"].dataType.simpleString()
    state = stage(_blocks(rows, dim, scale, clusters, block), "cluster-blocks")
    centroids = _first_centroids(state, clusters, dim, seed)
    if not len(centroids):
        return spark.createDataFrame(
            [],
            f"id {id_type}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, "
            "centroid_sha256 string",
        )
    k = len(centroids)
    offsets, sums = np.zeros(k), np.zeros((k, dim + 1), np.int64)
    state = state.withColumn("size", F.slice("size", 1, k))
    for done in range(rounds + 1):
        before, state = state, stage(_assign(state, centroids, offsets), "cluster-blocks")
        remove(before)
        change = _changes(state, k, dim)
        if trace is not None:
            trace.append(int(change[:, dim + 1].sum()))
        if done == rounds:
            break
        sums += change[:, : dim + 1]
        filled = sums[:, dim] > 0
        moved = centroids.copy()
        moved[filled] = sums[filled, :dim] // sums[filled, dim:]
        drift = np.sqrt(((moved - centroids) ** 2).sum(axis=1).astype(np.float64)) * (1 + MARGIN)
        order = np.sort(drift)
        # The largest drift among the other centroids.
        others = np.full(k, order[-1])
        others[drift.argmax()] = order[-2] if k > 1 else 0.0
        offsets, centroids = offsets + drift + others, moved
    placed = stage(_placed(state, centroids, id_type), "clusters")
    remove(state)
    by_cluster = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    inertia = {r["cluster"]: int(r["s"]) for r in by_cluster.collect()}
    total = sum(inertia.values())

    def long(x: int) -> int | None:
        return x if x < 1 << 63 else None

    facts = [
        (c, long(inertia[c]), long(total), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c in sorted(inertia)
    ]
    # One row per cluster.
    known = spark.createDataFrame(
        facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    )
    return placed.join(F.broadcast(known), "cluster").select(
        "id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
