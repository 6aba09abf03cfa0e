"""Near-duplicate documents by SimHash fingerprints and one-wildcard segment variants.

Two fingerprints that differ in at most ``max_bits`` bits agree, up to one bit, in at least
one of ``max_bits // 2 + 1`` segments (two at least).  Each fingerprint is therefore indexed under every
variant of each segment with one bit taken out; fingerprints that share a variant are found
by an equality join and verified on all bits.

Defined cases: a null text is an empty text; a text without words has fingerprint zero and is
linked like any other; equal texts and repeated rows share a fingerprint and so a component;
rows with a null id take part, and a component's id is the smallest non-null id (null if there
is none).  An empty table gives an empty table.  Only the id and text columns are read, so
other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from corpusweave.llm.common import bounded_batches, per_text, whole_row
from corpusweave.operators.components import connected_components
from corpusweave.plans.staging import stage

SHINGLE, SEED, BITS = 3, 42, 64
#: Largest number of fingerprints compared with one another in one task; larger buckets are cut.
BLOCK = 128
#: Buckets of more fingerprints are indexed again by their other bits before they are cut.
REFINE = 4096

_PLACE = (np.arange(8, dtype=np.uint16) * 256)[None, :]
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


def word_shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of all word shingles, repeats included; the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > size:
        starts, ends = starts[: 1 - size], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())]
    return np.array(hashes, np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    codes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _PLACE
    by_byte = np.bincount(codes.ravel(), minlength=2048).reshape(8, 256)
    majority = (by_byte @ _BITS_OF_BYTE).ravel() * 2 > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<i8")[0])


fingerprint = per_text(lambda text: simhash(word_shingle_hashes(text)), LongType())


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _segments(low: int, high: int, count: int) -> list[tuple[int, int]]:
    """The bits from ``low`` up to ``high``, cut into ``count`` ranges."""
    cuts = [low + (high - low) * k // count for k in range(count + 1)]
    return list(zip(cuts, cuts[1:]))


def _variants(segments: list[tuple[int, int]]) -> Column:
    """Every segment with each of its bits taken out: the bit, and a mask of what is left."""
    masks = []
    for low, high in segments:
        ones = ((1 << (high - low)) - 1) << low
        for bit in range(low, high):
            mask = ones & ~(1 << bit)
            signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
            masks.append(F.struct(F.lit(bit).alias("hole"), F.lit(signed).cast("bigint").alias("mask")))
    return F.array(*masks)


def forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all fingerprints reachable by links of at most ``max_bits`` bits.

    A spanning forest has fewer edges than nodes, however many pairs are linked.
    """
    left, right = [], []
    open_ = fps
    while len(open_) > 1:
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            node = queue.pop()
            # bitwise_count takes the absolute value of signed numbers
            near = np.bitwise_count((open_ ^ node).view(np.uint64)) <= max_bits
            if near.any():
                found = open_[near]
                left.append(np.full(len(found), node))
                right.append(found)
                queue.extend(found)
                open_ = open_[~near]
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _links_of_cells(
    fps: np.ndarray, starts: np.ndarray, max_bits: int
) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of ``fps`` between two successive ``starts``."""
    sizes = np.diff(starts)
    pairs = starts[:-1][sizes == 2]
    a, b = fps[pairs], fps[pairs + 1]
    near = np.bitwise_count((a ^ b).view(np.uint64)) <= max_bits
    parts = [(a[near], b[near])]
    parts += [
        forest(fps[start : start + size], max_bits)
        for start, size in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist())
    ]
    u, v = zip(*parts)
    return np.concatenate(u), np.concatenate(v)


def _shared(indexed: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key others share, with the number ``n`` of those.

    Spark sizes exploded rows by the file they come from, a few bytes for all variants of a
    fingerprint, so neither side is ever broadcast.
    """
    shared = indexed.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return indexed.join(shared.hint("merge"), keys)


def _linked(members: DataFrame, keys: list[str], max_bits: int, block: int) -> DataFrame:
    """``u, v``: links inside buckets of ``n`` members.

    A bucket of more than ``block`` fingerprints is cut into blocks, every two of which meet in
    a task of their own, so no task gets more than about twice the block.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    cells = (
        members.withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            *keys, "fp", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")
        )
    )

    names = [*keys, "a", "b"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            last = batch is None
            columns = [] if last else [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                columns = held if last else [np.concatenate(x) for x in zip(held, columns)]
            if not columns or not len(columns[0]):
                continue
            changes = np.any([c[1:] != c[:-1] for c in columns[:-1]], axis=0)
            starts = np.concatenate([[0], np.flatnonzero(changes) + 1, [len(columns[0])]])
            if not last:
                # The last cell may go on in the next batch.
                held = [c[starts[-2] :] for c in columns]
                starts = starts[:-1]
            u, v = _links_of_cells(columns[-1], starts, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    # Cells are small and most hold two rows, so a task works through many of them at a time.
    dealt = cells.select(*names, "fp").repartition(*names).sortWithinPartitions(*names)
    return dealt.mapInArrow(link, "u bigint, v bigint")


def fingerprint_links(
    fps: DataFrame, max_bits: int = 3, block: int = BLOCK, refine: int = REFINE
) -> DataFrame:
    """``u, v``: links between distinct fingerprints that connect all within ``max_bits`` bits.

    ``fps`` has one row per distinct ``fp``.  Fingerprints that share a variant agree in its
    segment but for the bit taken out.  Where more than ``refine`` of them do, they are indexed
    a second time, by variants of the bits outside that segment, which again differ in at most
    ``max_bits`` bits; so even a bucket of very many stays cheap.
    """
    count = max(2, max_bits // 2 + 1)
    segments = _segments(0, BITS, count)
    rest = F.col("fp").bitwiseAND(F.col("key.mask"))
    indexed = fps.select("fp", F.explode(_variants(segments)).alias("key")).select(
        "fp", "key.hole", rest.alias("rest")
    )
    first = ["hole", "rest"]
    members = stage(_shared(indexed, first), "simhash-members")
    small = _linked(members.where(F.col("n") <= refine), first, max_bits, block)
    outside = F.lit(None)
    for low, high in segments:
        parts = [x for r in ((0, low), (high, BITS)) if r[0] < r[1] for x in _segments(*r, count)]
        inside = (F.col("hole") >= low) & (F.col("hole") < high)
        outside = F.when(inside, _variants(parts)).otherwise(outside)
    again = (
        members.where(F.col("n") > refine)
        .select(*first, "fp", F.explode(outside).alias("key"))
        .select(*first, "fp", F.col("key.hole").alias("hole2"), rest.alias("rest2"))
    )
    second = [*first, "hole2", "rest2"]
    large = _linked(_shared(again, second), second, max_bits, block)
    found = small.unionByName(large)
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _classes(marked: DataFrame, max_bits: int) -> DataFrame:
    """``fp, root, component`` for the rows ``id, fp``: one root per component, and its smallest id."""
    nodes = stage(marked.groupBy("fp").agg(F.min("id").alias("id")), "simhash-fps")
    links = stage(fingerprint_links(nodes.select("fp"), max_bits), "simhash-links")
    roots = connected_components(links, "u", "v").select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = nodes.join(roots, "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    # Written, so that the rows of a component with very many fingerprints can be split.
    smallest = stage(
        rooted.groupBy("root").agg(F.min("id").alias("component")), "simhash-components"
    )
    return stage(rooted.join(smallest, "root").select("fp", "root", "component"), "simhash-classes")


def _marked(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``id, fp`` and ``more`` columns of every row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp"), *more)
    return stage(rows, "simhash")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3
) -> DataFrame:
    """``id, fp, component`` of every row; rows reachable by links of at most ``max_bits``
    differing bits share the component."""
    marked = _marked(docs, id_col, text_col)
    return marked.join(_classes(marked, max_bits), "fp").select("id", "fp", "component")


def simhash_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3
) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one, with the smallest id.

    Components are those of ``simhash_components``.  Between rows of the same id the choice
    goes by a hash of the row; of rows equal in all columns one stays.  Null ids come last.
    """
    row, keys = whole_row(docs)
    marked = _marked(docs, id_col, text_col, *keys)
    order = F.struct(F.col("id").isNull().alias("last"), "id", "h0", "h1")
    chosen = stage(
        marked.groupBy("fp")
        .agg(F.min(order).alias("best"))
        .join(_classes(marked, max_bits), "fp")
        .groupBy("root")
        .agg(F.min("best").alias("best"))
        .select("best.h0", "best.h1"),
        "simhash-chosen",
    )
    # Equal rows are combined before they travel, so many copies of a row are no hot key.
    single = docs.select(row, *keys).groupBy("h0", "h1").agg(F.first("row").alias("row"))
    return single.join(chosen, ["h0", "h1"], "left_semi").select("row.*")
