"""Shards of nearly equal bytes by histogram sort.

Rows are ordered by a hash of their text, then by a hash of their id, so that equal texts are
neighbours.  The exact bytes below candidate boundaries are counted in one aggregation per
round, and the candidates around each wanted boundary are refined until every boundary is
settled; then the rows are exchanged once.  A round gathers a fixed number of counts, however
many rows there are, and hashes of 60 bits end the refining after a few rounds.

Boundary ``k`` of ``n`` shards is the end of a group of equal texts that is nearest to
``k / n`` of all bytes, if it is within the tolerance; otherwise, as with groups too large
for one shard, that group is cut between ids, nearest to the wanted place.

Defined cases: the size of a text is its UTF-8 bytes plus 1, of a null text 1; null and empty
texts are equal texts; a null id counts as an empty text; rows equal in text and id stay
together; of two boundaries equally near the lower is taken; shards of a small table may be
empty.  Other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.plans.ordering import with_row_index
from corpusweave.plans.staging import stage

SHARDS = 8
#: Permitted distance of a boundary, in thousandths of all bytes divided by the shards.
TOLERANCE = 5
#: Candidates per wanted boundary and round.
PROBES = 256
KEY_BITS = 60


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def _key(value: Column) -> Column:
    """60 bits of the MD5 of a text."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def text_key(text: Column) -> Column:
    return _key(text)


def id_key(key: Column) -> Column:
    return _key(key)


@dataclass(frozen=True, order=True)
class Splitter:
    """Rows whose text key and id key are at least these lie behind the boundary."""

    text: int
    id: int


@dataclass
class _Search:
    """A boundary that is still searched: among text keys, or ids of the group ``text``."""

    wanted: int  # bytes below the boundary, times the number of shards
    low: int
    high: int
    below: int
    text: int | None = None
    found: Splitter | None = None


def _histogram(keyed: DataFrame, searches: list[_Search], probes: int) -> dict:
    """Exact bytes, and smallest and largest key, of every candidate range."""
    bin_, place = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    for j, s in enumerate(searches):
        width = -(-(s.high - s.low) // probes)
        name = "t" if s.text is None else "g"
        key = F.col(name)
        inside = (key >= s.low) & (key < s.high)
        if s.text is not None:
            inside &= F.col("t") == s.text
        cell = F.expr(f"({name} - {s.low}L) div {width}L")
        bin_ = F.when(inside, (F.lit(j * probes) + cell).cast("int")).otherwise(bin_)
        place = F.when(inside, key).otherwise(place)
    rows = (
        keyed.select(bin_.alias("bin"), place.alias("key"), "size")
        .where("bin is not null")
        .groupBy("bin")
        .agg(F.sum("size").alias("bytes"), F.min("key").alias("first"), F.max("key").alias("last"))
    )
    return {r["bin"]: (r["bytes"], r["first"], r["last"]) for r in rows.collect()}


def find_splitters(
    keyed: DataFrame, shards: int = SHARDS, tolerance: int = TOLERANCE, probes: int = PROBES
) -> list[Splitter]:
    """The ``shards - 1`` boundaries for rows with text key ``t``, id key ``g`` and ``size``."""
    total = keyed.agg(F.sum("size")).first()[0]
    top = 1 << KEY_BITS
    if not total:
        return [Splitter(top, 0)] * (shards - 1)
    searches = [_Search(k * total, 0, top, 0) for k in range(1, shards)]
    while any(s.found is None for s in searches):
        # Searches in the same range share one histogram.
        ranges = {(s.text, s.low, s.high): s for s in searches if s.found is None}
        order = list(ranges)
        counts = _histogram(keyed, list(ranges.values()), probes)
        for s in searches:
            if s.found is None:
                j = order.index((s.text, s.low, s.high))
                _refine(s, counts, j, shards, total, tolerance, probes)
    return sorted(s.found for s in searches)


def _refine(
    s: _Search, counts: dict, j: int, shards: int, total: int, tolerance: int, probes: int
) -> None:
    """Go on in the candidate range that holds the wanted byte, or settle the boundary."""
    for b in range(j * probes, (j + 1) * probes):
        bytes_, first, last = counts.get(b, (0, None, None))
        if not bytes_ or (s.below + bytes_) * shards < s.wanted:
            s.below += bytes_
            continue
        if first != last:
            s.low, s.high = first, last + 1
            return
        before = s.wanted - s.below * shards
        after = (s.below + bytes_) * shards - s.wanted
        near = min(before, after)
        if s.text is not None:
            s.found = Splitter(s.text, first if before <= after else first + 1)
        elif near * 1000 <= tolerance * total:
            s.found = Splitter(first if before <= after else first + 1, 0)
        else:
            s.text, s.low, s.high = first, 0, 1 << KEY_BITS
        return
    raise AssertionError("the wanted byte lies in no candidate range")


def shard_of(t: Column, g: Column, splitters: list[Splitter]) -> Column:
    """The number of boundaries at or below a row."""
    shard = F.lit(0)
    for s in splitters:
        behind = (t > s.text) | ((t == s.text) & (g >= s.id))
        shard = shard + behind.cast("int")
    return shard


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"),
        size_of(F.col(text_col)).alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).alias("text_crc32"),
        text_key(F.col(text_col)).alias("t"),
        id_key(F.col(id_col)).alias("g"),
    )


def assign_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
    tolerance: int = TOLERANCE,
) -> DataFrame:
    """``id, size, text_crc32, shard, slot``: each row's shard and its place there."""
    keyed = stage(_keyed(docs, id_col, text_col), "shard-keys")
    splitters = find_splitters(keyed, shards, tolerance)
    # The one exchange: the order of the keys is that of shards and slots.
    placed = with_row_index(keyed, ["t", "g"], "at").withColumn(
        "shard", shard_of(F.col("t"), F.col("g"), splitters)
    )
    starts = {r["shard"]: r["at"] for r in placed.groupBy("shard").agg(F.min("at").alias("at")).collect()}
    start = F.lit(0).cast("bigint")
    for shard, at in starts.items():
        start = F.when(F.col("shard") == shard, F.lit(at).cast("bigint")).otherwise(start)
    return placed.select("id", "size", "text_crc32", "shard", (F.col("at") - start).alias("slot"))


def write_shards(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
    tolerance: int = TOLERANCE,
) -> None:
    """Write ``docs`` as Parquet below ``path``, one folder ``shard=k`` per shard, in slot order."""
    keyed = stage(_keyed(docs, id_col, text_col).select("t", "g", "size"), "shard-keys")
    splitters = find_splitters(keyed, shards, tolerance)
    t, g = text_key(F.col(text_col)), id_key(F.col(id_col))
    order = [F.col("shard"), t, g]
    (
        docs.withColumn("shard", shard_of(t, g, splitters))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.partitionBy("shard")
        .parquet(path)
    )
