"""Near-duplicate documents by min-hash signatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions import shingles as sh
from corpusweave.functions.text import word_count, words
from corpusweave.operators.components import connected_components
from corpusweave.plans.partitions import spread
from corpusweave.plans.skew import HOT_ROWS, join_facts
from corpusweave.plans.staging import stage_observed

#: By precision: the hash of a shingle in each hash function.
_HASHES = {
    32: {"sha1": sh.sha1_residue, "xxhash": sh.xxhash_residue},
    64: {"sha1": sh.sha1_bits, "xxhash": sh.xxhash_bits},
}
#: Numbers of the hash family that are held at a time.
TILE = 1 << 20


@dataclass(frozen=True)
class MinhashConfig:
    """Defaults: 14 buckets of 8 hashes over 5-word shingles."""

    num_buckets: int = 14
    hashes_per_bucket: int = 8
    n_grams: int = 5
    hash_fc: str = "sha1"
    seed: int = 1
    hot_rows: int = HOT_ROWS
    precision: int = 32

    def __post_init__(self):
        if self.precision not in _HASHES:
            raise ValueError(f"precision must be one of {sorted(_HASHES)}, got {self.precision!r}")
        if self.hash_fc not in _HASHES[self.precision]:
            raise ValueError(f"hash_fc must be one of {sorted(_HASHES[32])}, got {self.hash_fc!r}")


def minhash_signatures(
    docs: DataFrame, id_col: str, text_col: str, config: MinhashConfig = MinhashConfig()
) -> DataFrame:
    """``id_col, signature``; texts with fewer words than a shingle have no row.

    Shingling and hashing are built-in expressions, the minima over the hash family one
    numpy call per bounded tile of shingles; nothing is shuffled.
    """
    return _signatures(spread(docs.select(id_col, text_col)), id_col, text_col, config)


def _signatures(docs: DataFrame, id_col: str, text_col: str, config: MinhashConfig) -> DataFrame:
    a, b = sh.hash_family(config.num_buckets * config.hashes_per_bucket, config.seed)
    residue, wide = _HASHES[config.precision][config.hash_fc], config.precision == 64
    tokens = docs.select(
        id_col, words(sh.normalize_text(F.col(text_col))).alias("_tokens")
    )
    # A shingle that occurs twice does not change a minimum.
    grams = sh.word_ngrams(F.col("_tokens"), config.n_grams, distinct=False)
    hashed = tokens.select(id_col, F.transform(grams, residue).alias("_x"))

    def family(x: np.ndarray) -> np.ndarray:
        """The numbers of all hash functions, one row per shingle."""
        if not wide:
            return (x[:, None] * np.array(a, np.int64) + np.array(b, np.int64)) % sh.PRIME
        odd = np.array(a, np.uint64) | np.uint64(1)
        spread = x.astype(np.uint64)[:, None] * odd + np.array(b, np.uint64)
        return (spread >> np.uint64(1)).astype(np.int64)

    def minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = max(1, TILE // len(a))
        for batch in batches:
            # Short texts are left out here: a filter above would normalise every text twice.
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column(1)), 0))
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(lists)), sizes)
            out = np.full((len(lists), len(a)), np.iinfo(np.int64).max, dtype=np.int64)
            for at in range(0, len(values), tile):
                own = owner[at : at + tile]
                starts = np.flatnonzero(np.diff(own, prepend=-1))
                low = np.minimum.reduceat(family(values[at : at + tile]), starts, axis=0)
                out[own[starts]] = np.minimum(out[own[starts]], low)
            offsets = pa.array(np.arange(len(lists) + 1, dtype=np.int32) * len(a))
            signature = pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), signature], names=[id_col, "signature"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return hashed.mapInArrow(minima, f"`{id_col}` {id_type}, signature array<bigint>")


def minhash_buckets(
    signatures: DataFrame,
    id_col: str,
    config: MinhashConfig = MinhashConfig(),
    total_docs: int | None = None,
) -> DataFrame:
    """``src, dst``: each document tied to the smallest one that shares a bucket with it.

    A star per bucket holds the same components as all pairs of the bucket, with one edge
    per member; a bucket with a third of all documents costs a third of the edges.  The
    signatures are read for the sizes of the buckets, for the hot ones and for the members, so
    they are written first, unless ``total_docs`` says that they are written and counted.
    """
    if total_docs is None:
        signatures, seen = stage_observed(signatures, "signatures", docs=F.count("*"))
        total_docs = seen["docs"]
    r = config.hashes_per_bucket
    bands = signatures.select(
        F.col(id_col).alias("dst"),
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.lit(config.num_buckets - 1)),
                lambda i: F.slice("signature", i * r + 1, r),
            )
        ).alias("bucket", "band"),
    ).select(
        "dst",
        "bucket",
        F.xxhash64("band").alias("h1"),
        F.xxhash64(F.lit(7), "band").alias("h2"),
    )
    keys = ["bucket", "h1", "h2"]
    facts = (
        bands.groupBy(*keys)
        .agg(F.min("dst").alias("src"), F.count("*").alias("members"))
        .where(F.col("members") > 1)
    )
    # Each document is in a bucket at most once, so no band has more rows than documents.
    return (
        join_facts(
            bands, facts, keys, "members", ["src"], config.hot_rows, total_rows=total_docs
        )
        .where(F.col("src") < F.col("dst"))
        .select("src", "dst")
        .distinct()
    )


def minhash_clusters(
    docs: DataFrame, id_col: str, text_col: str, config: MinhashConfig = MinhashConfig()
) -> DataFrame:
    """``node, component`` of all documents that have a near duplicate."""
    return _clusters(spread(docs.select(id_col, text_col)), id_col, text_col, config)


def _clusters(docs: DataFrame, id_col: str, text_col: str, config: MinhashConfig) -> DataFrame:
    # The bands are read twice (sizes, then members), so the signatures are written once.
    signatures, seen = stage_observed(
        _signatures(docs, id_col, text_col, config), "signatures", docs=F.count("*")
    )
    edges = minhash_buckets(signatures, id_col, config, seen["docs"])
    return connected_components(edges, "src", "dst", hot_rows=config.hot_rows)


def count_tokens(docs: DataFrame, text_col: str, tokens=word_count) -> DataFrame:
    """Add ``token_count``; words by default, any column function otherwise."""
    return docs.withColumn("token_count", tokens(F.col(text_col)).cast("bigint"))


def mark_duplicates(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    config: MinhashConfig = MinhashConfig(),
    segment: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``docs`` with ``token_count`` and ``is_duplicate``; the smallest id of a cluster is none.

    ``segment`` sets words apart by blanks where the language does not.
    """
    docs = spread(docs)
    if segment:
        texts = docs.select(id_col, segment(F.col(text_col)).alias(text_col))
        clusters = _clusters(texts, id_col, text_col, config)
        tokens = lambda text: word_count(segment(text))
    else:
        clusters, tokens = _clusters(docs, id_col, text_col, config), word_count
    removed = clusters.where("node <> component").select(
        F.col("node").alias(id_col), F.lit(True).alias("is_duplicate")
    )
    return (
        count_tokens(docs, text_col, tokens)
        .join(removed, id_col, "left")
        .withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))
    )


def minhash_dedup(
    docs: DataFrame, id_col: str, text_col: str, config: MinhashConfig = MinhashConfig()
) -> tuple[DataFrame, DataFrame]:
    """Kept and removed documents, both with ``token_count``; the smallest id of a cluster stays."""
    judged = mark_duplicates(docs, id_col, text_col, config)
    return (
        judged.where("not is_duplicate").drop("is_duplicate"),
        judged.where("is_duplicate").drop("is_duplicate"),
    )
