"""Quality scores by votes of the nearest labelled documents in a latent-semantic space.

A document is a bag of hashed byte trigrams and of binned surface terms (repeated neighbouring
words, repeated words and lines, capitals, symbols, digits, length).  Weighted terms are
projected on the leading singular vectors of a bounded labelled sample.  Every document is
compared with every labelled vector by exact cosine products, in blocks; the nearest labelled
vectors vote with their labels, weighted by a power of their similarity.

Defined cases: a null or empty text is a document with surface terms only and is scored like
any other; without labelled rows every score is 0.5; of equally similar labelled vectors those
with the smaller sample position vote; equal texts get equal scores up to rounding.  Texts are
read whole.  Other columns of the documents are never looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corpusweave.llm.common import bounded_batches, crc_fold, labelled_sample, utf8

#: Most labelled rows that the space is fitted on and that vote; bounds what is broadcast.
MAX_LABELLED = 4096
#: Rows whose CRC-32 leaves this remainder are never learned from.
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

TERMS, RANK = 4096, 64
NEIGHBOURS, POWER = 25, 32.0
#: Documents and labelled vectors that are multiplied at a time.
DOC_BLOCK, LABEL_BLOCK = 256, 2048

BINS = 8
_EDGES = np.array([0.01, 0.03, 0.06, 0.12, 0.25, 0.5, 0.75])
SURFACE = ("repeats", "reuse", "same_lines", "capitals", "symbols", "digits", "length")
#: Share of the squared norm that surface terms get.
SURFACE_SHARE = 0.3


def trigram_counts(text: bytes) -> np.ndarray:
    """Counts of hashed byte trigrams, case kept."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(TERMS, np.float32)
    # Odd multipliers from the golden ratio, one per place; the top bits are kept.
    h = b[:-2] * np.uint32(0x9E3779B1)
    h ^= b[1:-1] * np.uint32(0x85EBCA77)
    h ^= b[2:] * np.uint32(0xC2B2AE3D)
    h *= np.uint32(0x27D4EB2F)
    return np.bincount(h >> np.uint32(20), minlength=TERMS).astype(np.float32)


def surface_bins(text: bytes) -> list[int]:
    """The bin of each surface statistic."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x]
    n, size = max(1, len(words)), max(1, len(text))
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower = c[65:91].sum(), c[97:123].sum()
    symbols = c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum()
    symbols -= c[46] + c[44] + c[39]
    ratios = [
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        upper / max(1, upper + lower),
        4 * symbols / size,
        4 * c[48:58].sum() / size,
    ]
    return [*np.searchsorted(_EDGES, ratios).tolist(), min(BINS - 1, int(np.log2(n + 1) / 2))]


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def _counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    grams = np.stack([trigram_counts(t) for t in texts])
    surface = np.zeros((len(texts), len(SURFACE) * BINS), np.float32)
    for row, text in zip(surface, texts):
        row[[i * BINS + b for i, b in enumerate(surface_bins(text))]] = 1
    return grams, surface


@dataclass(frozen=True)
class QualityModel:
    gram_weights: np.ndarray
    surface_weights: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def weighted(self, grams: np.ndarray, surface: np.ndarray) -> np.ndarray:
        share = np.sqrt(np.float32(SURFACE_SHARE))
        rest = np.sqrt(np.float32(1 - SURFACE_SHARE))
        return np.hstack(
            [
                rest * _unit(np.log1p(grams) * self.gram_weights),
                share * _unit(surface * self.surface_weights),
            ]
        )

    def embed(self, texts: list[bytes]) -> np.ndarray:
        return _unit(self.weighted(*_counts(texts)) @ self.space)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        out = [
            vote(self.embed(texts[i : i + DOC_BLOCK]), self.vectors, self.labels)
            for i in range(0, len(texts), DOC_BLOCK)
        ]
        return np.concatenate(out) if out else np.empty(0)


def vote(
    docs: np.ndarray,
    vectors: np.ndarray,
    labels: np.ndarray,
    neighbours: int = NEIGHBOURS,
    block: int = LABEL_BLOCK,
) -> np.ndarray:
    """Similarity-weighted mean label of the nearest vectors; exact, one block after another."""
    best = np.empty((len(docs), 0), np.float32)
    said = np.empty((len(docs), 0), labels.dtype)
    for at in range(0, len(vectors), block):
        near = docs @ vectors[at : at + block].T
        # Held ones come first, in the order of their positions among equals.
        best = np.hstack([best, near])
        said = np.hstack([said, np.broadcast_to(labels[at : at + block], near.shape)])
        if best.shape[1] > neighbours:
            edge = -np.partition(-best, neighbours - 1, axis=1)[:, neighbours - 1 : neighbours]
            above = best > edge
            # As many of those at the edge as there is room for, from the front.
            tied = best == edge
            room = neighbours - above.sum(axis=1, keepdims=True)
            chosen = above | (tied & (np.cumsum(tied, axis=1) <= room))
            top = np.nonzero(chosen)[1].reshape(len(best), neighbours)
            best, said = np.take_along_axis(best, top, 1), np.take_along_axis(said, top, 1)
    weights = np.maximum(best.astype(np.float64), 1e-3) ** POWER
    return np.clip((weights * said).sum(1) / weights.sum(1), 0.0, 1.0)


def _leading_directions(rows: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors by randomised subspace iteration (Halko et al., 2011)."""
    rng = np.random.default_rng(7)
    probe = rows @ rng.standard_normal((rows.shape[1], rank + 16)).astype(np.float32)
    for _ in range(3):
        probe, _ = np.linalg.qr(rows @ (rows.T @ probe))
    _, _, right = np.linalg.svd(probe.T @ rows, full_matrices=False)
    return np.ascontiguousarray(right[:rank].T)


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "quality",
    limit: int = MAX_LABELLED,
) -> QualityModel:
    """The space and the labelled vectors, from at most ``limit`` labelled rows."""
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, FOLDS, HELD_OUT, limit, id_col, text_col)

    def count(batches):
        for batch in batches:
            rows = []
            for text, said in zip(batch["text"], batch["label"]):
                grams = trigram_counts(text)
                at = np.flatnonzero(grams)
                rows.append(
                    (
                        at.astype(np.uint16).tobytes(),
                        grams[at].astype(np.uint32).tobytes(),
                        bytes(surface_bins(text)),
                        said,
                    )
                )
            yield pd.DataFrame(rows, columns=["at", "n", "bins", "label"])

    counted = sample.select(utf8(F.col("text")).alias("text"), "label").mapInPandas(
        count, "at binary, n binary, bins binary, label int"
    )
    rows = sorted((bytes(r.at), bytes(r.n), bytes(r.bins), r.label) for r in counted.collect())
    grams = np.zeros((len(rows), TERMS), np.float32)
    surface = np.zeros((len(rows), len(SURFACE) * BINS), np.float32)
    for i, (at, n, bins, _) in enumerate(rows):
        grams[i, np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.uint32)
        surface[i, [j * BINS + b for j, b in enumerate(bins)]] = 1
    said = np.array([r[3] for r in rows], np.float32)
    n = len(rows)
    model = QualityModel(
        (np.log((1 + n) / (1 + (grams > 0).sum(0))) + 1).astype(np.float32),
        np.log((2 + n) / (1 + surface.sum(0))).astype(np.float32),
        np.zeros((TERMS + len(SURFACE) * BINS, 0), np.float32),
        np.zeros((0, 0), np.float32),
        said,
    )
    if not n:
        return model
    weighted = model.weighted(grams, surface)
    space = _leading_directions(weighted, min(RANK, n))
    return QualityModel(
        model.gram_weights, model.surface_weights, space, _unit(weighted @ space), said
    )


def quality_score(model: Broadcast):
    """A column function: the score of a text, from 0 to 1, by a broadcast ``QualityModel``."""

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.scores(texts.tolist()))

    return lambda text: score(utf8(text))


def drop_low_quality(
    docs: DataFrame, model: Broadcast, text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The documents that reach the threshold, with all their columns."""
    bounded_batches(docs.sparkSession)
    return docs.where(quality_score(model)(F.col(text_col)) >= threshold)


def held_out(key: Column) -> Column:
    return crc_fold(key, FOLDS) == HELD_OUT
