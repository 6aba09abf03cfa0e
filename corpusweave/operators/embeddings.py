"""Embedding texts, and filtering pairs by the similarity of their embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.batches import map_present
from corpusweave.operators.filters import Verdict
from corpusweave.operators.formatting import ColumnFn, field

#: Texts in, one vector per text out.
EmbedFn = Callable[[list[str]], Sequence[Sequence[float]]]


def hashed_ngram_embedder(dim: int = 64) -> Callable[[], EmbedFn]:
    """Counts of character pairs, hashed into ``dim`` cells; needs no model."""

    def load() -> EmbedFn:
        def embed(texts: list[str]) -> np.ndarray:
            flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
            owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            inside = owner[:-1] == owner[1:]
            cells = (flat[:-1] * 31 + flat[1:]) % dim + owner[:-1] * dim
            counts = np.bincount(cells[inside], minlength=len(texts) * dim)
            return counts.reshape(len(texts), dim).astype(np.float32)

        return embed

    return load


def embed_texts(load: Callable[[], EmbedFn], batch_size: int = 1024) -> ColumnFn:
    """Column function for a model that ``load`` opens once per Python worker.

    Null texts get a null vector and are not sent to the model.
    """

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()

        def vectors(texts: list[str]) -> Iterator[np.ndarray]:
            for start in range(0, len(texts), batch_size):
                for vector in model(texts[start : start + batch_size]):
                    yield np.asarray(vector, dtype=np.float32)

        for texts in batches:
            yield map_present(texts, vectors)

    return embed


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when a vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def translation_similarity(vectors: Sequence[str], sim_score: float) -> Verdict:
    """Keep pairs whose embeddings are more similar than ``sim_score``."""
    if len(vectors) != 2:
        raise ValueError(f"exactly two fields are compared, got {len(vectors)}")
    if not 0 <= sim_score <= 1:
        raise ValueError(f"sim_score must lie in [0, 1], got {sim_score}")
    first, second = (field(v) for v in vectors)
    missing = first.isNull() | second.isNull()
    return Verdict(
        F.coalesce(cosine(first, second) > sim_score, F.lit(False)),
        F.when(missing, F.lit("missing_embedding")),
    )


def with_pair_embeddings(
    df: DataFrame,
    fields: Sequence[str],
    embed: ColumnFn,
    query_prepare: ColumnFn | None = None,
    passage_prepare: ColumnFn | None = None,
    names: Sequence[str] = ("embedding_1", "embedding_2"),
) -> DataFrame:
    """Add the embeddings of two text fields, each prepared by its own function first."""
    if len(fields) != 2:
        raise ValueError(f"exactly two fields are embedded, got {len(fields)}")
    for path, prepare, name in zip(fields, (query_prepare, passage_prepare), names):
        text = field(path)
        df = df.withColumn(name, embed(prepare(text) if prepare else text))
    return df
