"""Tokenizers as column functions from text to token ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.batches import map_present
from corpusweave.operators.formatting import ColumnFn

#: Texts in, one list of token ids per text out.
EncodeFn = Callable[[list[str]], Sequence[Sequence[int]]]


@dataclass(frozen=True)
class Tokenizer:
    """``encode`` maps a text column to ``array<int>``; an unk id of 0 is a valid id."""

    encode: ColumnFn
    unk_id: int | None = None
    pad_id: int | None = None


def python_tokenizer(
    load: Callable[[], EncodeFn], unk_id: int | None = None, pad_id: int | None = None
) -> Tokenizer:
    """Tokenizer that ``load`` opens once per Python worker; null texts give null."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield map_present(texts, lambda present: map(list, model(present)))

    return Tokenizer(encode, unk_id, pad_id)


def word_tokenizer(
    vocab: DataFrame, unk_id: int = 0, pad_id: int | None = None, max_size: int = 1_000_000
) -> Tokenizer:
    """Blank-separated words looked up in a ``piece, id`` table, ``unk_id`` for the others.

    A vocabulary is the tokenizer's model and goes to every worker; one with more than
    ``max_size`` pieces is refused.
    """
    rows = vocab.select("piece", "id").limit(max_size + 1).collect()
    if len(rows) > max_size:
        raise ValueError(f"the vocabulary has more than {max_size} pieces")
    ids: Mapping[str, int] = {r["piece"]: r["id"] for r in rows}

    def load() -> EncodeFn:
        return lambda texts: [[ids.get(w, unk_id) for w in t.split()] for t in texts]

    return python_tokenizer(load, unk_id, pad_id)


def tokenize_pairs(
    df: DataFrame,
    source: str,
    target: str,
    tokenizer: Tokenizer,
    max_source_length: int = 256,
    max_target_length: int = 256,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``input_ids, labels`` of a text pair, truncated; other columns go unless kept."""
    return df.select(
        *keep,
        F.slice(tokenizer.encode(F.col(source)), 1, max_source_length).alias("input_ids"),
        F.slice(tokenizer.encode(F.col(target)), 1, max_target_length).alias("labels"),
    )
