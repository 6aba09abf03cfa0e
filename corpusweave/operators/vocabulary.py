"""Vocabulary tables ``id, piece, score, type``: deriving, merging, shrinking, comparing.

A derived vocabulary is bounded by its declared size, so ranking its rows in one window is
fine; vocabularies that are given may have any size and are put in order by ranges.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.functions.text import WORD, words
from corpusweave.plans.ordering import with_row_index
from corpusweave.plans.partitions import spread
from corpusweave.plans.staging import stage

# Piece types, the word-start marker, and the control pieces with ids 0 to 2.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED = "NORMAL", "UNKNOWN", "CONTROL", "USER_DEFINED"
WORD_START = "▁"
RESERVED = (("<unk>", UNKNOWN), ("<s>", CONTROL), ("</s>", CONTROL))
SCHEMA = "id int, piece string, score double, type string"


def candidate_pieces(text: Column, split_digits: bool = True) -> Column:
    """Words with a start marker; digits become pieces of their own on request."""
    marked = F.regexp_replace(text, F.lit(f"({WORD})"), F.lit(f"{WORD_START}$1"))
    if split_digits:
        # A digit is cut off on both sides; the marker stays with what precedes it.
        marked = F.regexp_replace(marked, F.lit(r"(\p{Nd})"), F.lit(" $1 "))
    return words(marked)


def corpus_vocab(
    docs: DataFrame,
    text_col: str,
    vocab_size: int = 32_000,
    user_symbols: Sequence[str] = (),
    split_digits: bool = True,
) -> DataFrame:
    """The ``vocab_size`` pieces of a corpus: reserved, user-defined, then the most frequent.

    The score of a counted piece is the logarithm of its share.
    """
    fixed = [(p, 0.0, t) for p, t in RESERVED] + [(p, 0.0, USER_DEFINED) for p in user_symbols]
    free = vocab_size - len(fixed)
    if free < 0:
        raise ValueError(f"{len(fixed)} fixed pieces exceed vocab_size={vocab_size}")
    # Words are counted first, so that only distinct words are marked and cut into pieces.
    spoken = spread(docs.select(text_col)).select(F.explode(words(F.col(text_col))).alias("word"))
    pieces = (
        spoken.groupBy("word")
        .count()
        .select(F.explode(candidate_pieces(F.col("word"), split_digits)).alias("piece"), "count")
    )
    counts = stage(pieces.groupBy("piece").agg(F.sum("count").alias("count")), "piece-counts")
    total = counts.agg(F.sum("count").alias("total")).first()["total"] or 1
    ranked = (
        counts.where(~F.col("piece").isin([p for p, _, _ in fixed]))
        .orderBy(F.col("count").desc(), "piece")
        .limit(free)
    )
    place = F.row_number().over(Window.orderBy(F.col("count").desc(), "piece"))
    counted = ranked.select(
        (place + (len(fixed) - 1)).cast("int").alias("id"),
        "piece",
        F.log(F.col("count") / float(total)).alias("score"),
        F.lit(NORMAL).alias("type"),
    )
    reserved = docs.sparkSession.createDataFrame(
        [(i, *row) for i, row in enumerate(fixed)], SCHEMA
    )
    return reserved.unionByName(counted)


def vocab_frequencies(vocab: DataFrame, model_type: str = "unigram") -> DataFrame:
    """``id, piece, freq`` of the pieces with a negative score: their share per million, cut off."""
    if model_type != "unigram":
        raise ValueError(f"frequencies follow from unigram scores only, got {model_type!r}")
    return vocab.where("score < 0").select(
        "id",
        F.replace("piece", F.lit(WORD_START), F.lit(" ")).alias("piece"),
        (F.exp("score") * 1_000_000).cast("bigint").alias("freq"),
    )


def write_frequencies(frequencies: DataFrame, folder: str) -> None:
    """Lines ``piece<TAB>frequency`` in id order."""
    lines = F.concat_ws("\t", "piece", F.col("freq").cast("string")).alias("value")
    frequencies.orderBy("id").select(lines).write.text(folder)


def merge_vocab(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the normal and user-defined pieces that only ``new`` has, in its order.

    Normal pieces rank below every old one: the smallest old score is added to theirs.
    """
    bounds = old.agg(F.min("score").alias("least"), F.max("id").alias("last")).first()
    added = new.where(F.col("type").isin(NORMAL, USER_DEFINED)).join(
        old.select("piece"), "piece", "left_anti"
    )
    moved = with_row_index(added, ["id"], "_place").select(
        (F.col("_place") + (bounds["last"] + 1)).cast("int").alias("id"),
        "piece",
        F.when(F.col("type") == NORMAL, F.col("score") + bounds["least"])
        .otherwise(F.lit(0.0))
        .alias("score"),
        "type",
    )
    return old.select("id", "piece", "score", "type").unionByName(moved)


def shrink_vocab(
    vocab: DataFrame,
    target_size: int | None = None,
    remove_count: int | None = None,
    by_score: bool = False,
) -> DataFrame:
    """The first ``target_size`` pieces, or all but ``remove_count``: the last ones, or with
    ``by_score`` those with the lowest scores (the smaller id first).  Survivors keep order
    and ids are closed up."""
    if target_size is not None:
        kept = vocab.orderBy("id").limit(target_size)
    elif remove_count is not None and remove_count > 0:
        size = vocab.count()
        if remove_count >= size:
            raise ValueError(f"cannot remove {remove_count} of {size} pieces")
        order = ["score", "id"] if by_score else [F.col("id").desc()]
        gone = vocab.orderBy(*order).limit(remove_count).select("id")
        kept = vocab.join(gone, "id", "left_anti")
    else:
        warnings.warn("no size given, the vocabulary stays as it is", stacklevel=2)
        return vocab
    placed = with_row_index(kept, ["id"], "_place")
    return placed.withColumn("id", F.col("_place").cast("int")).drop("_place")


def diff_vocab(old: DataFrame, new: DataFrame, token: str = "piece") -> DataFrame:
    """Sorted ids of the tokens that only ``new`` has."""
    return new.join(old.select(token), token, "left_anti").select("id").orderBy("id")
