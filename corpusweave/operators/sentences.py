"""Removal of lines that already occurred in the corpus."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.shingles import line_key, normalize_text
from corpusweave.functions.text import word_count
from corpusweave.operators.minhash import count_tokens
from corpusweave.plans.partitions import spread
from corpusweave.plans.skew import HOT_ROWS, join_facts
from corpusweave.plans.staging import stage_observed

# End of a sentence, used when texts are split into sentences, and the same where
# no blank follows a full stop.
SENTENCE_END = r"(?<=[.!?…])\s+"
UNSPACED_SENTENCE_END = r"(?<=[。！？…｡។༎༏၊။])\s*|(?<=[.!?])\s+"


@dataclass(frozen=True)
class SentenceConfig:
    """``n_sentences`` consecutive lines (or sentences) are compared at a time."""

    n_sentences: int = 1
    split_sentences: bool = False
    only_dedup_in_index: bool = True
    min_doc_words: int = 0
    min_num_sentences: int = -1
    hot_rows: int = HOT_ROWS
    unspaced: bool = False

    def parts(self, text: Column) -> Column:
        if self.split_sentences:
            return F.split(text, UNSPACED_SENTENCE_END if self.unspaced else SENTENCE_END)
        return F.split(text, "\n")

    @property
    def separator(self) -> str:
        if self.split_sentences:
            return "" if self.unspaced else " "
        return "\n"


def sentence_signatures(
    docs: DataFrame, id_col: str, text_col: str, config: SentenceConfig = SentenceConfig()
) -> DataFrame:
    """``id_col, pos, h1, h2`` for each window of lines that holds a letter or digit.

    Windows are compared in normalised form; the texts themselves stay behind.
    """
    return _signatures(spread(docs.select(id_col, text_col)), id_col, text_col, config)


def _signatures(docs: DataFrame, id_col: str, text_col: str, config: SentenceConfig) -> DataFrame:
    parts, n = config.parts(F.col(text_col)), config.n_sentences
    if n == 1:
        spans = docs.select(id_col, F.posexplode(parts).alias("pos", "_span"))
        spans = spans.withColumn("_span", normalize_text(F.col("_span")))
    else:
        lined = docs.select(id_col, F.transform(parts, normalize_text).alias("_lines"))
        starts = F.when(F.size("_lines") >= n, F.sequence(F.lit(1), F.size("_lines") - (n - 1)))
        windows = F.transform(starts, lambda i: F.array_join(F.slice("_lines", i, n), "\n"))
        spans = lined.select(id_col, F.posexplode(windows).alias("pos", "_span"))
    keyed = spans.where(F.trim(F.translate("_span", "\n", "")) != "").select(
        id_col, "pos", line_key(F.col("_span")).alias("_key")
    )
    return keyed.select(id_col, "pos", "_key.h1", "_key.h2")


def find_duplicate_sentences(
    signatures: DataFrame,
    id_col: str,
    index: DataFrame | None = None,
    config: SentenceConfig = SentenceConfig(),
    total_rows: int | None = None,
) -> DataFrame:
    """``id_col, pos`` of every window that is not the first of its kind in id, position order.

    With an ``index`` (signatures of another corpus) windows that occur there are duplicates
    too, and with ``only_dedup_in_index`` only those are.  First occurrences and counts are
    combined map-side; a window that makes up a third of the corpus is joined by broadcast.
    Signatures are read several times, so they are written first, unless ``total_rows`` says that
    they are written and counted.
    """
    if total_rows is None:
        signatures, seen = stage_observed(signatures, "line-signatures", rows=F.count("*"))
        total_rows = seen["rows"]
    keys = ["h1", "h2"]
    at = F.struct(F.col(id_col), F.col("pos"))
    facts = signatures.groupBy(*keys).agg(F.min(at).alias("first"), F.count("*").alias("n"))
    repeated = F.lit(False) if index is not None and config.only_dedup_in_index else at > F.col("first")
    if index is not None:
        listed = index.select(*keys).distinct().withColumn("listed", F.lit(True))
        facts = facts.join(listed, keys, "left").where((F.col("n") > 1) | F.col("listed"))
        payload, duplicate = ["first", "listed"], repeated | F.coalesce("listed", F.lit(False))
    else:
        facts = facts.where(F.col("n") > 1)
        payload, duplicate = ["first"], repeated
    joined = join_facts(
        signatures, facts, keys, "n", payload, config.hot_rows, total_rows=total_rows
    )
    return joined.where(duplicate).select(id_col, "pos")


def sentence_dedup(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    index: DataFrame | None = None,
    config: SentenceConfig = SentenceConfig(),
    segment: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Documents without their duplicated windows, with ``token_count`` of the original text.

    A document goes when nothing is left of it, or when it was changed and now has fewer
    than ``min_doc_words`` words or ``min_num_sentences`` lines.  ``id_col`` must be unique.
    Only positions travel to the documents, and those of one document are bounded by it.
    ``segment`` sets words apart by blanks where the language does not; words are then counted
    so.
    """
    n = config.n_sentences

    def tokens(text: Column) -> Column:
        return word_count(segment(text) if segment else text)

    docs = spread(docs)
    # Counted once and matched once: written, so that the texts are normalised only once.
    signatures, seen = stage_observed(
        _signatures(docs, id_col, text_col, config), "line-signatures", rows=F.count("*")
    )
    positions = (
        find_duplicate_sentences(signatures, id_col, index, config, seen["rows"])
        .groupBy(id_col)
        .agg(F.collect_list("pos").alias("_dups"))
    )
    joined = count_tokens(docs, text_col, tokens).join(positions, id_col, "left")
    parts = config.parts(F.col(text_col))
    covered = F.flatten(F.transform("_dups", lambda p: F.sequence(p, p + (n - 1))))
    left = F.sort_array(
        F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), covered)
    )
    kept = joined.withColumn("_parts", parts).withColumn(
        "_kept", F.when(F.col("_dups").isNotNull(), F.transform(left, lambda i: F.get("_parts", i)))
    )
    changed = F.col("_dups").isNotNull()
    new_text = F.when(changed, F.array_join("_kept", config.separator)).otherwise(F.col(text_col))
    # A null text has no lines and stays as it is.
    drop = F.coalesce(F.trim(text_col) == "", F.lit(False))
    if config.min_doc_words > 0:
        drop |= changed & (tokens(F.col(text_col)) < config.min_doc_words)
    if config.min_num_sentences > 0:
        drop |= changed & (F.size("_kept") < config.min_num_sentences)
    return kept.withColumn(text_col, new_text).where(~F.coalesce(drop, F.lit(False))).drop("_parts", "_kept", "_dups")
