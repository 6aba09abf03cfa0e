"""Start vectors for new tokens from the vectors of the pieces they used to be split into."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.plans.skew import HOT_ROWS, join_facts

# Pieces that only mark a blank or a line break.
SPACE_MARKERS = ("▁", "Ġ", "Ċ", "ÂĊ")


def _mean(column: str):
    """Mean vector; partial means are combined map-side."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(column).cast("array<double>"))))


def _with_vectors(rows: DataFrame, vectors: DataFrame, hot_rows: int) -> DataFrame:
    """Rows with the vector of their ``piece``; the rows of a frequent piece are spread."""
    uses = rows.groupBy("piece").agg(F.count("*").alias("uses"))
    facts = vectors.select(F.col("token").alias("piece"), "vec").join(uses, "piece")
    return join_facts(rows, facts, ["piece"], "uses", ["vec"], hot_rows)


def _init(tokens: DataFrame, old: DataFrame, computed: DataFrame) -> DataFrame:
    """Old vectors where the token was known, computed ones otherwise."""
    known = old.select("token", F.col("vec").cast("array<double>").alias("_known"))
    return (
        tokens.select("token")
        .join(known, "token", "left")
        .join(computed, "token", "left")
        .select("token", F.coalesce("_known", "_new").alias("vec"))
    )


def init_vectors_mean(
    tokens: DataFrame,
    old: DataFrame,
    segmentation: DataFrame,
    mode: str = "pieces",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``token, vec``: known tokens keep their vector, the others get a mean.

    ``old`` is ``token, vec``; ``segmentation`` is ``token, pos, piece``.  ``pieces`` takes
    the mean over a token's pieces, ``mean`` the mean over all old vectors.
    """
    if mode not in ("pieces", "mean"):
        raise ValueError(f"mode must be 'pieces' or 'mean', got {mode!r}")
    if mode == "mean":
        overall = [float(x) for x in old.agg(_mean("vec").alias("m")).first()["m"]]
        computed = tokens.select("token", F.lit(overall).alias("_new"))
        return _init(tokens, old, computed)
    unknown = segmentation.join(old.select("token"), "token", "left_anti")
    pieces = _with_vectors(unknown.select("token", "piece"), old, hot_rows).where("vec IS NOT NULL")
    return _init(tokens, old, pieces.groupBy("token").agg(_mean("vec").alias("_new")))


def init_vectors_first(
    tokens: DataFrame,
    old: DataFrame,
    segmentation: DataFrame,
    clear_tokenization: bool = False,
    special_pieces: Sequence[str] = (),
    unk_piece: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``token, vec``: known tokens keep their vector, the others get that of their first piece.

    ``clear_tokenization`` passes over special pieces, blank markers and the unknown piece,
    unless the token consists of nothing else.
    """
    unknown = segmentation.join(old.select("token"), "token", "left_anti")
    first = F.min_by("piece", "pos")
    if clear_tokenization:
        skipped = [*special_pieces, *SPACE_MARKERS, *([unk_piece] if unk_piece else [])]
        usable = F.when(~F.col("piece").isin(skipped), F.col("pos"))
        # min_by ignores rows whose ordering is null.
        first = F.coalesce(F.min_by("piece", usable), first)
    chosen = unknown.groupBy("token").agg(first.alias("piece"))
    computed = _with_vectors(chosen, old, hot_rows).select(
        "token", F.col("vec").cast("array<double>").alias("_new")
    )
    return _init(tokens, old, computed)
