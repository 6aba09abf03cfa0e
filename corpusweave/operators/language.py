"""Language scores and the language filter."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.batches import map_present
from corpusweave.functions.text import newline_to_space
from corpusweave.operators.filters import Verdict, with_verdict
from corpusweave.operators.formatting import ColumnFn
from corpusweave.plans.partitions import spread
from corpusweave.plans.skew import join_facts
from corpusweave.plans.staging import stage

#: Texts in, one ``{language: score}`` per text out.
ScoresFn = Callable[[list[str]], Sequence[Mapping[str, float]]]

#: Log-probabilities are kept as integers of this unit, so that sums do not depend on order.
UNIT = 1_000_000
#: A model with at most so many cells (grams x languages) is broadcast and scores texts where
#: they are; a larger one is joined by shuffle.
BROADCAST_CELLS = 4_000_000
#: More labels than this are taken for a mistake in the choice of the label column.
MAX_LANGUAGES = 10_000


def _line(text: Column) -> Column:
    return F.lower(newline_to_space(text))


def char_ngrams(text: Column, n: int) -> Column:
    """Overlapping ``n``-character substrings of lower-cased, single-line text."""
    return F.regexp_extract_all(_line(text), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


@dataclass(frozen=True)
class LanguageModel:
    """Naive Bayes over character n-grams, add-one smoothed.

    ``table`` has one row per gram: how often it occurred (``n``) and ``entries``, the score
    ``s`` of each language number ``l`` in which it occurred; ``unseen`` holds the score of a
    gram of the model in the languages in which it did not.
    """

    table: DataFrame
    languages: tuple[str, ...]
    unseen: tuple[int, ...]
    n: int
    grams: int


def train_language_model(docs: DataFrame, text_col: str, lang_col: str, n: int = 3) -> LanguageModel:
    """Count the n-grams of every labelled text per language; all of them are kept."""
    grams = spread(docs.select(lang_col, text_col)).select(
        F.col(lang_col).alias("lang"), F.explode(char_ngrams(F.col(text_col), n)).alias("gram")
    )
    counts = stage(grams.where("lang is not null").groupBy("lang", "gram").count(), "gram-counts")
    totals = counts.groupBy("lang").agg(F.sum("count").alias("total")).orderBy("lang")
    found = totals.limit(MAX_LANGUAGES + 1).collect()
    if not found:
        raise ValueError("the training table holds no labelled text")
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col!r} holds more than {MAX_LANGUAGES} languages")
    size = counts.select("gram").distinct().count()
    names = F.array(*[F.lit(r["lang"]) for r in found])
    sums = F.array(*[F.lit(float(r["total"] + size)) for r in found])
    number = (F.array_position(names, F.col("lang")) - 1).cast("int")

    def score(count: Column, total: Column) -> Column:
        return F.round(F.log((count + 1) / total) * UNIT, 0).cast("bigint")

    entry = F.struct(
        number.alias("l"), score(F.col("count"), F.get(sums, number)).alias("s")
    )
    table = counts.groupBy("gram").agg(
        F.sum("count").alias("n"), F.collect_list(entry).alias("entries")
    )
    unseen = docs.sparkSession.range(1).select(F.transform(sums, lambda t: score(F.lit(0), t)))
    return LanguageModel(
        stage(table, "gram-model"), tuple(r["lang"] for r in found), tuple(unseen.first()[0]), n, size
    )


#: Cells (n-grams x languages) that a task adds up at a time.
TILE_CELLS = 1 << 22
#: Bits of a code point; three of them are packed into one integer.
POINT_BITS = 21


def packed_ngrams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the texts, up to three characters each as one integer, and the number of
    n-grams of each text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.zeros(max(0, len(points) - n + 1), np.int64)
    for i in range(n):
        codes = (codes << POINT_BITS) | points[i : i + len(codes)]
    counts = np.maximum(sizes - n + 1, 0)
    # Of the n-grams of the joined text those that begin a text's end reach into the next one.
    ends = np.repeat(np.cumsum(sizes), sizes)[: len(codes)]
    return codes[np.arange(len(codes)) + n <= ends], counts


def language_sums(texts: list[str], keys: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Sums of the scores of each text's n-grams; ``keys`` are sorted, and the last row of
    ``scores`` stands for what is not among them."""
    out = np.zeros((len(texts), scores.shape[1]), np.int64)
    codes, counts = packed_ngrams(texts, n)
    if not len(keys) or not len(codes):
        return out
    place = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    place = np.where(keys[place] == codes, place, len(keys))
    owner = np.repeat(np.arange(len(texts)), counts)
    tile = max(1, TILE_CELLS // scores.shape[1])
    for at in range(0, len(codes), tile):
        own = owner[at : at + tile]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[first]] += np.add.reduceat(scores[place[at : at + tile]], first, axis=0)
    return out


def _scored_in_place(text: Column, model: LanguageModel) -> Column:
    """Scores by the broadcast model; rows stay where they are."""
    rows = model.table.select("gram", "entries").collect()
    if model.n > 63 // POINT_BITS:
        keys = None
        rows.sort(key=lambda r: r["gram"])
    else:
        packed, _ = packed_ngrams([r["gram"] for r in rows], model.n)
        order = np.argsort(packed)
        keys, rows = packed[order], [rows[i] for i in order]
    # The last row stands for grams outside the model.
    scores = np.tile(np.array(model.unseen, np.int64), (len(rows) + 1, 1))
    scores[-1] = 0
    for i, r in enumerate(rows):
        for e in r["entries"]:
            scores[i, e["l"]] = e["s"]
    place = None if keys is not None else {r["gram"]: i for i, r in enumerate(rows)}
    shipped = model.table.sparkSession.sparkContext.broadcast((keys, place, scores))
    names, n = model.languages, model.n

    @F.pandas_udf("map<string,double>")
    def score(lines: pd.Series) -> pd.Series:
        keys, place, scores = shipped.value
        present = lines.notna().to_numpy()
        texts = lines[present].tolist()
        if keys is not None:
            sums = language_sums(texts, keys, scores, n)
        else:
            other = len(scores) - 1
            at = [[place.get(t[i : i + n], other) for i in range(len(t) - n + 1)] for t in texts]
            sums = np.array([scores[a].sum(axis=0) for a in at], np.int64).reshape(len(texts), len(names))
        odds = np.exp((sums - sums.max(axis=1, initial=np.iinfo(np.int64).min, keepdims=True)) / UNIT)
        shares = (odds / odds.sum(axis=1, keepdims=True)).tolist()
        out = np.full(len(lines), None, object)
        out[present] = [dict(zip(names, s)) for s in shares]
        return pd.Series(out)

    return score(_line(text))


def _scored_by_shuffle(docs: DataFrame, text_col: str, model: LanguageModel, out: str) -> DataFrame:
    """Scores by a join of counted grams, for models too large to broadcast.

    The rows are numbered in a written table, so that they find their scores again.
    """
    row, count = "_language_row", len(model.languages)
    kept = stage(docs.withColumn(row, F.monotonically_increasing_id()), "language-rows")
    grams = kept.select(row, F.explode(char_ngrams(F.col(text_col), model.n)).alias("gram"))
    counted = grams.groupBy(row, "gram").agg(F.count("*").alias("times"))
    met = join_facts(counted, model.table, ["gram"], "n", ["entries"]).where("entries is not null")
    known = met.groupBy(row).agg(F.sum("times").alias("known"))
    unseen = F.array(*[F.lit(u) for u in model.unseen])
    gain = (F.col("e.s") - F.get(unseen, F.col("e.l"))) * F.col("times")
    gains = (
        met.select(row, "times", F.explode("entries").alias("e"))
        .groupBy(row, F.col("e.l").alias("l"))
        .agg(F.sum(gain).alias("gain"))
        .groupBy(row)
        .agg(F.map_from_entries(F.collect_list(F.struct("l", "gain"))).alias("gains"))
    )
    sums = F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)),
        lambda l: F.get(unseen, l) * F.coalesce("known", F.lit(0))
        + F.coalesce(F.try_element_at("gains", l), F.lit(0)),
    )
    names = F.array(*[F.lit(name) for name in model.languages])
    odds = F.transform("_sums", lambda s: F.exp((s - F.array_max("_sums")) / float(UNIT)))
    total = F.aggregate("_odds", F.lit(0.0), lambda a, x: a + x)
    shares = F.map_from_arrays(names, F.transform("_odds", lambda o: o / F.col("_total")))
    scored = (
        kept.join(known, row, "left")
        .join(gains, row, "left")
        .withColumn("_sums", sums)
        .withColumn("_odds", odds)
        .withColumn("_total", total)
    )
    scores = F.when(F.col(text_col).isNotNull(), shares)
    return scored.select(*docs.columns, scores.alias(out))


def language_scores(
    docs: DataFrame,
    text_col: str,
    model: LanguageModel,
    out: str = "scores",
    broadcast_cells: int = BROADCAST_CELLS,
) -> DataFrame:
    """``docs`` with a map ``out``: a probability per language; null for null texts."""
    if model.grams * len(model.languages) <= broadcast_cells:
        return spread(docs).withColumn(out, _scored_in_place(F.col(text_col), model))
    return _scored_by_shuffle(docs, text_col, model, out)


def predicted_scores(load: Callable[[], ScoresFn]) -> ColumnFn:
    """Column function for a predictor that ``load`` opens once per Python worker.

    Line breaks reach the predictor as spaces.
    """

    @F.pandas_udf("map<string,double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield map_present(texts, lambda present: map(dict, model(present)))

    return lambda text: predict(newline_to_space(text))


def top_languages(scores: Column, k: int) -> Column:
    """The ``k`` best ``{language: score}`` pairs, ``-1`` for all."""
    if k < 0:
        return scores
    ranked = F.array_sort(
        F.transform(
            F.map_entries(scores),
            lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("language")),
        )
    )
    best = F.slice(ranked, 1, k)
    return F.map_from_arrays(
        F.transform(best, lambda e: e["language"]), F.transform(best, lambda e: -e["minus"])
    )


@dataclass(frozen=True)
class LanguageFilter:
    """Keep rows whose score for one of ``languages`` (or for any) exceeds the threshold."""

    languages: Sequence[str] | str | None = None
    language_threshold: float = 0.65
    label_only: bool = False
    keep_top_pairs_threshold: float = -1

    def _wanted(self) -> list[str] | None:
        if self.languages is None:
            return None
        names = [self.languages] if isinstance(self.languages, str) else list(self.languages)
        if not names:
            raise ValueError("languages must be None or name at least one language")
        return names

    def _restricted(self, scores: Column) -> Column:
        names = self._wanted()
        if names is None:
            return scores
        cells = [x for n in names for x in (F.lit(n), F.coalesce(scores[n], F.lit(0.0)))]
        return F.create_map(*cells)

    def label(self, df: DataFrame, scores: str = "scores") -> DataFrame:
        """Add ``language`` and ``language_score``, on request ``top_language_scores``."""
        best = F.array_min(
            F.transform(
                F.map_entries(scores),
                lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("name")),
            )
        )
        df = df.withColumn("_best", best).withColumns(
            {"language": F.col("_best.name"), "language_score": -F.col("_best.minus")}
        )
        if self.keep_top_pairs_threshold != -1:
            top = F.map_filter(
                self._restricted(F.col(scores)), lambda _, v: v > self.keep_top_pairs_threshold
            )
            df = df.withColumn("top_language_scores", top)
        return df.drop("_best")

    def verdict(self, scores: str = "scores") -> Verdict:
        """Verdict on rows that ``label`` has seen; dropping for language has no reason."""
        if self.label_only:
            keep = F.lit(True)
        else:
            values = F.map_values(self._restricted(F.col(scores)))
            keep = F.exists(values, lambda v: v > self.language_threshold)
        return Verdict(F.coalesce(keep, F.lit(False)), F.lit(None).cast("string"))


def language_filter(
    docs: DataFrame, text_col: str, scores: LanguageModel | ColumnFn, rule: LanguageFilter
) -> DataFrame:
    """``docs`` with its languages and a verdict, ready for the writer of kept and dropped rows.

    ``scores`` is a trained model, or a column function such as ``predicted_scores`` gives.
    Adds ``language``, ``language_score``, ``keep`` and ``drop_reason`` (and
    ``top_language_scores`` if the rule asks for them).
    """
    if isinstance(scores, LanguageModel):
        scored = language_scores(docs, text_col, scores, "_scores")
    else:
        scored = docs.withColumn("_scores", scores(F.col(text_col)))
    labelled = rule.label(scored, "_scores")
    return with_verdict(labelled, rule.verdict("_scores")).drop("_scores")
