"""Corpus BLEU and chrF++ as aggregations over n-grams."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.text import BLANKS, words
from corpusweave.plans.partitions import spread

# The 13a rules that separate punctuation, applied in this order.
TOKENIZER_13A = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)
ENTITIES_13A = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
BLEU_ORDER = 4
CHAR_ORDER = 6
BETA = 2
#: Characters of both sides that are counted at a time; a longer pair is counted alone.
PIECE_CHARS = 1 << 20


def tokenize_13a(text: Column) -> Column:
    """Words and punctuation of a stripped text, as the standard BLEU tokenizer cuts them."""
    text = F.replace(text, F.lit("<skipped>"), F.lit(""))
    text = F.replace(text, F.lit("-\n"), F.lit(""))
    text = F.translate(text, "\n", " ")
    for entity, char in ENTITIES_13A:
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, by in TOKENIZER_13A:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(by))
    return words(text)


def clipped_matches(hyps: list[np.ndarray], refs: list[np.ndarray], order: int) -> np.ndarray:
    """``hyp, ref, matched`` n-gram totals of 1 to ``order`` for each pair of token arrays.

    Pair, the next ``order`` tokens and the side are packed into one integer per position, and
    sorted once: equal n-grams of a pair then stand side by side for every n.  Pairs whose
    numbers do not fit 63 bits together are counted in two halves.
    """
    n_rows = len(hyps)
    out = np.zeros((n_rows, order, 3), np.int64)
    sequences = [*hyps, *refs]
    flat = np.concatenate([np.empty(0, np.int64), *sequences])
    if not len(flat):
        return out.reshape(n_rows, 3 * order)
    _, token = np.unique(flat, return_inverse=True)
    # Zero stands for the end of a text.
    bits = int(token.max() + 1).bit_length()
    room = 63 - 1 - max(1, (n_rows - 1).bit_length())
    if bits * order > room and n_rows > 1:
        half = n_rows // 2
        parts = [(hyps[:half], refs[:half]), (hyps[half:], refs[half:])]
        return np.concatenate([clipped_matches(*part, order) for part in parts])
    if bits * order > room:
        return _clipped_by_numbers(token, len(hyps[0]), order)
    sizes = np.array([len(x) for x in sequences])
    owner = np.repeat(np.arange(2 * n_rows), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))
    code = np.concatenate([token + 1, np.zeros(order, np.int64)])
    key = owner % n_rows
    for n in range(order):
        key = (key << bits) | np.where(left > n, code[n : n + len(flat)], 0)
    key = np.sort((key << 1) | (owner < n_rows))
    is_hyp = key & 1
    for n in range(1, order + 1):
        gram = key >> (1 + bits * (order - n))
        first = np.flatnonzero(np.diff(gram, prepend=-1))
        whole = (gram[first] & ((1 << bits) - 1)) > 0
        count = np.diff(first, append=len(gram))
        said = np.add.reduceat(is_hyp, first)[whole]
        asked, row = count[whole] - said, gram[first][whole] >> (bits * n)
        for i, value in enumerate((said, asked, np.minimum(said, asked))):
            # Counts of a batch are far below 2^53.
            out[:, n - 1, i] = np.bincount(row, value, n_rows)
    return out.reshape(n_rows, 3 * order)


def bounded_pieces(sizes: np.ndarray, limit: int = PIECE_CHARS) -> Iterator[slice]:
    """Runs of rows of up to ``limit`` together, or of one larger row."""
    start, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > start and held + size > limit:
            yield slice(start, row)
            start, held = row, 0
        held += size
    if len(sizes) > start:
        yield slice(start, len(sizes))


def _clipped_by_numbers(token: np.ndarray, n_hyp: int, order: int) -> np.ndarray:
    """``clipped_matches`` of one pair with very many different tokens.

    The n-grams of one order are numbered by their first n - 1 tokens and their last one.
    """
    out = np.zeros((1, order, 3), np.int64)
    size, at, gram = token.max() + 1, np.arange(len(token)), token
    for n in range(order):
        if n:
            fits = (at + n < len(token)) & ((at >= n_hyp) | (at + n < n_hyp))
            at, gram = at[fits], gram[fits]
            _, gram = np.unique(gram * size + token[at + n], return_inverse=True)
        if not len(at):
            break
        said, asked = (np.bincount(gram[side], minlength=gram.max() + 1) for side in (at < n_hyp, at >= n_hyp))
        out[0, n] = said.sum(), asked.sum(), np.minimum(said, asked).sum()
    return out.reshape(1, 3 * order)


def ngram_matches(hyp: Column, ref: Column, order: int, chars: bool = False) -> Column:
    """``[hyp, ref, matched]`` totals for n-grams of 1 to ``order``, as one flat array per row.

    Both sides of a row are in the row, so clipping needs no join: exploding every n-gram
    would multiply the corpus by the order and shuffle or spill all of it.  n-grams are taken
    over characters, or over the blank-separated words of the texts; rows are counted in
    pieces of bounded size, however many rows a batch holds.
    """

    def characters(texts: pd.Series, _: dict) -> list[np.ndarray]:
        return [np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64) for t in texts]

    def numbered(texts: pd.Series, numbers: dict[str, int]) -> list[np.ndarray]:
        split = (t.split() for t in texts)
        return [np.array([numbers.setdefault(w, len(numbers)) for w in t], np.int64) for t in split]

    @F.pandas_udf("array<bigint>")
    def count(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        tokens = characters if chars else numbered
        for hyps, refs in batches:
            sides = [side.fillna("") for side in (hyps, refs)]
            parts: list[np.ndarray] = []
            for rows in bounded_pieces(sum(side.str.len().to_numpy(np.int64) for side in sides)):
                numbers: dict[str, int] = {}
                parts.extend(clipped_matches(*(tokens(side.iloc[rows], numbers) for side in sides), order))
            yield pd.Series(parts, dtype=object)

    return count(hyp, ref)


def _corpus_sums(pairs: DataFrame, counts: dict[str, tuple[Column, int]]) -> DataFrame:
    """One row of corpus sums, ``hyp_<unit><n>`` and so on; only counters are shuffled.

    A row's prediction n-grams only count where its reference has n-grams of that order.
    """
    rows = pairs.select(*[column.alias(unit) for unit, (column, _) in counts.items()])
    sums = []
    for unit, (_, order) in counts.items():
        for n in range(1, order + 1):
            hyp, ref, matched = (F.get(unit, F.lit(3 * (n - 1) + i)) for i in range(3))
            totals = {
                "hyp": hyp,
                "usable": F.when(ref > 0, hyp).otherwise(0),
                "ref": ref,
                "matched": matched,
            }
            sums += [
                F.coalesce(F.sum(value), F.lit(0)).alias(f"{name}_{unit}{n}")
                for name, value in totals.items()
            ]
    return rows.agg(*sums)


def corpus_bleu(pairs: DataFrame, prediction: str, reference: str) -> DataFrame:
    """One row ``bleu, brevity_penalty, sys_len, ref_len, p1..p4`` for one reference per row.

    Orders without a match are smoothed by halving, as the standard implementation does.
    """
    hyp, ref = (F.array_join(tokenize_13a(F.col(c)), " ") for c in (prediction, reference))
    pairs = spread(pairs.select(prediction, reference))
    sums = _corpus_sums(pairs, {"w": (ngram_matches(hyp, ref, BLEU_ORDER), BLEU_ORDER)})
    precisions, halvings = [], F.lit(0)
    for n in range(1, BLEU_ORDER + 1):
        matched, total = F.col(f"matched_w{n}"), F.col(f"hyp_w{n}")
        empty = (matched == 0) & (total > 0)
        halvings = halvings + empty.cast("int")
        p = (
            F.when(total == 0, F.lit(0.0))
            .when(empty, 100.0 / (F.pow(F.lit(2.0), halvings) * total))
            .otherwise(100.0 * matched / total)
        )
        precisions.append(p)
    sums = sums.withColumns({f"p{n + 1}": p for n, p in enumerate(precisions)})
    sys_len, ref_len = F.col("hyp_w1"), F.col("ref_w1")
    penalty = (
        F.when(sys_len == 0, F.lit(0.0))
        .when(sys_len < ref_len, F.exp(1 - ref_len / sys_len))
        .otherwise(F.lit(1.0))
    )
    names = [f"p{n}" for n in range(1, BLEU_ORDER + 1)]
    logs = sum((F.log(n) for n in names[1:]), F.log(names[0])) / BLEU_ORDER
    score = F.when(F.least(*names) == 0, F.lit(0.0)).otherwise(penalty * F.exp(logs))
    return sums.select(
        score.alias("bleu"),
        penalty.alias("brevity_penalty"),
        sys_len.alias("sys_len"),
        ref_len.alias("ref_len"),
        *names,
    )


def _chrf_words(text: Column) -> Column:
    """Words with one leading or trailing punctuation mark cut off."""
    marks = F.lit(string.punctuation)

    def cut(word: Column) -> Column:
        last, first = F.right(word, F.lit(1)), F.left(word, F.lit(1))
        rest = F.char_length(word) - 1
        return (
            F.when(rest == 0, F.array(word))
            .when(F.contains(marks, last), F.array(F.left(word, rest), last))
            .when(F.contains(marks, first), F.array(first, F.right(word, rest)))
            .otherwise(F.array(word))
        )

    return F.flatten(F.transform(words(text), cut))


def corpus_chrf(
    pairs: DataFrame, prediction: str, reference: str, word_order: int = 2
) -> DataFrame:
    """One row ``chrf``: F2 of the mean precision and recall over character n-grams up to 6
    and word n-grams up to ``word_order``."""
    texts = [F.col(prediction), F.col(reference)]
    dense = [F.regexp_replace(t, F.lit(BLANKS), F.lit("")) for t in texts]
    counts = {"c": (ngram_matches(*dense, CHAR_ORDER, chars=True), CHAR_ORDER)}
    if word_order:
        cut = [F.array_join(_chrf_words(t), " ") for t in texts]
        counts["w"] = (ngram_matches(*cut, word_order), word_order)
    sums = _corpus_sums(spread(pairs.select(prediction, reference)), counts)
    orders = [(unit, n) for unit, (_, order) in counts.items() for n in range(1, order + 1)]
    precision = recall = effective = F.lit(0.0)
    for unit, n in orders:
        hyp, ref, matched = (F.col(f"{c}_{unit}{n}") for c in ("usable", "ref", "matched"))
        usable = (hyp > 0) & (ref > 0)
        precision = precision + F.when(usable, matched / hyp).otherwise(0.0)
        recall = recall + F.when(usable, matched / ref).otherwise(0.0)
        effective = effective + usable.cast("double")
    means = sums.select(
        F.when(effective > 0, precision / effective).otherwise(0.0).alias("p"),
        F.when(effective > 0, recall / effective).otherwise(0.0).alias("r"),
    )
    factor = float(BETA**2)
    score = F.when(F.col("p") + F.col("r") == 0, F.lit(0.0)).otherwise(
        100 * (1 + factor) * F.col("p") * F.col("r") / (factor * F.col("p") + F.col("r"))
    )
    return means.select(score.alias("chrf"))
