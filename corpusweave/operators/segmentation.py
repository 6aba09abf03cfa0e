"""Words of languages that are written without blanks.

A unigram model: every word of a bounded list costs the negative logarithm of its share of the
corpus, and a line is cut into the words that cost least together (Viterbi).  The list starts
from the frequent character n-grams of the corpus that hold together; after each round of counting, words that the
cheapest segmentations use are counted anew.  Costs are integers, so segmentations are the same
everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.batches import map_present
from corpusweave.plans.staging import remove, stage

# Scripts whose words are not set apart by blanks, as Unicode blocks.
UNSPACED_SCRIPTS = (
    "฀-໿"  # Thai, Lao
    "ༀ-࿿"  # Tibetan
    "က-႟ꩠ-ꩿꧠ-꧿"  # Myanmar
    "ក-៿"  # Khmer
    "ぁ-ヿㇰ-ㇿ"  # kana
    "㐀-䶿一-鿿豈-﫿\U00020000-\U0003134f"  # Han
)
#: Cost units of one bit.
BIT = 1024
#: Characters that are counted or cut at a time.
PIECE = 1 << 19
#: Runs that are cut side by side: at least so many, and none longer.
LANES, LONGEST = 16, 1 << 16
#: Bits for the number of words beside a cost, and the cost of what is no word.
COUNT_BITS, NO_WORD = 17, 1 << 61


def _code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _strings(points: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive code points as strings of the given numbers of characters."""
    octets = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(octets)])[np.concatenate([[0], np.cumsum(sizes)])]
    data = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    buffers = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.string(), len(sizes), buffers)


def _pieces(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``PIECE`` characters together, or one longer text."""
    ends, at = np.cumsum(lengths), 0
    while at < len(lengths):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + PIECE, "right")))
        yield at, stop
        at = stop


class _Cutter:
    """The cheapest words of many runs at once: a trie of the words, and one step of the Viterbi
    recursion for all runs at a time.  Gives what ``WordModel.cut`` gives run by run."""

    def __init__(self, model: WordModel):
        self.model = model
        costs = {w: c for w, c in model.costs.items() if 0 < len(w) <= model.max_chars}
        self.names = sorted({w[:n] for w in costs for n in range(1, len(w) + 1)}, key=lambda w: (len(w), w))
        number = {w: i for i, w in enumerate(self.names)}
        letters = sorted({c for w in costs for c in w})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.base = len(letters) + 1
        #: Of every prefix of a word: its cost if it is a word.
        self.cost = np.array([costs.get(w, NO_WORD) for w in self.names], np.int64)
        known = self.cost < NO_WORD
        self.cost[known] = (self.cost[known] << COUNT_BITS) + 1
        self.single = np.full(self.base, -1, np.int64)
        keys, nodes = [], []
        for i, w in enumerate(self.names):
            if len(w) == 1:
                self.single[self.letter[ord(w)]] = i
            else:
                keys.append(number[w[:-1]] * self.base + int(self.letter[ord(w[-1])]))
                nodes.append(i)
        self._index(np.array(keys, np.int64), np.array(nodes, np.int64))
        self.inside = np.zeros(0x110000, np.int8)
        self.of_class = regex.compile(f"[{model.letters}]")

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _index(self, keys: np.ndarray, nodes: np.ndarray) -> None:
        """A hash table of the keys with open addressing."""
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.nodes = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot] == keys
            self.nodes[slot[mine]] = nodes[mine]
            keys, nodes, slot = keys[~mine], nodes[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)

    def _child(self, keys: np.ndarray) -> np.ndarray:
        """The prefix that each key names, -1 for none."""
        out, open_, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._slot(keys)
        while len(open_):
            held = self.keys[slot]
            hit = held == keys[open_]
            out[open_[hit]] = self.nodes[slot[hit]]
            rest = ~hit & (held >= 0)
            open_, slot = open_[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
        return out

    def runs(self, chars: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the runs of the model's letters; none goes over a text's end."""
        new = np.unique(chars[self.inside[chars] == 0])
        self.inside[new] = [2 if self.of_class.match(chr(c)) else 1 for c in new]
        within = self.inside[chars] == 2
        breaks = np.zeros(len(chars) + 1, bool)
        breaks[text_starts] = True
        before = np.concatenate([[False], within[:-1]])
        after = np.concatenate([within[1:], [False]])
        starts = np.flatnonzero(within & (~before | breaks[:-1]))
        ends = np.flatnonzero(within & (~after | breaks[1:]))
        return starts, ends + 1 - starts

    def words(self, chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``size, node``: at every first character of a word its length and number; 0 elsewhere.

        A single character that begins no listed word has the number -1.
        """
        total, most = len(chars), self.model.max_chars
        size, node = np.zeros(total, np.int64), np.full(total, -1, np.int64)
        if not len(starts):
            return size, node
        left = np.zeros(total, np.int64)
        inside = np.repeat(starts + lengths, lengths)
        at = np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        left[at] = inside - at
        letter = self.letter[chars]
        nodes, costs = [], []
        for n in range(1, most + 1):
            here = np.full(total, -1, np.int32)
            if n == 1:
                here[at] = self.single[letter[at]]
            else:
                at = at[left[at] >= n]
                here[at] = self._child(nodes[-1][at].astype(np.int64) * self.base + letter[at + n - 1])
            at = at[here[at] >= 0]
            cost = np.full(total, NO_WORD, np.int64)
            cost[at] = self.cost[here[at]]
            nodes.append(here)
            costs.append(cost)
        unknown = (self.model.unknown << COUNT_BITS) + 1
        costs[0][costs[0] == NO_WORD] = unknown

        order = np.argsort(-lengths, kind="stable")
        limit = min(LONGEST, lengths[order[LANES - 1]] if len(order) >= LANES else 0)
        side_by_side = order[lengths[order] <= limit]
        self._viterbi(costs, starts[side_by_side], lengths[side_by_side], size)
        for run in order[lengths[order] > limit]:
            first = at_ = int(starts[run])
            text = chars[first : first + int(lengths[run])].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            for word in self.model.cut(text):
                size[at_] = len(word)
                at_ += len(word)
        for n in range(1, most + 1):
            own = np.flatnonzero(size == n)
            node[own] = nodes[n - 1][own]
        return size, node

    def _viterbi(self, costs: list[np.ndarray], starts: np.ndarray, lengths: np.ndarray, size: np.ndarray) -> None:
        """Fill in ``size`` for runs given by falling length."""
        if not len(starts):
            return
        last = np.zeros(len(size), np.int8)
        active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")
        past = [np.zeros(len(starts), np.int64)]
        for end, here in enumerate(active.tolist(), 1):
            at = starts[:here] + end
            best, chosen = None, None
            for n in range(min(len(costs), end), 0, -1):
                candidate = past[-n][:here] + costs[n - 1][at - n]
                if best is None:
                    best, chosen = candidate, np.full(here, n, np.int8)
                else:
                    chosen[candidate < best] = n
                    best = np.minimum(best, candidate)
            past = [*past[1 - len(costs) :], best] if len(costs) > 1 else [best]
            last[at - 1] = chosen
        ends = lengths.astype(np.int64)
        while len(ends):
            step = last[starts + ends - 1].astype(np.int64)
            ends = ends - step
            size[starts + ends] = step
            more = ends > 0
            starts, ends = starts[more], ends[more]

    def pieces(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``chars, lengths, run starts, size, node`` of some texts at a time."""
        sizes = np.array([len(t) for t in texts], np.int64)
        for a, b in _pieces(sizes):
            chars, lengths = _code_points(texts[a:b]), sizes[a:b]
            # A text that ends the piece empty begins behind its last character.
            starts, spans = self.runs(chars, np.cumsum(lengths) - lengths)
            yield chars, lengths, starts, *self.words(chars, starts, spans)


@dataclass(frozen=True)
class WordModel:
    """``costs`` of the listed words; any other single character costs ``unknown``.

    ``letters`` says, as a character class, what is cut into words; all other text stays.
    """

    costs: dict[str, int] = field(default_factory=dict)
    unknown: int = 20 * BIT
    max_chars: int = 4
    letters: str = UNSPACED_SCRIPTS

    def cut(self, run: str) -> list[str]:
        """The cheapest words of a run; of equally cheap ones the fewest, then the longest last."""
        best: list[tuple[int, int]] = [(0, 0)]
        length = [0]
        costs, unknown = self.costs, self.unknown
        for end in range(1, len(run) + 1):
            found, size = None, 0
            for n in range(min(self.max_chars, end), 0, -1):
                cost = costs.get(run[end - n : end], unknown if n == 1 else None)
                if cost is None:
                    continue
                before = best[end - n]
                candidate = (before[0] + cost, before[1] + 1)
                if found is None or candidate < found:
                    found, size = candidate, n
            best.append(found)
            length.append(size)
        words, end = [], len(run)
        while end:
            words.append(run[end - length[end] : end])
            end -= length[end]
        return words[::-1]

    def spaced(self, text: str) -> str:
        """The text with a blank between the words of each run."""
        return regex.sub(f"[{self.letters}]+", lambda m: " ".join(self.cut(m[0])), text)

    @cached_property
    def cutter(self) -> _Cutter:
        """Made in the process that cuts."""
        return _Cutter(self)

    def spaced_all(self, texts: list[str]) -> list[str]:
        """``spaced`` of many texts."""
        out = []
        for chars, lengths, starts, size, _ in self.cutter.pieces(texts):
            gaps = size > 0
            gaps[starts] = False
            before = np.concatenate([[0], np.cumsum(gaps)])
            ends = np.cumsum(lengths)
            longer = lengths + before[ends] - before[ends - lengths]
            out += _strings(np.insert(chars, np.flatnonzero(gaps), 32), longer).to_pylist()
        return out

    def usage(self, texts: list[str]) -> Iterator[pa.RecordBatch]:
        """``word, n`` of the words that the texts are cut into, for some texts at a time."""
        for chars, _, _, size, node in self.cutter.pieces(texts):
            seen = np.bincount(node[(size > 0) & (node >= 0)], minlength=1)
            listed = np.flatnonzero(seen)
            others, times = np.unique(chars[(size > 0) & (node < 0)], return_counts=True)
            words = [*(self.cutter.names[i] for i in listed), *map(chr, others)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(np.concatenate([seen[listed], times]), pa.int64())],
                names=["word", "n"],
            )


def _runs(text: Column, letters: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[{letters}]+"), F.lit(0))


def word_candidates(
    docs: DataFrame, text_col: str, max_chars: int = 4, min_count: int = 5, letters: str = UNSPACED_SCRIPTS
) -> DataFrame:
    """``word, n``: character n-grams that occur ``min_count`` times inside runs of ``letters``.

    Grams are counted in each task before they travel.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(0).flatten()
            sizes = pc.utf8_length(runs).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in _pieces(sizes):
                chars = _code_points(runs.slice(a, b - a).to_pylist())
                left = np.repeat(np.cumsum(sizes[a:b]), sizes[a:b]) - np.arange(len(chars))
                for at in range(0, len(chars), PIECE):
                    yield from _gram_counts(chars[at : at + PIECE + max_chars - 1], left[at : at + PIECE], max_chars)

    runs = docs.select(_runs(F.col(text_col), letters).alias("runs"))
    each = runs.mapInArrow(count, "word string, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _gram_counts(chars: np.ndarray, left: np.ndarray, max_chars: int) -> Iterator[pa.RecordBatch]:
    """``word, n`` of the n-grams that begin at the first ``len(left)`` characters, of which each
    has ``left`` characters to the end of its run.

    A gram is a number with a digit per character; where that would overflow, the numbers so
    far are replaced by their ranks.
    """
    letters, digits = np.unique(chars, return_inverse=True)
    base, known, more = len(letters), letters[:, None], 0
    at, codes, possible = np.arange(len(left)), digits[: len(left)].astype(np.int64), base
    for n in range(1, max_chars + 1):
        if n > 1:
            if possible * base >= 1 << 62:
                held, codes = np.unique(codes, return_inverse=True)
                known, more, possible = _spelt(held, known, more, letters), 0, len(held)
            inside = left[at] >= n
            at, codes = at[inside], codes[inside] * base + digits[at[inside] + n - 1]
            possible, more = possible * base, more + 1
        if not len(at):
            return
        held, times = np.unique(codes, return_counts=True)
        words = _strings(_spelt(held, known, more, letters).ravel(), np.full(len(held), n))
        yield pa.RecordBatch.from_arrays([words, pa.array(times, pa.int64())], names=["word", "n"])


def _spelt(codes: np.ndarray, known: np.ndarray, more: int, letters: np.ndarray) -> np.ndarray:
    """The characters of grams: a row of ``known``, and ``more`` digits behind it."""
    tail = []
    for _ in range(more):
        codes, digit = np.divmod(codes, len(letters))
        tail.append(letters[digit])
    return np.column_stack([known[codes], *tail[::-1]])


def cohesive_words(candidates: DataFrame, cohesion: float = 5.0) -> DataFrame:
    """The ``word, n`` that are single characters, or hold together: however a word is cut in
    two, it is ``cohesion`` times as frequent as its parts would meet by chance."""
    single = F.char_length("word") == 1
    total = candidates.where(single).agg(F.sum("n")).first()[0] or 0
    places = F.sequence(F.lit(1), F.char_length("word") - 1)
    cuts = candidates.where(~single).select("word", "n", F.explode(places).alias("at"))
    halves = cuts.select("word", "n", F.expr("left(word, at)").alias("l"), F.expr("substring(word, at + 1)").alias("r"))
    for side in ("l", "r"):
        halves = halves.join(candidates.select(F.col("word").alias(side), F.col("n").alias(f"n_{side}")), side)
    ratio = F.min(F.col("n") * F.lit(float(total)) / (F.col("n_l").cast("double") * F.col("n_r")))
    held = halves.groupBy("word").agg(F.first("n").alias("n"), ratio.alias("ratio")).where(F.col("ratio") >= cohesion)
    return candidates.where(single).unionByName(held.select("word", "n"))


def _model(counts: DataFrame, max_words: int, max_chars: int, letters: str) -> WordModel:
    """The ``max_words`` most frequent words, of equally frequent ones the smallest."""
    rows = counts.orderBy(F.desc("n"), "word").limit(max_words).collect()
    total = sum(r["n"] for r in rows)
    costs = {r["word"]: round(BIT * math.log2(total / r["n"])) for r in rows}
    return WordModel(costs, round(BIT * math.log2(max(2, total))) + BIT, max_chars, letters)


def word_usage(docs: DataFrame, text_col: str, model: WordModel) -> DataFrame:
    """``word, n``: how often the segmented corpus holds each word."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from shared.value.usage(batch["text"].drop_null().to_pylist())

    texts = docs.select(F.col(text_col).alias("text"))
    return texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def fit_words(
    docs: DataFrame,
    text_col: str,
    max_chars: int = 4,
    min_count: int = 5,
    max_words: int = 200_000,
    rounds: int = 1,
    letters: str = UNSPACED_SCRIPTS,
    cohesion: float = 5.0,
) -> WordModel:
    """A word model of the corpus: counts cover all of it, the list holds ``max_words`` words.

    The list is what the driver and the tasks hold: about 100 bytes a word.  A corpus without
    any of the ``letters`` gives a model that cuts nothing.
    """
    counts = stage(word_candidates(docs, text_col, max_chars, min_count, letters), "word-candidates")
    model = _model(cohesive_words(counts, cohesion), max_words, max_chars, letters)
    for _ in range(rounds):
        used = word_usage(docs, text_col, model).where(F.col("n") >= min_count)
        model = _model(used, max_words, max_chars, letters)
    remove(counts)
    return model


def segmenter(spark, model: WordModel):
    """A column function that puts blanks between the words of a text; nulls stay nulls."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def spaced(texts: pd.Series) -> pd.Series:
        return map_present(texts, shared.value.spaced_all)

    return spaced
