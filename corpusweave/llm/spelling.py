"""Spelling variants of words, found by PartEnum signatures of their letters.

A word is seen as the set of its numbered letters (first a, second a, first b and so on), a
binary vector.  Two words that differ by one inserted, deleted or replaced letter have vectors
at a Hamming distance of at most two.  The dimensions are dealt into ``PARTS`` parts; at most two
of those can differ, so two such words agree in all the others: a word is indexed under what it
has outside every two parts (Arasu, Ganti and Kaushik, "Efficient exact set-similarity joins",
2006, with one first-level partition).  Words with equal signatures meet in an equality join and
are verified by their edit distance.

A signature that more than ``BUCKET`` words share is indexed a second time, by the first or
the last half of the word, one of which the change leaves alone; so no bucket grows with the
square of the vocabulary, and no pair is lost.  Occurrences are counted in the JVM, combined in each task
before they travel; only the distinct words that are frequent enough reach the signatures.

Defined cases: a null text has no words; a null id counts as an empty text where it is hashed;
repeated rows count each; words of any length take part; of equally frequent forms the smallest
in code-point order is chosen.  An empty table gives an empty table.  Only the id and text columns
are read, so other columns may have any name.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.common import bounded_batches
from corpusweave.plans.staging import remove, stage, stage_observed

LETTERS = "A-Za-zÀ-ÿ"
MIN_CHARS, MIN_COUNT, RATIO, DROP_EVERY = 6, 5, 5, 199
#: Parts of the vectors' dimensions; signatures leave out two of them.
PARTS = 7
#: Signatures that more words share are indexed a second time.
BUCKET = 64


def word_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    drop_every: int | None = DROP_EVERY,
) -> DataFrame:
    """``word, n``: lower-cased runs of letters of at least ``min_chars`` and ``min_count`` times.

    Where the CRC-32 of ``id:run`` is a multiple of ``drop_every``, the run loses the letter
    at the checksum's remainder by its length, before it is counted.
    """
    lower = F.translate(F.col(text_col), string.ascii_uppercase, string.ascii_lowercase)
    # A run that is too short cannot give a word, and the pattern takes longer ones whole.
    runs = F.regexp_extract_all(lower, F.lit(f"[a-zÀ-ÿ]{{{max(1, min_chars)},}}"), F.lit(0))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    words = docs.select(key.alias("id"), F.explode(runs).alias("run"))
    if drop_every:
        checksum = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        place = F.pmod(F.col("h"), F.char_length("run")).cast("int")
        shorter = F.concat(
            F.expr("substring(run, 1, place)"), F.expr("substring(run, place + 2)")
        )
        words = words.withColumn("h", checksum).withColumn("place", place)
        words = words.select(F.when(F.col("h") % drop_every == 0, shorter).otherwise(F.col("run")).alias("word"))
    else:
        words = words.select(F.col("run").alias("word"))
    words = words.where(F.char_length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def part_of(letter: str, number: int, parts: int = PARTS) -> int:
    """The part that the ``number``-th occurrence of a letter belongs to."""
    return xxhash.xxh64_intdigest(f"{letter}{number}".encode(), 0) % parts


def signatures(word: str, parts: int = PARTS, known: dict | None = None) -> list[int]:
    """64-bit signatures: for every two parts, what the word has outside them.

    What a part holds is hashed as a sum over its numbered letters, so a signature is the sum
    over the parts that it covers, with a hash of the two it leaves out.
    """
    known = {} if known is None else known
    seen: dict[str, int] = {}
    held = [0] * parts
    for letter in word:
        number = seen[letter] = seen.get(letter, 0) + 1
        found = known.get((letter, number))
        if found is None:
            code = xxhash.xxh64_intdigest(f"{letter}{number}".encode(), 1)
            found = known[letter, number] = (part_of(letter, number, parts), code)
        held[found[0]] += found[1]
    total = sum(held)
    out = []
    for i, (a, b) in enumerate(combinations(range(parts), 2)):
        rest = (total - held[a] - held[b]) * 0x9E3779B97F4A7C15 + i * 0xC2B2AE3D27D4EB4F
        out.append((rest & (1 << 64) - 1) - (1 << 63))
    return out


def _signed(words: DataFrame, parts: int) -> DataFrame:
    """``sig, word``: a row per word and signature."""
    count = parts * (parts - 1) // 2

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            sigs = [s for w in batch["word"].to_pylist() for s in signatures(w, parts, known)]
            at = pa.array(np.repeat(np.arange(batch.num_rows), count))
            columns = [pa.array(sigs, pa.int64()), batch["word"].take(at)]
            yield pa.RecordBatch.from_arrays(columns, names=["sig", "word"])
            if len(known) > 1 << 16:
                known.clear()

    return words.select("word").mapInArrow(sign, "sig bigint, word string")


def _verified(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``a, b`` with ``a < b``: words that share the keys and differ by exactly one letter."""
    size = F.char_length
    pairs = left.withColumnRenamed("word", "a").join(right.withColumnRenamed("word", "b"), keys)
    close = (F.col("a") < F.col("b")) & (F.abs(size("a") - size("b")) <= 1)
    return pairs.where(close & (F.levenshtein("a", "b", 1) == 1)).select("a", "b")


def _halves() -> Column:
    """Both halves of a word, also as those of a word that is one letter shorter."""
    n = F.char_length("word")
    found = []
    for less in (0, 1):
        # The shorter word of a pair has ``n - less`` letters; if the change comes after its
        # first half both begin alike, else both end alike.
        half = F.floor((n - less) / 2).cast("int")
        found.append(F.struct(F.lit("<").alias("side"), (n - less).alias("n"), F.expr("word").substr(F.lit(1), half).alias("half")))
        rest = (n - less - half).cast("int")
        found.append(F.struct(F.lit(">").alias("side"), (n - less).alias("n"), F.expr("word").substr(n - rest + 1, rest).alias("half")))
    return F.array(*found)


def near_words(words: DataFrame, parts: int = PARTS, bucket: int = BUCKET) -> DataFrame:
    """``a, b`` with ``a < b``: all distinct words that differ by exactly one inserted, deleted
    or replaced code point."""
    if parts < 3:
        raise ValueError("at least three parts are needed")
    bounded_batches(words.sparkSession)
    signed = stage(_signed(words, parts), "word-signatures")
    sizes = signed.groupBy("sig").agg(F.count("*").alias("m")).where("m > 1")
    shared = stage(signed.join(sizes, "sig"), "shared-signatures")
    remove(signed)
    small = shared.where(F.col("m") <= bucket).select("sig", "word")
    large = shared.where(F.col("m") > bucket).select("sig", "word", F.explode(_halves()).alias("h"))
    large = large.select("sig", "word", "h.*")
    found = _verified(small, small, ["sig"]).unionByName(
        _verified(large, large, ["sig", "side", "n", "half"])
    )
    pairs = stage(found.distinct(), "near-words")
    remove(shared)
    return pairs


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last of the chain of forms, whose length is halved every round."""
    hops = stage(forms.select("word", F.col("form").alias("root")), "word-roots")
    while True:
        following = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        farther = hops.join(following, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        before = hops
        hops, seen = stage_observed(farther, "word-roots", moved=F.count_if("moved"))
        remove(before)
        if not seen["moved"]:
            return hops.select("word", "root")


def spelling_variants(
    words: DataFrame, ratio: int = RATIO, parts: int = PARTS, bucket: int = BUCKET
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row ``word, n``.

    A word's form is its most frequent near word (ties: the smallest), if that is at least
    ``ratio`` times as frequent; its root is the last word of the chain of forms.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    words = stage(words.select("word", "n"), "words")
    pairs = near_words(words, parts, bucket)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("other")), "b")
    # The largest count first, then the smallest word.
    best = F.min(F.struct((-F.col("other")).alias("minus"), F.col("b").alias("near")))
    near = counted.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.minus") >= F.lit(ratio) * F.col("n")
    judged = stage(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, F.col("best.near")).alias("form"),
            F.when(is_form, -F.col("best.minus")).alias("form_n"),
        ),
        "word-forms",
    )
    roots = _roots(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
