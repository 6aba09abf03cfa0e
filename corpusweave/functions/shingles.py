"""Normalised words, word n-grams and their hashes."""

from __future__ import annotations

import hashlib
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusweave.functions.text import BLANKS

#: Modulus of the min-hash family; products of two residues stay inside a 64-bit integer.
PRIME = 2**31 - 1


def _accents() -> tuple[str, str]:
    """Letters of the alphabetic scripts that decompose into a base letter and marks."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]):
            pairs[chr(code)] = parts[0]
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _accents()
# What normalisation removes or unifies.
MARKS = r"[\x{300}-\x{36F}]"
NUMBER = r"\p{Nd}+"
PUNCTUATION = r"[\p{P}\p{S}]+"


def normalize_text(text: Column) -> Column:
    """Lower case, numbers as ``0``, no accents, punctuation or repeated blanks."""
    text = F.translate(F.lower(text), ACCENTED, PLAIN)
    text = F.regexp_replace(text, F.lit(MARKS), F.lit(""))
    text = F.regexp_replace(text, F.lit(NUMBER), F.lit("0"))
    text = F.regexp_replace(text, F.lit(PUNCTUATION), F.lit(""))
    return F.trim(F.regexp_replace(text, F.lit(BLANKS), F.lit(" ")))


def word_ngrams(tokens: Column, n: int, distinct: bool = True) -> Column:
    """The ``n``-word shingles of a word array; none when there are fewer words.

    ``tokens`` is read once per shingle, so it must be a column, not an expression.
    """
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1)))
    shingles = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
    shingles = F.array_distinct(shingles) if distinct else shingles
    return F.coalesce(shingles, F.array().cast("array<string>"))


def sha1_bits(text: Column) -> Column:
    """First 60 bits of SHA-1."""
    return F.conv(F.substring(F.sha1(text), 1, 15), 16, 10).cast("bigint")


def xxhash_bits(text: Column) -> Column:
    return F.xxhash64(text)


def sha1_residue(text: Column) -> Column:
    """First 60 bits of SHA-1 below ``PRIME``; other engines compute the same number."""
    return sha1_bits(text) % F.lit(PRIME)


def xxhash_residue(text: Column) -> Column:
    """Cheaper 64-bit hash below ``PRIME``."""
    return F.pmod(F.xxhash64(text), F.lit(PRIME))


def hash_family(n: int, seed: int = 1) -> tuple[list[int], list[int]]:
    """Multipliers and offsets of ``n`` hash functions ``(a * x + b) % PRIME``, from a rule."""

    def draw(kind: str, i: int) -> int:
        return int(hashlib.sha1(f"{seed}:{kind}:{i}".encode()).hexdigest()[:15], 16)

    return (
        [1 + draw("a", i) % (PRIME - 1) for i in range(n)],
        [draw("b", i) % PRIME for i in range(n)],
    )


def line_key(text: Column) -> Column:
    """128 bits that identify a line; a struct of two independently seeded hashes."""
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"))
