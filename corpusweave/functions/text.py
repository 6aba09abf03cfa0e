"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.split() treats as blanks, written so that Java
# and RE2 regular expressions agree on them.
BLANK = r"\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}"
BLANKS = f"[{BLANK}]+"
WORD = f"[^{BLANK}]+"


def words(text: Column) -> Column:
    """Blank-separated words, without empty strings."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def collapse_whitespace(text: Column) -> Column:
    """Runs of blanks become one space; blanks at the ends go."""
    return F.trim(F.regexp_replace(text, F.lit(BLANKS), F.lit(" ")))


def reverse_words(text: Column) -> Column:
    """Reverse the characters inside each word."""
    return F.array_join(F.transform(words(text), F.reverse), " ")


def upper(text: Column) -> Column:
    return F.upper(text)


def newline_to_space(text: Column) -> Column:
    return F.translate(text, "\n", " ")


def replace_quotes(text: Column) -> Column:
    """Paired straight double quotes become chevrons; an unpaired quote stays."""
    return F.regexp_replace(text, F.lit('"([^"]*)"'), F.lit("«$1»"))


def instruct_prefix(text: Column, task: str) -> Column:
    """Prompt form used for instruction-tuned embedding models."""
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), text)
