"""Removal of lines that many documents share, with built-in functions only.

Every line is normalised and hashed; a hash is counted once per document, and all lines whose
hash at least ``min_docs`` documents hold go; the other lines are put together again in order.
Counts are combined in each task before they travel, so a line of all documents is no hot key.
Which lines are frequent is a written table: Spark broadcasts it where its size is below the
session's limit, else it is joined with the rows of hot lines spread.  Only the places of dropped
lines and the texts themselves travel after that.

Defined cases: a null text is an empty text, and an empty text one empty line; every row is a
document of its own, so repeated rows, also of the same id, count each; lines with a normal form
below ``min_chars`` code points stay; a document may lose all its lines and is then empty.  Other
columns are handed on and may have any name.  An empty table gives an empty table.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.common import whole_row
from corpusweave.plans.skew import join_facts
from corpusweave.plans.staging import stage

MIN_DOCS, MIN_CHARS = 10, 1
#: White space at the ends of a line, which its normal form lacks: bytes 20 and 09 to 0D.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a line or of equal documents above which they are spread over several tasks.
HOT_ROWS = 20_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def normal_lines(text: Column) -> Column:
    """The normal forms of a text's lines: ASCII letters in lower case, no blanks at the ends."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.transform(lines_of(lower), lambda line: F.btrim(line, F.lit(BLANKS)))


def hashed_lines(docs: DataFrame, text_col: str, min_chars: int, *more: Column) -> DataFrame:
    """``more`` columns and ``h0, h1, pos, first`` of every line that can be dropped: a 128-bit
    hash, the place in the document, and whether it is the document's first line of that hash."""
    hashed = F.transform(
        normal_lines(F.col(f"`{text_col}`")),
        lambda line, i: F.struct(
            F.xxhash64(line).alias("h0"), F.xxhash64(F.lit(1), line).alias("h1"), i.alias("pos"),
            (F.char_length(line) >= min_chars).alias("counts"),
        ),
    )
    # Sorted, so that equal lines of a document stand side by side.
    in_order = F.sort_array(F.filter(hashed, lambda x: x["counts"]))
    before = F.concat(F.array(F.lit(None)), F.col("in_order"))
    marked = F.zip_with(
        "in_order",
        F.slice(before, F.lit(1), F.size("in_order")),
        lambda x, y: F.struct(
            x["h0"].alias("h0"), x["h1"].alias("h1"), x["pos"].alias("pos"),
            (~(x["h0"].eqNullSafe(y["h0"]) & x["h1"].eqNullSafe(y["h1"]))).alias("first"),
        ),
    )
    names = [f"_m{i}" for i in range(len(more))]
    kept = docs.select(*[m.alias(n) for m, n in zip(more, names)], in_order.alias("in_order"))
    return kept.select(*names, F.inline(marked))


def frequent_lines(
    docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """``h0, h1, n_docs, n_rows``: hashes of the normalised lines that at least ``min_docs``
    documents hold, with the number of those and of the lines."""
    counted = hashed_lines(docs, text_col, min_chars).groupBy("h0", "h1")
    counts = counted.agg(F.count_if("first").alias("n_docs"), F.count("*").alias("n_rows"))
    return counts.where(F.col("n_docs") >= min_docs)


def dedup_lines(
    docs: DataFrame,
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``row, kept, n_lines, n_dropped``: every row of ``docs`` as a struct, its text without
    the frequent lines, and the number of lines before and of lines dropped."""
    if min_docs < 1 or min_chars < 0:
        raise ValueError("min_docs must be at least 1 and min_chars at least 0")
    row, keys = whole_row(docs)
    names = ["h0", "h1"]
    frequent = stage(frequent_lines(docs, text_col, min_docs, min_chars), "frequent-lines")
    lines = hashed_lines(docs, text_col, min_chars, *keys).withColumnsRenamed({"_m0": "d0", "_m1": "d1"})
    facts = frequent.withColumn("dropped", F.lit(True))
    hits = join_facts(lines, facts, names, "n_rows", ["dropped"], hot_rows).where("dropped")
    places = stage(
        hits.groupBy("d0", "d1")
        .agg(F.collect_set("pos").alias("places"), F.count("*").alias("n"))
        .withColumn("copies", F.col("n") / F.size("places")),
        "dropped-lines",
    )
    keyed = docs.select(*[k.alias(f"d{i}") for i, k in enumerate(keys)], row)
    joined = join_facts(keyed, places, ["d0", "d1"], "copies", ["places"], hot_rows)
    text = F.col("row").getField(text_col)
    all_lines = lines_of(text)
    positions = F.sequence(F.lit(0), F.size(all_lines) - 1)
    left = F.transform(F.array_except(positions, "places"), lambda i: F.get(F.col("lines"), i))
    kept = F.when(F.col("places").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(left, "\n"))
    return joined.withColumn("lines", all_lines).select(
        "row", kept.alias("kept"), F.size("lines").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).alias("n_dropped"),
    )


def drop_repeated_lines(docs: DataFrame, text_col: str = "text", **options: int) -> DataFrame:
    """``docs`` with the frequent lines taken out of its texts; options as in ``dedup_lines``."""
    found = dedup_lines(docs, text_col, **options)
    return found.select(
        *[
            (F.col("kept") if c == text_col else F.col("row").getField(c)).alias(c)
            for c in docs.columns
        ]
    )
