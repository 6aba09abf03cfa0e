"""Removal of benchmark passages from training text, in built-in columns only.

Benchmark texts are cut into windows of consecutive normalised words.  A document's windows
become one row each, meet the benchmark's windows in a hash join on a 64-bit hash, and are
verified word by word.  The benchmark's windows are broadcast only while their counted number
stays under a limit; beyond it both sides are shuffled by the hash instead.

Defined cases: null and empty texts have no words, are not contaminated, and as benchmark
items match nothing; an item shorter than a window is one window by itself; an item id that
occurs twice counts once, and a null item id is not listed though its windows count; repeated
document rows are judged one by one, alike.  Empty tables give no hits.  Other columns of
either table may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.common import whole_row
from corpusweave.plans.staging import stage

WINDOW = 10
#: Most benchmark windows that are broadcast (some 200 bytes each).
MAX_BROADCAST = 200_000
# What separates words, before and after A-Z is lower case.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATOR_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text in order; none for a null or empty text."""
    text = F.coalesce(text, F.lit(""))
    # lower() would change other letters too, so it serves plain ASCII texts only.
    plain = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )
    return F.array_remove(F.split(plain, SEPARATOR), "")


def _hash(tokens: str, start: Column, size: int) -> Column:
    """Hash of ``size`` words of the array column ``tokens`` from a 0-based start."""
    return F.xxhash64(F.lit(size), *[F.get(tokens, start + i) for i in range(size)])


def benchmark_windows(
    benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """``item, size, gram, hash``: the windows of every item."""
    items = benchmark.select(
        F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")
    ).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    grams = items.select(
        "item", "w", size.alias("size"),
        F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"),
    ).select("item", "size", F.slice("w", F.col("at"), F.col("size")).alias("gram"))
    hashed = F.lit(None).cast("bigint")
    for n in range(1, window + 1):
        hashed = F.when(F.col("size") == n, _hash("gram", F.lit(0), n)).otherwise(hashed)
    return grams.distinct().withColumn("hash", hashed)


def _positions(rows: DataFrame, sizes: Sequence[int]) -> tuple[DataFrame, Column]:
    """One row per window of each size, plus one with ``idx`` -1 per input row.

    Also gives the start of a window as a column of ``idx`` and the matched ``size``.
    """
    begin, hashed, start = F.lit(0), F.lit(None).cast("bigint"), F.lit(-1)
    for n in sizes:
        here = F.col("idx") - begin
        inside = (here >= 0) & (here <= F.size("w") - n)
        hashed = F.when(inside, _hash("w", here, n)).otherwise(hashed)
        start = F.when(F.col("size") == n, here).otherwise(start)
        begin = begin + F.greatest(F.lit(0), F.size("w") - (n - 1))
    spread = rows.withColumn("idx", F.explode(F.sequence(F.lit(-1), begin - 1)))
    return spread.withColumn("hash", hashed), start


def window_hits(
    docs: DataFrame,
    text_col: str,
    keys: Sequence[Column],
    grams: DataFrame,
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """The keys, ``n_words, start, size, hash`` of every benchmark window found in a text.

    Each input row gives one more row with a null ``start``.  ``grams`` is the written table
    of ``benchmark_windows``.
    """
    grams = grams.select("size", "gram", "hash").distinct()
    sizes = sorted((r["size"] for r in grams.select("size").distinct().collect()), reverse=True)
    rows = docs.select(*keys, words(F.col(text_col)).alias("w"))
    names = rows.columns[:-1]
    found = ("n_words", "start", "size", "hash")
    if not sizes:
        blank = [F.lit(None).cast(t).alias(n) for n, t in zip(found[1:], ("int", "int", "bigint"))]
        return stage(rows.select(*names, F.size("w").alias("n_words"), *blank), "window-hits")
    if grams.count() <= max_broadcast:
        spread, start = _positions(rows, sizes)
        met = spread.join(F.broadcast(grams), "hash", "left")
    else:
        # Words are written, so that only hashes travel; rows that met find their words again.
        kept = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "window-words")
        spread, start = _positions(kept.select("_row", "w"), sizes)
        light = spread.where("idx >= 0").select("_row", "idx", "hash").join(grams, "hash")
        alone = kept.select("_row", F.lit(-1).alias("idx"))
        met = kept.join(alone.unionByName(light, allowMissingColumns=True), "_row")
    hit = F.col("size").isNotNull() & (
        F.slice("w", start + 1, F.col("size")) == F.col("gram")
    )
    return stage(
        met.where((F.col("idx") == -1) | hit).select(
            *names,
            F.size("w").alias("n_words"),
            F.when(F.col("idx") >= 0, start).alias("start"),
            F.when(F.col("idx") >= 0, F.col("size")).alias("size"),
            F.when(F.col("idx") >= 0, F.col("hash")).alias("hash"),
        ),
        "window-hits",
    )


def _covered(spans: Column) -> Column:
    """Number of words in the union of ``start, end`` spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))

    def add(seen: Column, span: Column) -> Column:
        new = F.greatest(F.lit(0), span["end"] - F.greatest(span["start"], seen["reach"]))
        return F.struct(
            (seen["n"] + new).alias("n"), F.greatest(seen["reach"], span["end"]).alias("reach")
        )

    return F.aggregate(F.array_sort(spans), zero, add, lambda seen: seen["n"])


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """``id, n_words, n_hit, spans, items`` per row: merged word counts, hit spans, item ids.

    Documents that hold the same set of windows share one list of items, which is made once.
    """
    grams = stage(benchmark_windows(benchmark, item_col, item_text_col, window), "windows")
    keys = [F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id")]
    seen = window_hits(docs, text_col, keys, grams, max_broadcast)
    span = F.struct("start", (F.col("start") + F.col("size")).alias("end"))
    per_row = seen.groupBy("row", "id", "n_words").agg(
        F.collect_set(F.when(F.col("start").isNotNull(), span)).alias("spans"),
        F.array_sort(F.collect_set("hash")).alias("found"),
    )
    per_row = stage(per_row.withColumn("n_hit", _covered(F.col("spans"))), "contamination")
    clean = per_row.where(F.size("found") == 0).select(
        "id", "n_words", "n_hit", "spans", F.array().cast("array<string>").alias("items")
    )
    hit = per_row.where(F.size("found") > 0)
    lists = (
        hit.select("found")
        .distinct()
        .select("found", F.explode("found").alias("hash"))
        .join(grams.select("hash", "item").distinct(), "hash")
        .groupBy("found")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    listed = hit.join(lists, "found").select("id", "n_words", "n_hit", "spans", "items")
    return clean.unionByName(listed)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_broadcast: int = MAX_BROADCAST,
    remove: str = "documents",
) -> DataFrame:
    """``docs`` without documents that hold a benchmark window, or without the hit spans.

    With ``remove="spans"`` every document stays and loses the words of its hits together
    with what separates each from the next word.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    grams = stage(benchmark_windows(benchmark, item_col, item_text_col, window), "windows")
    row, keys = whole_row(docs)
    hits = window_hits(docs, text_col, keys, grams, max_broadcast).where("start is not null")
    keyed = docs.select(row, *keys)
    if remove == "documents":
        # Written, so that its size is known: as few rows as these are mostly go to every task,
        # and the texts stay where they are.
        dirty = stage(hits.select("h0", "h1").distinct(), "dirty-rows")
        return keyed.join(dirty, ["h0", "h1"], "left_anti").select("row.*")
    span = F.struct("start", (F.col("start") + F.col("size")).alias("end"))
    spans = hits.groupBy("h0", "h1").agg(F.collect_set(span).alias("spans"))
    text = F.col("row").getField(text_col)
    pieces = F.regexp_extract_all(text, F.lit(f"{WORD_ANY_CASE}(?:{SEPARATOR_ANY_CASE})?"), 0)
    rest = F.filter(
        pieces,
        lambda _, i: ~F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"])),
    )
    head = F.regexp_extract(text, f"^(?:{SEPARATOR_ANY_CASE})?", 0)
    cleaned = F.when(F.col("spans").isNull(), text).otherwise(
        F.concat(head, F.array_join(rest, ""))
    )
    joined = keyed.join(spans, ["h0", "h1"], "left")
    return joined.select(
        *[
            (cleaned if c == text_col else F.col("row").getField(c)).alias(c)
            for c in docs.columns
        ]
    )
