"""Filters over consecutive conversation turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.shared import PAIRS_SQL, turn_pairs, words_sql
from corpusweave.operators.filters import (
    apply_filters,
    drop_reasons,
    filter_summary,
    length_ratio,
    regex_counter,
    with_verdict,
)

TEXTS = ["text_1", "text_2"]
VERDICT_COLUMNS = ["conv_id", "turn", "keep", "drop_reason"]


def blank_some(df):
    """Blank out or remove some texts so that the reasons for dropping occur."""
    return df.withColumn(
        "text_2",
        F.when(F.col("turn") == 2, F.lit("")).when(F.col("turn") == 3, F.lit(None)).otherwise(
            F.col("text_2")
        ),
    )


BLANKED_SQL = """blanked AS (
  SELECT conv_id, turn, text_1,
         CASE WHEN turn = 2 THEN '' WHEN turn = 3 THEN NULL ELSE text_2 END AS text_2
  FROM pairs)"""


def ratio_sql(measure, threshold: float) -> str:
    n, m = measure("text_1"), measure("text_2")
    return f"""WITH {PAIRS_SQL}, {BLANKED_SQL}, judged AS (
  SELECT conv_id, turn, {n} AS n, {m} AS m,
         CASE WHEN text_1 IS NULL OR text_2 IS NULL THEN 'missing_text'
              WHEN least({n}, {m}) = 0 THEN 'empty_text' END AS drop_reason
  FROM blanked)
SELECT conv_id, turn, drop_reason,
       drop_reason IS NULL AND greatest(n, m)::DOUBLE / least(n, m) <= {threshold} AS keep
FROM judged"""


@query(ratio_sql(lambda c: f"length({c})", 1.8))
def length_ratio_filter(spark, sf_dir):
    pairs = blank_some(turn_pairs(spark, sf_dir))
    return with_verdict(pairs, length_ratio(TEXTS, 1.8)).select(VERDICT_COLUMNS)


@query(ratio_sql(lambda c: f"len({words_sql(c)})", 2.0))
def length_ratio_filter_words(spark, sf_dir):
    pairs = blank_some(turn_pairs(spark, sf_dir))
    return with_verdict(pairs, length_ratio(TEXTS, 2.0, "words")).select(VERDICT_COLUMNS)


def counter_sql(pattern: str, group: int = 0) -> str:
    def found(c: str) -> str:
        return f"list_sort(regexp_extract_all({c}, '{pattern}', {group}))"

    return f"""WITH {PAIRS_SQL}, {BLANKED_SQL}
SELECT conv_id, turn,
       CASE WHEN text_1 IS NULL OR text_2 IS NULL THEN 'missing_text' END AS drop_reason,
       coalesce({found("text_1")} = {found("text_2")}, false) AS keep
FROM blanked"""


@query(counter_sql("[.?!]"))
def regex_counter_filter(spark, sf_dir):
    pairs = blank_some(turn_pairs(spark, sf_dir))
    return with_verdict(pairs, regex_counter(TEXTS, "[.?!]")).select(VERDICT_COLUMNS)


@query(counter_sql("([.?!])[ ]", 1))
def regex_counter_filter_group(spark, sf_dir):
    pairs = blank_some(turn_pairs(spark, sf_dir))
    return with_verdict(pairs, regex_counter(TEXTS, "([.?!])[ ]")).select(VERDICT_COLUMNS)


def chain():
    return {
        "length_ratio": length_ratio(TEXTS, 1.8),
        "regex_counter": regex_counter(TEXTS, "[.?!]"),
    }


CHAIN_SQL = f"""{PAIRS_SQL}, {BLANKED_SQL}, flags AS (
  SELECT conv_id, turn, text_1, text_2,
         coalesce(text_1 IS NOT NULL AND text_2 IS NOT NULL
                  AND least(length(text_1), length(text_2)) > 0
                  AND greatest(length(text_1), length(text_2))::DOUBLE
                      / least(length(text_1), length(text_2)) <= 1.8, false) AS ratio_ok,
         list_sort(regexp_extract_all(text_1, '[.?!]'))
           = list_sort(regexp_extract_all(text_2, '[.?!]')) AS regex_ok
  FROM blanked), judged AS (
  SELECT conv_id, turn, text_1, text_2,
         CASE WHEN NOT ratio_ok THEN 'length_ratio' WHEN NOT regex_ok THEN 'regex_counter' END
           AS drop_step,
         CASE WHEN NOT ratio_ok THEN
                CASE WHEN text_1 IS NULL OR text_2 IS NULL THEN 'missing_text'
                     WHEN least(length(text_1), length(text_2)) = 0 THEN 'empty_text' END
         END AS drop_reason
  FROM flags)"""


@query(f"WITH {CHAIN_SQL} SELECT conv_id, turn, text_1, text_2 FROM judged WHERE drop_step IS NULL")
def kept_pairs(spark, sf_dir):
    judged = apply_filters(blank_some(turn_pairs(spark, sf_dir)), chain())
    return judged.where("keep").select("conv_id", "turn", "text_1", "text_2")


@query(
    f"""WITH {CHAIN_SQL} SELECT drop_step, drop_reason, count(*) AS n_rows
FROM judged GROUP BY ALL"""
)
def apply_filters_reasons(spark, sf_dir):
    return drop_reasons(apply_filters(blank_some(turn_pairs(spark, sf_dir)), chain()))


@query(
    f"""WITH {CHAIN_SQL}
SELECT 0 AS position, 'length_ratio' AS step, count(*) AS total,
       count(*) FILTER (drop_step IS DISTINCT FROM 'length_ratio') AS forwarded,
       count(*) FILTER (drop_step = 'length_ratio') AS dropped
FROM judged
UNION ALL
SELECT 1, 'regex_counter', count(*), count(*) FILTER (drop_step IS NULL),
       count(*) FILTER (drop_step = 'regex_counter')
FROM judged WHERE drop_step IS DISTINCT FROM 'length_ratio'"""
)
def apply_filters_summary(spark, sf_dir):
    judged = apply_filters(blank_some(turn_pairs(spark, sf_dir)), chain())
    return filter_summary(judged, list(chain()))
