"""Translation metrics with consecutive turns as prediction and reference."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from catalog import query
from catalog.shared import BLANK_SQL, PAIRS_SQL, turn_pairs, words_sql
from corpusweave.operators import translation_metrics as tm


def _13a_sql(text: str) -> str:
    text = f"replace(replace(replace({text}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for entity, char in tm.ENTITIES_13A:
        text = f"replace({text}, '{entity}', '{char}')"
    text = f"' ' || {text} || ' '"
    for pattern, by in tm.TOKENIZER_13A:
        text = f"regexp_replace({text}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return words_sql(text)


def grams_sql(name: str, items: str, order: int, separator: str) -> str:
    """Clipped n-gram counts per row from ``sides(k, side, items)``."""
    parts = " UNION ALL ".join(
        f"""SELECT k, side, {n} AS n, unnest(list_transform(range(1, len(items) - {n} + 2),
  lambda i: array_to_string(items[i:i + {n - 1}], '{separator}'))) AS gram FROM {items}"""
        for n in range(1, order + 1)
    )
    return f"""{name}_grams AS ({parts}),
{name}_clipped AS (
  SELECT k, n, gram, count(*) FILTER (side = 1) AS h, count(*) FILTER (side = 2) AS r
  FROM {name}_grams GROUP BY ALL),
{name} AS (
  SELECT k, n, sum(h) AS hyp, sum(r) AS ref, sum(least(h, r)) AS matched
  FROM {name}_clipped GROUP BY ALL)"""


def sides_sql(name: str, items) -> str:
    return f"""{name} AS (
  SELECT conv_id || ':' || turn AS k, 1 AS side, {items("text_1")} AS items FROM pairs
  UNION ALL SELECT conv_id || ':' || turn, 2, {items("text_2")} FROM pairs)"""


@query(
    f"""WITH {PAIRS_SQL}, {sides_sql("tokens", _13a_sql)}, {grams_sql("counts", "tokens", 4, " ")},
totals AS (
  SELECT n, sum(hyp)::DOUBLE AS hyp, sum(ref)::DOUBLE AS ref, sum(matched)::DOUBLE AS matched
  FROM counts GROUP BY n),
smoothed AS (
  SELECT n, hyp, ref, CASE WHEN matched = 0 THEN
           100.0 / (pow(2, count(*) FILTER (matched = 0) OVER (ORDER BY n)) * hyp)
         ELSE 100.0 * matched / hyp END AS p
  FROM totals),
parts AS (
  SELECT (max(hyp) FILTER (n = 1))::BIGINT AS sys_len, (max(ref) FILTER (n = 1))::BIGINT AS ref_len,
         avg(ln(p)) AS logs FROM smoothed)
SELECT round(CASE WHEN sys_len < ref_len THEN exp(1 - ref_len / sys_len::DOUBLE) ELSE 1 END
             * exp(logs), 9) AS bleu,
       sys_len, ref_len
FROM parts"""
)
def corpus_bleu(spark, sf_dir):
    bleu = tm.corpus_bleu(turn_pairs(spark, sf_dir), "text_1", "text_2")
    return bleu.select(F.round("bleu", 9).alias("bleu"), "sys_len", "ref_len")


def _chars_sql(text: str) -> str:
    return f"string_split(regexp_replace({text}, '[{BLANK_SQL}]+', '', 'g'), '')"


def _cut_words_sql(text: str) -> str:
    marks = string.punctuation.replace("'", "''")
    return f"""flatten(list_transform({words_sql(text)}, lambda w: CASE
  WHEN length(w) = 1 THEN [w]
  WHEN contains('{marks}', right(w, 1)) THEN [left(w, length(w) - 1), right(w, 1)]
  WHEN contains('{marks}', left(w, 1)) THEN [left(w, 1), right(w, length(w) - 1)]
  ELSE [w] END))"""


@query(
    f"""WITH {PAIRS_SQL}, {sides_sql("chars", _chars_sql)}, {grams_sql("char_counts", "chars", 6, "")},
{sides_sql("words", _cut_words_sql)}, {grams_sql("word_counts", "words", 2, " ")},
totals AS (
  SELECT u, n, sum(CASE WHEN ref > 0 THEN hyp ELSE 0 END)::DOUBLE AS hyp, sum(ref)::DOUBLE AS ref,
         sum(matched)::DOUBLE AS matched
  FROM (SELECT 'c' AS u, * FROM char_counts UNION ALL SELECT 'w', * FROM word_counts) GROUP BY u, n),
means AS (
  SELECT avg(matched / hyp) AS p, avg(matched / ref) AS r FROM totals WHERE hyp > 0 AND ref > 0)
SELECT round(100 * 5 * p * r / (4 * p + r), 9) AS chrf FROM means"""
)
def corpus_chrf(spark, sf_dir):
    chrf = tm.corpus_chrf(turn_pairs(spark, sf_dir), "text_1", "text_2")
    return chrf.select(F.round("chrf", 9).alias("chrf"))
