"""Inputs that several registered queries use, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import table

# Blanks of corpusweave.functions.text, as RE2 writes them.
BLANK_SQL = r"\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}"


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns of a conversation as a two-text table."""
    turns = table(spark, sf_dir, "conversations")
    first = turns.select("conv_id", "turn", F.col("text").alias("text_1"))
    second = turns.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text_2")
    )
    return first.join(second, ["conv_id", "turn"])


PAIRS_SQL = """pairs AS (
  SELECT a.conv_id, a.turn, a.text AS text_1, b.text AS text_2
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def words_sql(text: str) -> str:
    return f"regexp_extract_all({text}, '[^{BLANK_SQL}]+')"
