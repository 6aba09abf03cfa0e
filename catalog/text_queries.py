"""String functions over whole document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query, table
from catalog.shared import BLANK_SQL, words_sql
from corpusweave.functions import text as tx
from corpusweave.operators.formatting import format_fields, map_rows, python_formatter


def untidy(spark, sf_dir):
    """Documents with doubled blanks, tabs and outer blanks put in."""
    text = F.concat(F.lit("  "), F.regexp_replace("text", " ", " \t "), F.lit("\n "))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


UNTIDY_SQL = (
    "untidy AS (SELECT doc_id, "
    "'  ' || replace(text, ' ', ' ' || chr(9) || ' ') || chr(10) || ' ' AS text FROM documents)"
)


@query(
    f"""WITH {UNTIDY_SQL}
SELECT doc_id, trim(regexp_replace(text, '[{BLANK_SQL}]+', ' ', 'g')) AS text FROM untidy"""
)
def collapse_whitespace(spark, sf_dir):
    return format_fields(untidy(spark, sf_dir), tx.collapse_whitespace)


@query(
    f"""WITH {UNTIDY_SQL}
SELECT doc_id, trim(regexp_replace(text, '[{BLANK_SQL}]+', ' ', 'g')) AS text FROM untidy"""
)
def callable_formatter(spark, sf_dir):
    return format_fields(untidy(spark, sf_dir), python_formatter(lambda s: " ".join(s.split())))


@query(
    f"""SELECT doc_id, array_to_string(
  list_transform({words_sql("text")}, lambda w: reverse(w)), ' ') AS text FROM documents"""
)
def reverse_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return format_fields(docs, tx.reverse_words)


@query("SELECT doc_id, upper(replace(text, 'ß', 'SS')) AS text FROM documents")
def upper_case(spark, sf_dir):
    return format_fields(table(spark, sf_dir, "documents").select("doc_id", "text"), tx.upper)


@query(
    """SELECT doc_id, regexp_replace(
  regexp_replace(text, '[ ]([A-Za-z]{4})[ ]', ' "\\1" ', 'g'), '"([^"]*)"', '«\\1»', 'g') AS text
FROM documents"""
)
def replace_quotes(spark, sf_dir):
    quoted = F.regexp_replace("text", "[ ]([A-Za-z]{4})[ ]", ' "$1" ')
    docs = table(spark, sf_dir, "documents").select("doc_id", quoted.alias("text"))
    return format_fields(docs, tx.replace_quotes)


@query("SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents")
def newline_to_space(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return format_fields(docs, tx.newline_to_space)


@query(
    """SELECT conv_id, turn,
       'Instruct: Retrieve parallel sentences.' || chr(10) || 'Query: ' || text AS text
FROM conversations"""
)
def instruct_prefix(spark, sf_dir):
    def prepare(df, task_description, column):
        return df.withColumn(column, tx.instruct_prefix(F.col(column), task_description))

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return map_rows(
        turns, prepare, task_description="Retrieve parallel sentences.", column="text"
    )


@query(
    """SELECT doc_id, upper(replace(text, 'ß', 'SS')) AS text, upper(source) AS source
FROM documents"""
)
def format_fields_nested(spark, sf_dir):
    """Fields inside a map and a struct are reached by path."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.struct("text", "lang").alias("body"),
        F.create_map(F.lit("source"), "source", F.lit("lang"), "lang").alias("metadata"),
    )
    done = format_fields(docs, tx.upper, ["body.text", "metadata['source']"])
    return done.select("doc_id", "body.text", F.col("metadata")["source"].alias("source"))


@query("SELECT doc_id, lang || ':' || source AS tag, length(text) * 2 AS twice FROM documents")
def map_rows_expression(spark, sf_dir):
    def tag(df, separator):
        return df.select(
            "doc_id",
            F.concat("lang", F.lit(separator), "source").alias("tag"),
            (F.char_length("text") * 2).cast("bigint").alias("twice"),
        )

    return map_rows(table(spark, sf_dir, "documents"), tag, separator=":")
