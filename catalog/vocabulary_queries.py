"""Vocabularies derived from whole texts, id sets, and start vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import query, table
from catalog.shared import words_sql
from corpusweave.operators import ranges as rg
from corpusweave.operators import vectors as vt
from corpusweave.operators import vocabulary as vb

SYMBOLS = ("<lang>", "<sep>")


def vocab_sql(name: str, source: str, size: int, symbols=SYMBOLS, split_digits: bool = True) -> str:
    fixed = [(p, t) for p, t in vb.RESERVED] + [(s, vb.USER_DEFINED) for s in symbols]
    values = ", ".join(f"({i}, '{p}', 0.0::DOUBLE, '{t}')" for i, (p, t) in enumerate(fixed))
    marked = f"list_transform({words_sql('text')}, lambda w: '{vb.WORD_START}' || w)"
    if split_digits:
        cut = f"regexp_replace(array_to_string({marked}, ' '), '(\\p{{Nd}})', ' \\1 ', 'g')"
        marked = words_sql(cut)
    names = ", ".join(f"'{p}'" for p, _ in fixed)
    return f"""{name}_counts AS (
  SELECT piece, count(*) AS n FROM (SELECT unnest({marked}) AS piece FROM {source}) GROUP BY piece),
{name} AS (
  SELECT i::INT AS id, p AS piece, s AS score, t AS type FROM (VALUES {values}) v(i, p, s, t)
  UNION ALL
  SELECT (row_number() OVER (ORDER BY n DESC, piece) - 1 + {len(fixed)})::INT, piece,
         ln(n / (SELECT sum(n) FROM {name}_counts)::DOUBLE), 'NORMAL'
  FROM (SELECT * FROM {name}_counts WHERE piece NOT IN ({names})
        ORDER BY n DESC, piece LIMIT {size - len(fixed)}))"""


def vocab(spark, sf_dir, source="documents", size=2000, **kwargs):
    return vb.corpus_vocab(
        table(spark, sf_dir, source), "text", size, user_symbols=SYMBOLS, **kwargs
    )


def rounded(df):
    return df.select("id", "piece", F.round("score", 9).alias("score"), "type")


ROUNDED = "id, piece, round(score, 9) AS score, type"
DOCS_VOCAB = vocab_sql("old_vocab", "documents", 2000)
TURNS_VOCAB = vocab_sql("new_vocab", "conversations", 1500)


@query(f"WITH {DOCS_VOCAB} SELECT {ROUNDED} FROM old_vocab")
def corpus_vocab(spark, sf_dir):
    return rounded(vocab(spark, sf_dir))


@query(
    f"""WITH {DOCS_VOCAB}
SELECT id, replace(piece, '{vb.WORD_START}', ' ') AS piece, trunc(exp(score) * 1000000)::BIGINT AS freq
FROM old_vocab WHERE score < 0"""
)
def vocab_frequencies(spark, sf_dir):
    return vb.vocab_frequencies(vocab(spark, sf_dir))


@query(
    f"""WITH {DOCS_VOCAB}, {TURNS_VOCAB}, added AS (
  SELECT * FROM new_vocab
  WHERE type IN ('NORMAL', 'USER_DEFINED') AND piece NOT IN (SELECT piece FROM old_vocab)),
merged AS (
  SELECT * FROM old_vocab
  UNION ALL
  SELECT (row_number() OVER (ORDER BY id) + (SELECT max(id) FROM old_vocab))::INT, piece,
         CASE type WHEN 'NORMAL' THEN score + (SELECT min(score) FROM old_vocab) ELSE 0.0 END, type
  FROM added)
SELECT {ROUNDED} FROM merged"""
)
def merge_vocab(spark, sf_dir):
    new = vocab(spark, sf_dir, "conversations", 1500)
    return rounded(vb.merge_vocab(vocab(spark, sf_dir), new))


@query(f"WITH {DOCS_VOCAB} SELECT {ROUNDED} FROM old_vocab WHERE id < 700")
def shrink_vocab(spark, sf_dir):
    return rounded(vb.shrink_vocab(vocab(spark, sf_dir), target_size=700))


@query(
    f"""WITH {DOCS_VOCAB}
SELECT {ROUNDED} FROM old_vocab WHERE id < (SELECT count(*) FROM old_vocab) - 300"""
)
def shrink_vocab_tail(spark, sf_dir):
    return rounded(vb.shrink_vocab(vocab(spark, sf_dir), remove_count=300))


@query(
    f"""WITH {DOCS_VOCAB}, ranked AS (
  SELECT *, row_number() OVER (ORDER BY round(score, 9), id) AS low FROM old_vocab)
SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS id, piece, round(score, 9) AS score, type
FROM ranked WHERE low > 300"""
)
def shrink_vocab_by_score(spark, sf_dir):
    return vb.shrink_vocab(rounded(vocab(spark, sf_dir)), remove_count=300, by_score=True)


@query(
    f"""WITH {DOCS_VOCAB}, {TURNS_VOCAB}
SELECT id FROM new_vocab WHERE piece NOT IN (SELECT piece FROM old_vocab) ORDER BY id"""
)
def diff_vocab(spark, sf_dir):
    return vb.diff_vocab(vocab(spark, sf_dir), vocab(spark, sf_dir, "conversations", 1500))


@query(
    """WITH ids AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id FROM lineitem),
runs AS (SELECT id, id - row_number() OVER (ORDER BY id) AS run FROM ids)
SELECT min(id) AS start, max(id) AS end FROM runs GROUP BY run"""
)
def compress_ranges(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    ids = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return rg.compress_ranges(ids, "id")


@query(
    """WITH ids AS (SELECT DISTINCT o_orderpriority, o_custkey AS id FROM orders),
runs AS (
  SELECT o_orderpriority, id,
         id - row_number() OVER (PARTITION BY o_orderpriority ORDER BY id) AS run FROM ids)
SELECT o_orderpriority, min(id) AS start, max(id) AS end FROM runs GROUP BY o_orderpriority, run"""
)
def compress_ranges_grouped(spark, sf_dir):
    return rg.compress_ranges(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderpriority"])


def part_ranges(spark, sf_dir):
    """Inclusive ranges, some of them inverted or beyond the ends."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") * 7 - 3).alias("start"),
        (F.col("l_partkey") * 7 - 6 + F.col("l_linenumber")).alias("end"),
    )


def covered_sql(n: str) -> str:
    return f"""covered AS (
  SELECT DISTINCT unnest(range(greatest(0, l_partkey * 7 - 3),
                               least({n} - 1, l_partkey * 7 - 6 + l_linenumber) + 1)) AS id
  FROM lineitem)"""


# Ids up to the largest end of a range, and up to a place among the ranges.
ALL_IDS = "(SELECT max(l_partkey) * 7 + 8 FROM lineitem)"
CLAMPED = 10_000


def all_ids(spark, sf_dir) -> int:
    return table(spark, sf_dir, "lineitem").agg(F.max("l_partkey") * 7 + 8).first()[0]


@query(f"WITH {covered_sql(ALL_IDS)} SELECT id FROM covered")
def expand_ranges(spark, sf_dir):
    return rg.expand_ranges(part_ranges(spark, sf_dir), all_ids(spark, sf_dir))


@query(f"WITH {covered_sql(str(CLAMPED))} SELECT id FROM covered")
def expand_ranges_clamped(spark, sf_dir):
    """Ranges that cross the upper end are clamped, those beyond it go."""
    return rg.expand_ranges(part_ranges(spark, sf_dir), CLAMPED)


@query(
    f"""WITH {covered_sql(ALL_IDS)}
SELECT i AS id, i IN (SELECT id FROM covered) AS member FROM (SELECT unnest(range({ALL_IDS})) AS i)"""
)
def ranges_to_mask(spark, sf_dir):
    return rg.ranges_to_mask(part_ranges(spark, sf_dir), all_ids(spark, sf_dir))


@query(
    """SELECT i AS id, i IN (SELECT o_custkey FROM orders) AS member
FROM (SELECT unnest(range((SELECT max(o_custkey) + 1 FROM orders))) AS i)"""
)
def ids_to_mask(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    n = orders.agg(F.max("o_custkey") + 1).first()[0]
    return rg.ids_to_mask(orders, n, "o_custkey")


SPECIAL = [str(i) for i in range(60)]


def vector_tables(spark, sf_dir):
    """Vectors as an old vocabulary, labels as new tokens made of the vectors that bear them."""
    rows = table(spark, sf_dir, "embeddings")
    name = F.concat(F.lit("L"), F.col("label").cast("string"))
    old = rows.select(F.col("vec_id").cast("string").alias("token"), F.col("embedding").alias("vec"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    parts = rows.select(
        name.alias("token"), place.alias("pos"), F.col("vec_id").cast("string").alias("piece")
    )
    tokens = rows.select(name.alias("token")).distinct().unionByName(old.select("token"))
    return tokens, old, parts


def by_dimension(vectors):
    return vectors.select("token", F.posexplode("vec").alias("dim", "v")).withColumn(
        "v", F.round("v", 6)
    )


KNOWN_SQL = """SELECT vec_id::VARCHAR AS token, unnest(range(64))::INT AS dim, unnest(embedding) AS v
FROM embeddings"""


@query(
    f"""WITH dims AS (
  SELECT 'L' || label AS token, unnest(range(64))::INT AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT token, dim, round(avg(v), 6) AS v FROM dims GROUP BY token, dim
UNION ALL SELECT token, dim, round(v::DOUBLE, 6) FROM ({KNOWN_SQL})"""
)
def init_vectors_mean(spark, sf_dir):
    return by_dimension(vt.init_vectors_mean(*vector_tables(spark, sf_dir)))


@query(
    f"""WITH dims AS (
  SELECT unnest(range(64))::INT AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings),
mean AS (SELECT dim, avg(v) AS v FROM dims GROUP BY dim)
SELECT token, dim, round(v, 6) AS v FROM (SELECT DISTINCT 'L' || label AS token FROM embeddings), mean
UNION ALL SELECT token, dim, round(v::DOUBLE, 6) FROM ({KNOWN_SQL})"""
)
def init_vectors_overall_mean(spark, sf_dir):
    return by_dimension(vt.init_vectors_mean(*vector_tables(spark, sf_dir), mode="mean"))


@query(
    f"""WITH chosen AS (SELECT 'L' || label AS token, min(vec_id) AS vec_id FROM embeddings GROUP BY label)
SELECT token, unnest(range(64))::INT AS dim, round(unnest(embedding)::DOUBLE, 6) AS v
FROM chosen JOIN embeddings USING (vec_id)
UNION ALL SELECT token, dim, round(v::DOUBLE, 6) FROM ({KNOWN_SQL})"""
)
def init_vectors_first(spark, sf_dir):
    return by_dimension(vt.init_vectors_first(*vector_tables(spark, sf_dir)))


@query(
    f"""WITH chosen AS (
  SELECT 'L' || label AS token,
         coalesce(min(vec_id) FILTER (vec_id >= {len(SPECIAL)}), min(vec_id)) AS vec_id
  FROM embeddings GROUP BY label)
SELECT token, unnest(range(64))::INT AS dim, round(unnest(embedding)::DOUBLE, 6) AS v
FROM chosen JOIN embeddings USING (vec_id)
UNION ALL SELECT token, dim, round(v::DOUBLE, 6) FROM ({KNOWN_SQL})"""
)
def init_vectors_first_clear(spark, sf_dir):
    tokens, old, parts = vector_tables(spark, sf_dir)
    return by_dimension(
        vt.init_vectors_first(tokens, old, parts, clear_tokenization=True, special_pieces=SPECIAL)
    )
