"""Embeddings: similarity filters, range search, greedy duplicate removal, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query, table
from catalog.shared import PAIRS_SQL, turn_pairs
from corpusweave.functions.text import collapse_whitespace
from corpusweave.operators import embeddings as em
from corpusweave.operators import similarity as sim
from corpusweave.operators.filters import with_verdict

T = 0.3
#: Small cells, so that the small tables have several.
CELL = 128


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def neighbours(spark, sf_dir):
    """Each vector next to the following one."""
    first = vectors(spark, sf_dir)
    second = first.select(
        (F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("embedding_2")
    )
    return first.join(second, "vec_id", "left")


@query(
    """SELECT a.vec_id,
  CASE WHEN b.embedding IS NULL THEN 'missing_embedding' END AS drop_reason,
  coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.05, false) AS keep
FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
)
def translation_similarity_filter(spark, sf_dir):
    verdict = em.translation_similarity(["embedding", "embedding_2"], 0.05)
    return with_verdict(neighbours(spark, sf_dir), verdict).select("vec_id", "keep", "drop_reason")


def embedding_sql(table: str, key: str, dim: int = 64) -> str:
    return f"""SELECT {key}, cell, count(*)::DOUBLE AS v FROM (
  SELECT {key}, (unicode(substr(text, i, 1)) * 31 + unicode(substr(text, i + 1, 1))) % {dim} AS cell
  FROM (SELECT {key}, text, unnest(range(1, length(text))) AS i FROM {table})) GROUP BY ALL"""


@query(
    f"""SELECT conv_id, turn, cell::INT AS cell, v
FROM ({embedding_sql("conversations", "conv_id, turn")})"""
)
def embed_batches(spark, sf_dir):
    embed = em.embed_texts(em.hashed_ngram_embedder(64), batch_size=100)
    turns = table(spark, sf_dir, "conversations").withColumn("vec", embed(F.col("text")))
    cells = turns.select("conv_id", "turn", F.posexplode("vec").alias("cell", "v"))
    return cells.where("v > 0").withColumn("v", F.col("v").cast("double"))


@query(
    f"""WITH {PAIRS_SQL}, texts AS (
  SELECT conv_id, turn, 1 AS side, trim(regexp_replace(text_1, '[\\t\\n\\r \\p{{Z}}]+', ' ', 'g')) AS text
  FROM pairs
  UNION ALL SELECT conv_id, turn, 2, text_2 FROM pairs),
cells AS ({embedding_sql("texts", "conv_id, turn, side")}),
dots AS (
  SELECT a.conv_id, a.turn, sum(a.v * b.v) AS ab
  FROM cells a JOIN cells b USING (conv_id, turn, cell) WHERE a.side = 1 AND b.side = 2
  GROUP BY ALL),
norms AS (
  SELECT conv_id, turn, sqrt(sum(v * v) FILTER (side = 1)) AS a, sqrt(sum(v * v) FILTER (side = 2)) AS b
  FROM cells GROUP BY ALL)
SELECT conv_id, turn, ab / (a * b) > 0.8 AS keep FROM dots JOIN norms USING (conv_id, turn)"""
)
def embedded_pairs_filter(spark, sf_dir):
    """Texts are prepared, embedded in batches and compared."""
    pairs = em.with_pair_embeddings(
        turn_pairs(spark, sf_dir),
        ["text_1", "text_2"],
        em.embed_texts(em.hashed_ngram_embedder(64)),
        query_prepare=collapse_whitespace,
    )
    verdict = em.translation_similarity(["embedding_1", "embedding_2"], 0.8)
    return with_verdict(pairs, verdict).select("conv_id", "turn", "keep")


NEAR_SQL = f"""vecs AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
near AS MATERIALIZED (
  SELECT a.vec_id AS src, b.vec_id AS dst, list_dot_product(a.v, b.v) AS score
  FROM vecs a JOIN vecs b ON a.vec_id < b.vec_id AND list_dot_product(a.v, b.v) > {T})"""


@query(f"WITH {NEAR_SQL} SELECT src, dst, round(score, 6) AS score FROM near")
def similarity_join(spark, sf_dir):
    found = sim.similarity_join(
        vectors(spark, sf_dir), "vec_id", "embedding", T, copies="all", cell_rows=CELL
    )
    return found.withColumn("score", F.round("score", 6))


@query(f"WITH {NEAR_SQL} SELECT src, dst, round(score, 6) AS score FROM near")
def similarity_join_in_two_levels(spark, sf_dir):
    """More cells than one table of pivots may have, so cells are divided again."""
    found = sim.similarity_join(
        vectors(spark, sf_dir), "vec_id", "embedding", T, cell_rows=32, max_pivots=8
    )
    return found.withColumn("score", F.round("score", 6))


@query(f"WITH {NEAR_SQL} SELECT src, dst, round(score, 6) AS score FROM near")
def similarity_join_projected(spark, sf_dir):
    """Hyperplane buckets wide enough to miss a pair with a chance below 1e-12."""
    found = sim.similarity_join(
        vectors(spark, sf_dir), "vec_id", "embedding", T, index="projections", copies="all", tables=32, bits=1
    )
    return found.withColumn("score", F.round("score", 6))


def scan_sql(near: str, rows: str, name: str) -> str:
    """The greedy scan as a recursion over rows in id order; the state is the kept list."""
    return f"""{name}_lower AS MATERIALIZED (
  SELECT r.vec_id, row_number() OVER (ORDER BY r.vec_id) AS rn,
         coalesce(list(n.src) FILTER (n.src IS NOT NULL), []) AS below
  FROM {rows} r LEFT JOIN {near} n ON n.dst = r.vec_id GROUP BY r.vec_id),
{name}_scan(rn, kept) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT l.rn, CASE WHEN list_has_any(s.kept, l.below) THEN s.kept
                    ELSE list_append(s.kept, l.vec_id) END
  FROM {name}_scan s JOIN {name}_lower l ON l.rn = s.rn + 1),
{name} AS (SELECT unnest(kept) AS vec_id FROM {name}_scan ORDER BY len(kept) DESC)"""


def last_kept(name: str) -> str:
    return f"(SELECT unnest(kept) AS vec_id FROM (SELECT kept FROM {name}_scan ORDER BY rn DESC LIMIT 1))"


GREEDY_SQL = scan_sql("near", "vecs", "whole").rpartition(",\nwhole AS")[0]


@query(f"WITH RECURSIVE {NEAR_SQL}, {GREEDY_SQL} SELECT vec_id FROM {last_kept('whole')}")
def greedy_dedup(spark, sf_dir):
    return sim.greedy_dedup(vectors(spark, sf_dir), "vec_id", "embedding", T, cell_rows=CELL)


@query(f"WITH RECURSIVE {NEAR_SQL}, {GREEDY_SQL} SELECT vec_id FROM {last_kept('whole')}")
def greedy_dedup_by_rounds(spark, sf_dir):
    """Rounds over the pairs to the end."""
    return sim.greedy_dedup(
        vectors(spark, sf_dir), "vec_id", "embedding", T, scan_pairs=0, cell_rows=CELL
    )


@query(f"WITH RECURSIVE {NEAR_SQL}, {GREEDY_SQL} SELECT vec_id FROM {last_kept('whole')}")
def greedy_dedup_by_component(spark, sf_dir):
    """One round over the pairs, then a scan of each component, 200 pairs at a time."""
    return sim.greedy_dedup(
        vectors(spark, sf_dir), "vec_id", "embedding", T, rounds=1, scan_pairs=200, cell_rows=CELL
    )


BATCHED_SQL = f"""{NEAR_SQL},
batches AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 128 AS batch FROM vecs),
inside AS (
  SELECT src, dst FROM near JOIN batches a ON a.vec_id = src JOIN batches b ON b.vec_id = dst
  WHERE a.batch = b.batch),
{scan_sql("inside", "vecs", "parts").rpartition(",{0}parts AS".format(chr(10)))[0]},
survivors AS (SELECT vec_id FROM {last_kept("parts")})"""


@query(f"WITH RECURSIVE {BATCHED_SQL} SELECT vec_id, batch FROM survivors JOIN batches USING (vec_id)")
def batched_semantic_dedup(spark, sf_dir):
    return sim.batched_dedup(vectors(spark, sf_dir), "vec_id", "embedding", T, batch_size=128)


@query(
    f"""WITH RECURSIVE {BATCHED_SQL},
between AS (
  SELECT src, dst FROM near WHERE src IN (FROM survivors) AND dst IN (FROM survivors)),
{scan_sql("between", "survivors", "again").rpartition(",{0}again AS".format(chr(10)))[0]}
SELECT vec_id FROM {last_kept("again")}"""
)
def two_pass_semantic_dedup(spark, sf_dir):
    return sim.two_pass_dedup(
        vectors(spark, sf_dir), "vec_id", "embedding", T, batch_size=128, cell_rows=CELL
    )


@query(
    """WITH pairs AS (
  SELECT a.vec_id, a.embedding::DOUBLE[] AS s,
         list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE + p[2]::DOUBLE) AS t
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
scores AS (
  SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.s, b.t), 9) AS c
  FROM pairs a, pairs b),
forth AS (SELECT src, arg_min(dst, (-c, dst)) AS best FROM scores GROUP BY src),
back AS (SELECT dst, arg_min(src, (-c, src)) AS best FROM scores GROUP BY dst)
SELECT 'src2trg' AS way, avg((src = best)::INT) AS accuracy FROM forth
UNION ALL SELECT 'trg2src', avg((dst = best)::INT) FROM back"""
)
def translation_retrieval_accuracy(spark, sf_dir):
    """A vector's translation is its sum with the next vector."""
    mixed = F.zip_with(
        "embedding", "embedding_2", lambda x, y: x.cast("double") + y.cast("double")
    )
    pairs = neighbours(spark, sf_dir).where("embedding_2 IS NOT NULL")
    pairs = pairs.select("vec_id", F.col("embedding").cast("array<double>"), mixed.alias("mixed"))
    return sim.translation_retrieval_accuracy(pairs, "vec_id", "embedding", "mixed")
