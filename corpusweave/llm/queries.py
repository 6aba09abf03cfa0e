"""Registered queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.llm.simhash import fingerprint_hex, simhash_components

    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        fingerprint_hex(F.col("fp")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.llm.toxicity import THRESHOLD, fit_toxicity, held_out, toxicity_score

    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"),
        toxicity_score(model)(F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


@query()
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.llm.quality import THRESHOLD, fit_quality, held_out, quality_score

    docs = table(spark, sf_dir, "documents")
    model = spark.sparkContext.broadcast(fit_quality(docs, table(spark, sf_dir, "labels")))
    return docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"),
        quality_score(model)(F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


@query("""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 10) AS n FROM bw WHERE len(w) > 0),
grams AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i + 1, i + n), ' ') AS gram
  FROM (SELECT item_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM bs)),
sizes AS (SELECT DISTINCT n FROM grams),
hits AS (
  SELECT doc_id, i, n, item_id
  FROM (SELECT doc_id, n, i, array_to_string(list_slice(w, i + 1, i + n), ' ') AS gram
        FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM dw, sizes))
  JOIN grams USING (n, gram)),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
""")
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("n_words").cast("bigint").alias("n_words"),
        F.col("n_hit").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
    hex(encode(coalesce(text, ''))) AS h,
    CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS t,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS g FROM documents),
total AS (SELECT sum(size)::BIGINT AS n FROM d),
groups AS (SELECT t, sum(size)::BIGINT AS s, (sum(sum(size)) OVER (ORDER BY t) - sum(size))::BIGINT AS below
  FROM d GROUP BY t),
wanted AS (SELECT k, k * n AS w, n FROM total, (SELECT unnest(range(1, 8)) AS k)),
straddling AS (
  SELECT k, w, n, min_by(t, t) AS t, min_by(below, t) AS below, min_by(s, t) AS s
  FROM wanted JOIN groups ON (below + s) * 8 >= w GROUP BY k, w, n),
judged AS (
  SELECT *, w - below * 8 AS before, (below + s) * 8 - w AS after FROM straddling),
inside AS (
  SELECT k, w, d.g, below + sum(size) OVER (PARTITION BY k ORDER BY d.g) AS upto,
    below + sum(size) OVER (PARTITION BY k ORDER BY d.g) - size AS upfrom
  FROM judged JOIN d USING (t) WHERE least(before, after) * 1000 > 5 * n),
cut AS (
  SELECT k, min_by(g, g) AS g, min_by(w - upfrom * 8, g) AS before, min_by(upto * 8 - w, g) AS after
  FROM inside WHERE upto * 8 >= w GROUP BY k),
splitters AS (
  SELECT CASE WHEN cut.k IS NOT NULL OR j.before <= j.after THEN t ELSE t + 1 END AS st,
    CASE WHEN cut.k IS NULL THEN 0 WHEN cut.before <= cut.after THEN g ELSE g + 1 END AS sg
  FROM judged j LEFT JOIN cut USING (k)),
crc_table AS (
  SELECT list(c ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS i))),
placed AS (
  SELECT doc_id, size, t, g, h, (SELECT count(*) FROM splitters WHERE st < t OR st = t AND sg <= g) AS shard
  FROM d)
SELECT doc_id, size, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY t, g) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard,
  xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))),
    lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
FROM placed, crc_table
""")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query()
def op9_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.llm.digest import edit_fingerprints

    return edit_fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query()
def op1_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.llm.extraction import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"), keep=("page_id", "url"))


@query("""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
logs AS (
  SELECT conv_id, list(role || chr(1) || text ORDER BY turn) AS said, count(*) AS turns,
    list('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |')
      || '<|im_end|>' || chr(10) ORDER BY turn) AS rendered
  FROM t GROUP BY conv_id),
inner_prefixes AS (
  SELECT DISTINCT sha256(array_to_string(list_slice(said, 1, k), chr(2))) AS h
  FROM (SELECT said, unnest(range(1, turns)) AS k FROM logs)),
whole AS (
  SELECT sha256(array_to_string(said, chr(2))) AS h, min(conv_id) AS conv_id, count(*) AS logged
  FROM logs GROUP BY 1)
SELECT conv_id, CAST(part AS INTEGER) AS part, turns, logged,
  array_to_string(list_slice(rendered, part * 256 + 1, part * 256 + 256), '') AS text
FROM (SELECT w.conv_id, logged, turns, rendered, unnest(range(0, (turns - 1) // 256 + 1)) AS part
      FROM whole w JOIN logs USING (conv_id) WHERE h NOT IN (SELECT h FROM inner_prefixes))
""")
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.llm.chat import render_conversations

    return render_conversations(table(spark, sf_dir, "conversations")).withColumnRenamed("id", "conv_id")


@query()
def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.llm.licences import document_licences, scan_licences, train_licences

    docs = table(spark, sf_dir, "documents")
    found = scan_licences(docs, train_licences(docs))
    return document_licences(found).withColumnRenamed("id", "doc_id")


_ROUND = """
near{i} AS MATERIALIZED (
  SELECT v.n, min_by(c.cluster, (d, c.cluster)) AS cluster, min(d) AS distance
  FROM (SELECT v.n, c.cluster, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS d
        FROM kept v, c{i} c) p JOIN kept v USING (n) JOIN c{i} c USING (cluster) GROUP BY v.n),
"""
_MOVE = """
sums{i} AS (
  SELECT cluster, k, sum(x[k])::HUGEINT AS s, count(*)::HUGEINT AS m
  FROM near{i} JOIN kept USING (n), (SELECT unnest(range(1, 65)) AS k) GROUP BY cluster, k),
c{j} AS MATERIALIZED (
  SELECT cluster, coalesce(y, x) AS x FROM c{i} LEFT JOIN (
    SELECT cluster, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY k) AS y FROM sums{i} GROUP BY cluster)
  USING (cluster)),
"""


@query(
    """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id,
    list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = 64),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS cluster, x
  FROM (SELECT sha256('2:' || vec_id) AS h, x FROM kept ORDER BY h LIMIT 40)),
"""
    + "".join(_ROUND.format(i=i) + (_MOVE.format(i=i, j=i + 1) if i < 5 else "") for i in range(6))
    + """
inertias AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM near5 GROUP BY cluster)
SELECT vec_id, cluster, distance, cluster_inertia, (SELECT sum(distance) FROM near5)::BIGINT AS inertia,
  sha256(array_to_string(c5.x, ',')) AS centroid_sha256
FROM near5 JOIN kept USING (n) JOIN inertias USING (cluster) JOIN c5 USING (cluster)
"""
)
def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.llm.clustering import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query("""
WITH l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
frequent AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT doc_id, pos, line, key IN (SELECT key FROM frequent) AS dropped FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
""")
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "row.doc_id", F.col("n_lines").cast("bigint").alias("n_lines"),
        F.col("n_dropped").cast("bigint").alias("n_dropped"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


@query("""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\\x{C0}-\\x{FF}]{6,}')) AS run FROM documents WHERE text IS NOT NULL),
crc_table AS (
  SELECT list(c ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS i))),
once AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h
  FROM runs GROUP BY doc_id, run),
summed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))),
    lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM once, crc_table),
said AS (
  SELECT CASE WHEN crc % 199 = 0
    THEN left(run, (crc % length(run))::BIGINT) || substring(run, (crc % length(run))::BIGINT + 2) ELSE run END AS word, n
  FROM summed),
vocab AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM said WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
plain AS (
  SELECT word, n, length(word) AS size, translate(word, (SELECT string_agg(chr(192 + i::INTEGER), '' ORDER BY i) FROM range(64) r(i)),
    (SELECT string_agg(chr(33 + i::INTEGER), '' ORDER BY i) FROM range(64) r(i))) AS bytes FROM vocab),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS m FROM plain a JOIN plain b
  ON b.size BETWEEN a.size - 1 AND a.size + 1 AND a.word <> b.word AND levenshtein(a.bytes, b.bytes) = 1),
best AS (
  SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN m END AS form_n,
    CASE WHEN m >= 5 * v.n THEN (SELECT min(other) FROM near x WHERE x.word = v.word AND x.m = best.m) END AS form
  FROM vocab v LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS here, 0 AS depth FROM forms
  UNION ALL
  SELECT walk.word, f.form, depth + 1 FROM walk JOIN forms f ON f.word = walk.here WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n
FROM forms JOIN (SELECT word, max_by(here, depth) AS root FROM walk GROUP BY word) USING (word)
""")
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.llm.spelling import spelling_variants, word_counts

    return spelling_variants(word_counts(table(spark, sf_dir, "documents")))
