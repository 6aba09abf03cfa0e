"""Near-duplicate documents and repeated lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query, table
from catalog.shared import BLANK_SQL, words_sql
from corpusweave.functions.shingles import ACCENTED, PLAIN, PRIME, hash_family
from corpusweave.functions.text import BLANKS
from corpusweave.operators import minhash as mh
from corpusweave.operators import segmentation as sg
from corpusweave.operators import sentences as st
from corpusweave.plans import jobs
from corpusweave.plans.staging import shared_path
from corpusweave.sources import readers

CONFIG = mh.MinhashConfig()


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def normal_sql(text: str) -> str:
    """SQL of corpusweave.functions.shingles.normalize_text."""
    accents = f"translate(lower({text}), '{ACCENTED}', '{PLAIN}')"
    marks = rf"regexp_replace({accents}, '[\x{{300}}-\x{{36F}}]', '', 'g')"
    numbers = rf"regexp_replace({marks}, '\p{{Nd}}+', '0', 'g')"
    letters = rf"regexp_replace({numbers}, '[\p{{P}}\p{{S}}]+', '', 'g')"
    return f"trim(regexp_replace({letters}, '[{BLANK_SQL}]+', ' ', 'g'))"


def _signature_sql(precision: int = 32) -> str:
    n = CONFIG.n_grams
    a, b = hash_family(CONFIG.num_buckets * CONFIG.hashes_per_bucket, CONFIG.seed)
    if precision == 32:
        family, modulus = "({0} * x + {1}) % " + str(PRIME), f"% {PRIME}"
    else:
        # Products below 2^64: the upper and the lower half of the hash one after the other.
        upper = "((({0} | 1)::UBIGINT * (x >> 32)::UBIGINT) & 4294967295) * 2147483648"
        lower = "(({0} | 1)::UBIGINT * (x & 4294967295)::UBIGINT + {1}) >> 1"
        family, modulus = f"({upper} + ({lower})) & {(1 << 63) - 1}", ""
    minima = ", ".join(
        f"min({family.format(x, y)})::BIGINT AS h{i}" for i, (x, y) in enumerate(zip(a, b))
    )
    return f"""tokens AS (
  SELECT doc_id, {words_sql("norm")} AS w FROM (
    SELECT doc_id, {normal_sql("text")} AS norm FROM documents)),
grams AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - {n} + 2),
           lambda i: array_to_string(w[i:i + {n - 1}], ' ')))) AS gram
  FROM tokens WHERE len(w) >= {n}),
hashed AS (
  SELECT doc_id, ('0x' || substr(sha1(gram), 1, 15))::BIGINT {modulus} AS x FROM grams),
signatures AS (SELECT doc_id, {minima} FROM hashed GROUP BY doc_id)"""


def _edges_sql(precision: int = 32) -> str:
    r = CONFIG.hashes_per_bucket
    bands = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS bucket, concat_ws(',', "
        + ", ".join(f"h{i * r + j}" for j in range(r))
        + ") AS band FROM signatures"
        for i in range(CONFIG.num_buckets)
    )
    return f"""{_signature_sql(precision)},
bands AS ({bands}),
edges AS (
  SELECT DISTINCT src, doc_id AS dst FROM (
    SELECT doc_id, min(doc_id) OVER (PARTITION BY bucket, band) AS src FROM bands)
  WHERE src < doc_id)"""


def _clusters_sql(precision: int = 32) -> str:
    return f"""{_edges_sql(precision)},
both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach(node, seen) AS (
  SELECT a, b FROM both_ways UNION SELECT a, a FROM both_ways
  UNION
  SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
clusters AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"""


CLUSTERS_SQL = _clusters_sql()

TOKENS_SQL = f"len({words_sql('text')})::BIGINT"

SIGNATURE_ROWS = ", ".join(
    f"({i}, h{i})" for i in range(CONFIG.num_buckets * CONFIG.hashes_per_bucket)
)


@query(
    f"""WITH {_signature_sql()}
SELECT doc_id, i::INT AS i, h FROM signatures, LATERAL (VALUES {SIGNATURE_ROWS}) v(i, h)"""
)
def minhash_signatures(spark, sf_dir):
    signatures = mh.minhash_signatures(docs(spark, sf_dir), "doc_id", "text")
    return signatures.select("doc_id", F.posexplode("signature").alias("i", "h"))


@query(f"WITH {_edges_sql()} SELECT src, dst FROM edges")
def minhash_buckets(spark, sf_dir):
    signatures = mh.minhash_signatures(docs(spark, sf_dir), "doc_id", "text")
    return mh.minhash_buckets(signatures, "doc_id")


@query(f"WITH RECURSIVE {CLUSTERS_SQL} SELECT node, component FROM clusters")
def minhash_clusters(spark, sf_dir):
    return mh.minhash_clusters(docs(spark, sf_dir), "doc_id", "text")


@query(f"WITH RECURSIVE {CLUSTERS_SQL} SELECT node, component FROM clusters")
def minhash_clusters_salted(spark, sf_dir):
    """Every key counts as hot, so all joins spread their rows."""
    config = mh.MinhashConfig(hot_rows=1)
    return mh.minhash_clusters(docs(spark, sf_dir), "doc_id", "text", config)


@query(
    f"""WITH {_signature_sql(64)}
SELECT doc_id, i::INT AS i, h FROM signatures, LATERAL (VALUES {SIGNATURE_ROWS}) v(i, h)"""
)
def minhash_signatures_precise(spark, sf_dir):
    config = mh.MinhashConfig(precision=64)
    signatures = mh.minhash_signatures(docs(spark, sf_dir), "doc_id", "text", config)
    return signatures.select("doc_id", F.posexplode("signature").alias("i", "h"))


@query(
    f"""WITH RECURSIVE {CLUSTERS_SQL}
SELECT doc_id, text, {TOKENS_SQL} AS token_count,
       coalesce(node <> component, false) AS removed
FROM documents LEFT JOIN clusters ON node = doc_id"""
)
def minhash_dedup(spark, sf_dir):
    kept, removed = mh.minhash_dedup(docs(spark, sf_dir), "doc_id", "text")
    return kept.withColumn("removed", F.lit(False)).unionByName(
        removed.withColumn("removed", F.lit(True))
    )


@query(
    f"""WITH RECURSIVE {_clusters_sql(64)}
SELECT doc_id, text, lang, coalesce(node <> component, false) AS removed
FROM documents LEFT JOIN clusters ON node = doc_id"""
)
def run_minhash_job(spark, sf_dir):
    out = shared_path(spark, "minhash-job")
    jobs.run_minhash_job(
        spark,
        {
            "reader": {
                "type": "parquet",
                "kwargs": {
                    "data_folder": f"{sf_dir}/documents.parquet",
                    "id_key": "doc_id",
                    "columns": ["doc_id", "text", "lang"],
                },
            },
            "writer": {"type": "json", "kwargs": {"output_folder": f"{out}/kept"}},
            "exclusion_writer": {"type": "json", "kwargs": {"output_folder": f"{out}/removed"}},
            "hash_config": {"precision": 64, "hash_fc": "sha1"},
            "minhash_config": {"num_buckets": 14, "hashes_per_bucket": 8, "n_grams": 5},
            "use_column_info_adapter": True,
            "use_column_info_adapter_for_exclusion_writer": True,
        },
    )
    schema = "doc_id bigint, text string, lang string"
    kept = readers.read_json(spark, f"{out}/kept", schema)
    removed = readers.read_json(spark, f"{out}/removed", schema)
    return kept.withColumn("removed", F.lit(False)).unionByName(
        removed.withColumn("removed", F.lit(True))
    )


@query(f"SELECT doc_id, {TOKENS_SQL} AS token_count FROM documents")
def count_tokens(spark, sf_dir):
    return mh.count_tokens(docs(spark, sf_dir), "text").select("doc_id", "token_count")


def lines_sql(n: int = 1, source: str = "documents", key: str = "doc_id") -> str:
    """Every line of a table, and the normalised windows of ``n`` lines that are compared."""
    return f"""lines AS (
  SELECT {key} AS doc_id, pos - 1 AS pos, parts[pos] AS line FROM (
    SELECT {key}, parts, unnest(range(1, len(parts) + 1)) AS pos FROM (
      SELECT {key}, string_split(text, chr(10)) AS parts FROM {source}))),
ordered AS (
  SELECT doc_id, pos, line, string_agg({normal_sql("line")}, chr(10)) OVER w AS span,
         count(*) OVER w AS width
  FROM lines
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)),
spans AS (
  SELECT doc_id, pos, span FROM ordered
  WHERE width = {n} AND trim(replace(span, chr(10), '')) <> ''),
dups AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY span ORDER BY doc_id, pos) AS rn
    FROM spans) WHERE rn > 1)"""


def dedup_sql(n: int = 1, extra_drop: str = "false", columns="doc_id, text, token_count") -> str:
    return f"""{lines_sql(n)},
covered AS (SELECT DISTINCT doc_id, pos + unnest(range(0, {n})) AS pos FROM dups),
rest AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (c.pos IS NULL) AS text,
         count(*) FILTER (c.pos IS NULL) AS n_lines, count(c.pos) > 0 AS changed
  FROM lines l LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.pos = l.pos
  GROUP BY l.doc_id),
words AS (SELECT doc_id, {TOKENS_SQL} AS token_count FROM documents)
SELECT {columns} FROM rest JOIN words USING (doc_id)
WHERE trim(coalesce(text, '')) <> '' AND NOT ({extra_drop})"""


@query(
    f"""WITH {lines_sql()}
SELECT doc_id, count(*) AS n_windows, count(DISTINCT span) AS n_distinct FROM spans GROUP BY doc_id"""
)
def sentence_signatures(spark, sf_dir):
    signatures = st.sentence_signatures(docs(spark, sf_dir), "doc_id", "text")
    return signatures.groupBy("doc_id").agg(
        F.count("*").alias("n_windows"), F.count_distinct("h1", "h2").alias("n_distinct")
    )


@query(f"WITH {lines_sql()} SELECT doc_id, pos::INT AS pos FROM dups")
def find_duplicate_sentences(spark, sf_dir):
    signatures = st.sentence_signatures(docs(spark, sf_dir), "doc_id", "text")
    return st.find_duplicate_sentences(signatures, "doc_id")


@query(f"WITH {lines_sql()} SELECT doc_id, pos::INT AS pos FROM dups")
def find_duplicate_sentences_salted(spark, sf_dir):
    """Every line counts as hot, so its occurrences are spread."""
    config = st.SentenceConfig(hot_rows=1)
    signatures = st.sentence_signatures(docs(spark, sf_dir), "doc_id", "text", config)
    return st.find_duplicate_sentences(signatures, "doc_id", config=config)


@query(
    f"""WITH {lines_sql()}, listed AS (
  SELECT DISTINCT {normal_sql("line")} AS span
  FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark))
SELECT doc_id, pos::INT AS pos FROM spans JOIN listed USING (span)"""
)
def find_sentences_in_index(spark, sf_dir):
    signatures = st.sentence_signatures(docs(spark, sf_dir), "doc_id", "text")
    index = st.sentence_signatures(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return st.find_duplicate_sentences(signatures, "doc_id", index)


@query(
    f"""WITH {lines_sql()}, listed AS (
  SELECT DISTINCT {normal_sql("line")} AS span
  FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark))
SELECT doc_id, pos::INT AS pos FROM spans JOIN listed USING (span)
UNION SELECT doc_id, pos::INT FROM dups"""
)
def find_sentences_in_corpus_and_index(spark, sf_dir):
    config = st.SentenceConfig(only_dedup_in_index=False)
    signatures = st.sentence_signatures(docs(spark, sf_dir), "doc_id", "text", config)
    index = st.sentence_signatures(table(spark, sf_dir, "benchmark"), "item_id", "text", config)
    return st.find_duplicate_sentences(signatures, "doc_id", index, config)


@query(f"WITH {dedup_sql()}")
def sentence_dedup(spark, sf_dir):
    return st.sentence_dedup(docs(spark, sf_dir), "doc_id", "text")


SHORT_SQL = f"changed AND (len({words_sql('text')}) < 20 OR n_lines < 3)"


@query(f"WITH {dedup_sql(2, SHORT_SQL)}")
def sentence_dedup_windows(spark, sf_dir):
    config = st.SentenceConfig(n_sentences=2, min_doc_words=20, min_num_sentences=3)
    return st.sentence_dedup(docs(spark, sf_dir), "doc_id", "text", config=config)


@query(f"WITH {dedup_sql(columns='doc_id, text')}")
def run_sentence_job(spark, sf_dir):
    out = shared_path(spark, "sentence-job")
    jobs.run_sentence_job(
        spark,
        {
            "reader": {
                "type": "parquet",
                "kwargs": {
                    "data_folder": f"{sf_dir}/documents.parquet",
                    "id_key": "doc_id",
                    "columns": ["doc_id", "text"],
                },
            },
            "writer": {"type": "parquet", "kwargs": {"output_folder": out}},
            "dedup_config": {
                "n_sentences": 1,
                "split_sentences": False,
                "only_dedup_in_index": True,
                "min_doc_words": 0,
                "min_num_sentences": -1,
            },
            "use_column_info_adapter": True,
        },
    )
    return spark.read.parquet(out)


#: Texts without their blanks, to be cut into words again.
LETTERS = r"\p{L}\p{N}"
UNSPACED_SQL = f"regexp_replace(text, '[{BLANK_SQL}]+', '', 'g')"


def unspaced(spark, sf_dir):
    text = F.regexp_replace("text", F.lit(BLANKS), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query(
    f"""WITH runs AS (SELECT unnest(regexp_extract_all({UNSPACED_SQL}, '[{LETTERS}]+')) AS run FROM documents),
grams AS (
  SELECT substring(run, i, n) AS word FROM (
    SELECT run, n, unnest(range(1, length(run) - n + 2)) AS i FROM runs, (SELECT unnest(range(1, 5)) AS n)))
SELECT word, count(*) AS n FROM grams GROUP BY word HAVING count(*) >= 5"""
)
def word_candidates(spark, sf_dir):
    return sg.word_candidates(unspaced(spark, sf_dir), "text", letters=LETTERS)


@query()
def segment_words(spark, sf_dir):
    """The texts of all documents without their blanks, cut into words learned from them."""
    docs = unspaced(spark, sf_dir)
    model = sg.fit_words(docs, "text", max_chars=5, letters=LETTERS)
    return docs.select("doc_id", sg.segmenter(spark, model)("text").alias("text"))


@query()
def run_minhash_job_unspaced(spark, sf_dir):
    """The job in a language without blanks, over all documents, whose words it finds itself."""
    out = shared_path(spark, "unspaced-job")
    unspaced(spark, sf_dir).write.parquet(f"{out}/in")
    jobs.run_minhash_job(
        spark,
        {
            "reader": {"type": "parquet", "kwargs": {"data_folder": f"{out}/in", "id_key": "doc_id"}},
            "writer": {"type": "parquet", "kwargs": {"output_folder": f"{out}/kept"}},
            "language": "zho",
            "use_column_info_adapter": True,
        },
    )
    return spark.read.parquet(f"{out}/kept").select("doc_id", "text")
