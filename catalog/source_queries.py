"""Readers and writers: whole tables are written in each format and read back."""

from __future__ import annotations

import gzip

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from catalog import query, table
from catalog.shared import turn_pairs
from corpusweave.operators.filters import length_ratio, with_verdict
from corpusweave.plans.staging import shared_path
from corpusweave.sources import readers, writers
from corpusweave.sources.arrow_ipc import file_system
from corpusweave.sources.columns import TextColumns, to_documents
from corpusweave.sources.lines import export_text_lines as export_lines
from corpusweave.sources.lines import text_lines
from corpusweave.sources.registry import create_io_object, create_reader_and_writer

TURNS_SQL = "SELECT conv_id, turn, role, text FROM conversations"
TURNS_SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


@query(
    """SELECT conv_id, turn, role, '  ' || chr(34) || text || chr(34) || ' ' AS text
FROM conversations"""
)
def read_csv(spark, sf_dir):
    """Quotes, line breaks and outer blanks survive."""
    path = shared_path(spark, "csv")
    quoted = turns(spark, sf_dir).withColumn(
        "text", F.concat(F.lit('  "'), "text", F.lit('" '))
    )
    quoted.write.options(
        header=True,
        quote='"',
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)
    return readers.read_csv(spark, path, TURNS_SCHEMA)


@query(TURNS_SQL)
def read_json(spark, sf_dir):
    path = shared_path(spark, "json")
    turns(spark, sf_dir).write.json(path)
    return readers.read_json(spark, path, TURNS_SCHEMA)


@query("SELECT doc_id, lang, text FROM documents")
def read_parquet_whole(spark, sf_dir):
    return readers.read_parquet(spark, f"{sf_dir}/documents.parquet", ["doc_id", "lang", "text"])


@query("SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > 1000")
def read_parquet(spark, sf_dir):
    docs = readers.read_parquet(
        spark, f"{sf_dir}/documents.parquet", ["doc_id", "lang", "n_chars"]
    )
    return docs.where(F.col("n_chars") > 1000)


def write_ipc(df, folder: str) -> None:
    """One Arrow file per partition, named after it, so that a retried task overwrites its own."""

    def write(batches):
        from pyspark import TaskContext

        fs, root = file_system(folder)
        fs.create_dir(root)
        path = f"{root}/part-{TaskContext.get().partitionId():05d}.arrow"
        sink = None
        for batch in batches:
            if sink is None:
                out = fs.open_output_stream(path)
                sink = pa.ipc.new_file(out, batch.schema)
            sink.write_batch(batch)
        if sink is not None:
            sink.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path]})

    df.mapInArrow(write, "path string").count()


@query("SELECT page_id, url, html FROM pages")
def read_ipc(spark, sf_dir):
    path = shared_path(spark, "ipc")
    write_ipc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return readers.read_ipc(spark, path)


@query("SELECT '<urn:page:' || page_id || '>' AS id, url, html AS text FROM pages")
def read_warc(spark, sf_dir):
    """Pages are written as gzipped response records, with request records in between."""
    path = shared_path(spark, "warc")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), "html")
    body = F.explode(
        F.array(
            F.struct(F.lit("request").alias("type"), F.lit("GET / HTTP/1.1\r\n").alias("body")),
            F.struct(F.lit("response").alias("type"), http.alias("body")),
        )
    )
    records = table(spark, sf_dir, "pages").select("page_id", "url", body.alias("r"))
    record = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "),
        "r.type",
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.col("page_id").cast("string"),
        F.lit(">\r\nWARC-Target-URI: "),
        "url",
        F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: "),
        F.octet_length("r.body").cast("string"),
        F.lit("\r\n\r\n"),
        "r.body",
    )
    records.select(record.alias("value")).write.options(
        lineSep="\r\n\r\n", compression="gzip"
    ).text(path)
    return readers.read_warc(spark, path).select("id", "url", "text")


# The Latin-1 letters, and the Cyrillic letters that stand in for them in one of the encodings.
ACCENTED_LETTERS = "".join(map(chr, range(0xC0, 0x100)))
CYRILLIC_LETTERS = "".join(map(chr, range(0x410, 0x450)))


@query(
    f"""SELECT '<urn:page:' || page_id || '>' AS id, url,
  CASE WHEN page_id % 3 = 2 THEN translate(html, '{ACCENTED_LETTERS}', '{CYRILLIC_LETTERS}') ELSE html END AS text,
  ['utf-8', 'iso-8859-1', 'windows-1251'][page_id % 3 + 1] AS charset, false AS truncated
FROM pages"""
)
def read_warc_charsets(spark, sf_dir):
    """An archive of version 1.1 whose pages are in three encodings; records are bytes."""
    path = shared_path(spark, "warc")
    names = F.array(*[F.lit(n) for n in ("utf-8", "iso-8859-1", "windows-1251")])
    pages = table(spark, sf_dir, "pages").withColumn("charset", F.get(names, F.col("page_id") % 3))
    cyrillic = F.translate("html", ACCENTED_LETTERS, CYRILLIC_LETTERS)
    pages = pages.withColumn("html", F.when(F.col("page_id") % 3 == 2, cyrillic).otherwise(F.col("html")))

    @F.pandas_udf("binary")
    def record(ids: pd.Series, urls: pd.Series, html: pd.Series, names: pd.Series) -> pd.Series:
        out = []
        for i, url, page, name in zip(ids, urls, html, names):
            # The page's own declaration is not what the server says.
            body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={name}\r\n\r\n".encode()
            body += page.encode(name)
            head = (
                f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\n"
                f"WARC-Target-URI: {url}\r\nContent-Length: {len(body)}\r\n\r\n"
            )
            out.append(head.encode() + body)
        return pd.Series(out)

    written = pages.select(record("page_id", "url", "html", "charset").cast("string").alias("value"))
    written.write.options(lineSep="\r\n\r\n").text(path)
    return readers.read_warc(spark, path).select("id", "url", "text", "charset", "truncated")


#: A page that holds what looks like the end of a record and the head of another.
INNER = "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: inner\r\nContent-Length: 2\r\n\r\nxx"


@query(
    f"""SELECT kind, page_id::VARCHAR AS id, url, html || {"||".join(f"chr({ord(c)})" if ord(c) < 32 else f"'{c}'" for c in INNER)} AS text
FROM pages, (SELECT unnest(['1.0 plain', '1.1 plain', '1.0 gzip', '1.1 gzip']) AS kind)"""
)
def read_warc_by_length(spark, sf_dir):
    """Record boundaries inside pages; plain archives, and gzip members read in ranges."""
    pages = table(spark, sf_dir, "pages").withColumn("html", F.concat("html", F.lit(INNER)))

    def records(version: str, zipped: bool):
        @F.pandas_udf("binary")
        def record(ids: pd.Series, urls: pd.Series, html: pd.Series) -> pd.Series:
            out = []
            for i, url, page in zip(ids, urls, html):
                body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + page.encode()
                head = (
                    f"WARC/{version}\r\nWARC-Type: response\r\nWARC-Record-ID: {i}\r\n"
                    f"WARC-Target-URI: {url}\r\nContent-Length: {len(body)}\r\n\r\n"
                )
                whole = head.encode() + body + b"\r\n\r\n"
                out.append(gzip.compress(whole) if zipped else whole)
            return pd.Series(out)

        return record("page_id", "url", "html").cast("string").alias("value")

    found = None
    for version in ("1.0", "1.1"):
        for zipped in (False, True):
            path = shared_path(spark, "warc")
            # Zeros between gzip members are padding; a line end between records is blank.
            pages.select(records(version, zipped)).write.option("lineSep", "\0" if zipped else "\n").text(path)
            kind = F.lit(f"{version} {'gzip' if zipped else 'plain'}").alias("kind")
            part = readers.read_warc(spark, path, split_bytes=1 << 20).select(kind, "id", "url", "text")
            found = part if found is None else found.unionByName(part)
    return found


@query("SELECT doc_id, lang FROM documents")
def read_dataset_snapshot(spark, sf_dir):
    root = shared_path(spark, "snapshot")
    docs = table(spark, sf_dir, "documents")
    writers.write_snapshot(docs, root, "train")
    return readers.read_snapshot(spark, root, "train", ["doc_id", "lang"])


@query(
    """SELECT 'json' AS kind, conv_id, turn FROM conversations
UNION ALL SELECT 'csv', conv_id, turn FROM conversations
UNION ALL SELECT 'parquet', conv_id, turn FROM conversations
UNION ALL SELECT 'snapshot', conv_id, turn FROM conversations"""
)
def read_by_suffix(spark, sf_dir):
    base = shared_path(spark, "suffix")
    df = turns(spark, sf_dir)
    df.write.json(f"{base}/turns.jsonl")
    df.write.options(header=True, quote='"', escape='"').csv(f"{base}/turns.csv")
    writers.write_snapshot(df, f"{base}/turns", "train")
    places = {
        "json": f"{base}/turns.jsonl",
        "csv": f"{base}/turns.csv",
        "parquet": f"{sf_dir}/conversations.parquet",
        "snapshot": f"{base}/turns",
    }
    found = None
    for kind, place in places.items():
        schema = TURNS_SCHEMA if kind in ("json", "csv") else None
        train = readers.load_splits(spark, place, schema=schema)["train"]
        part = train.select(F.lit(kind).alias("kind"), "conv_id", "turn")
        found = part if found is None else found.unionByName(part)
    return found


@query(TURNS_SQL)
def write_json(spark, sf_dir):
    path = shared_path(spark, "written")
    writers.write_json(turns(spark, sf_dir), path)
    return spark.read.schema(TURNS_SCHEMA).json(f"{path}/*.json.gz")


@query("SELECT conv_id, turn, role, text, true AS named FROM conversations")
def write_json_with_names(spark, sf_dir):
    """Files with names of their own, through a job's writer configuration."""
    path = shared_path(spark, "written")
    kwargs = {"output_folder": path, "output_filename": "result_${rank}"}
    create_io_object(spark, {"type": "json", "kwargs": kwargs}, "writer").save(turns(spark, sf_dir))
    named = F.input_file_name().rlike(r"/result_\d{5}\.gz$").alias("named")
    return spark.read.schema(TURNS_SCHEMA).json(path).select("*", named)


@query("SELECT doc_id, lang, text FROM documents")
def write_parquet(spark, sf_dir):
    path = shared_path(spark, "written")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    writers.write_parquet(docs, path, partition_by=["lang"])
    return spark.read.parquet(path).select("doc_id", "lang", "text")


@query(TURNS_SQL)
def write_dataset_snapshot(spark, sf_dir):
    root = shared_path(spark, "snapshot")
    writers.write_snapshot(turns(spark, sf_dir), root, "validation")
    return readers.load_splits(spark, root)["validation"]


@query(TURNS_SQL)
def io_registry(spark, sf_dir):
    path = shared_path(spark, "registry")
    source, sink = create_reader_and_writer(
        spark,
        {
            "reader": {
                "type": "parquet",
                "kwargs": {"data_folder": f"{sf_dir}/conversations.parquet", "id_key": "conv_id"},
            },
            "writer": {"type": "json", "kwargs": {"output_folder": path}},
            "use_column_info_adapter": True,
        },
    )
    sink.save(*source.load())
    return readers.read_json(spark, path, TURNS_SCHEMA)


@query(
    """SELECT event_id AS id, event_type AS text, json_extract_string(props, '$.k') AS k,
       user_id::VARCHAR AS user_id
FROM events"""
)
def assign_text_column(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("props", "metadata")
    named = TextColumns.of(events, "event_type", "event_id").assign(events)
    docs = to_documents(named)
    return docs.select(
        "id", "text", *[F.col("metadata")[k].alias(k) for k in ("k", "user_id")]
    )


@query("SELECT doc_id, upper(replace(text, 'ß', 'SS')) AS text, lang, source, n_chars FROM documents")
def restore_columns(spark, sf_dir):
    """A column added in between is left out again, the original order comes back."""
    docs = table(spark, sf_dir, "documents")
    columns = TextColumns.of(docs, "text", "doc_id")
    worked = columns.assign(docs).withColumns(
        {"text": F.upper("text"), "language": F.lit("unknown")}
    )
    return columns.restore(worked)


@query(
    """WITH pairs AS (
  SELECT a.conv_id, a.turn, a.text AS text_1, b.text AS text_2
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, CASE WHEN greatest(length(text_1), length(text_2))::DOUBLE
         / least(length(text_1), length(text_2)) <= 1.8 THEN 'kept' ELSE 'dropped' END AS sink
FROM pairs"""
)
def exclusion_sink(spark, sf_dir):
    kept, dropped = shared_path(spark, "kept"), shared_path(spark, "dropped")
    judged = with_verdict(turn_pairs(spark, sf_dir), length_ratio(["text_1", "text_2"], 1.8))
    writers.write_with_exclusions(
        judged,
        lambda df: writers.write_parquet(df, kept),
        lambda df: writers.write_parquet(df, dropped),
    )
    return (
        spark.read.parquet(kept)
        .select("conv_id", "turn", F.lit("kept").alias("sink"))
        .unionByName(
            spark.read.parquet(dropped).select("conv_id", "turn", F.lit("dropped").alias("sink"))
        )
    )


def customer_lines(spark, sf_dir):
    """Two datasets of which one does not exist."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return text_lines(
        {
            "customer": lambda: {"train": customers},
            "missing": lambda: {"train": spark.read.parquet(f"{sf_dir}/missing.parquet")},
        }
    )


CUSTOMER_LINES_SQL = """lines AS (
  SELECT c_custkey::VARCHAR AS line FROM customer
  UNION ALL SELECT c_name FROM customer
  UNION ALL SELECT c_mktsegment FROM customer)"""


@query(f"WITH {CUSTOMER_LINES_SQL} SELECT line FROM lines WHERE line IS NOT NULL")
def export_text_lines(spark, sf_dir):
    path = shared_path(spark, "lines")
    export_lines(customer_lines(spark, sf_dir), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(
    f"""WITH {CUSTOMER_LINES_SQL}
SELECT count(*) AS n_lines, sum(strlen(line) + 1)::BIGINT AS n_bytes, 0::BIGINT AS n_oversize
FROM lines WHERE line IS NOT NULL"""
)
def export_rolled_files(spark, sf_dir):
    """Files rolled at 4 000 bytes: none is larger and none of the lines is lost."""
    path = shared_path(spark, "rolled")
    export_lines(customer_lines(spark, sf_dir), path, max_bytes=4000)
    files = (
        spark.read.text(path)
        .groupBy("part", "file_no")
        .agg(F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("size"))
    )
    return files.agg(
        F.sum("n").alias("n_lines"),
        F.sum("size").alias("n_bytes"),
        F.count_if((F.col("size") > 4000) & (F.col("n") > 1)).alias("n_oversize"),
    )
