import gzip
import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusweave.plans.jobs import load_config
from corpusweave.plans.staging import shared_path, shared_root
from corpusweave.sources import arrow_ipc, readers, writers
from corpusweave.sources.columns import TextColumns, to_documents
from corpusweave.sources.lines import export_text_lines, text_lines, with_file_number
from corpusweave.sources.registry import create_io_object, create_reader_and_writer
from corpusweave.sources.warc import archive_ranges


def test_csv_keeps_blanks_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "pairs.csv").write_text(
        'text_1,text_2\n"He said ""so"".", two  blanks \n"a\nb",c\n', encoding="utf-8"
    )
    rows = readers.read_csv(spark, str(tmp_path / "pairs.csv")).collect()
    assert [tuple(r) for r in rows] == [('He said "so".', " two  blanks "), ("a\nb", "c")]


def test_json_round_trip_is_gzipped_and_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None), (3, "")], "id bigint, text string")
    writers.write_json(df, str(tmp_path / "out"))
    names = [n for n in os.listdir(tmp_path / "out") if n.startswith("part")]
    assert names and all(n.endswith(".json.gz") for n in names)
    back = readers.read_json(spark, str(tmp_path / "out"), "id bigint, text string")
    assert sorted(map(tuple, back.collect())) == [(1, "é"), (2, None), (3, "")]


def test_ipc_files_are_split_by_batches(spark, tmp_path, monkeypatch):
    for name, start in (("a.arrow", 0), ("b.arrow", 100)):
        batch = pa.RecordBatch.from_pydict({"id": list(range(start, start + 10)), "t": ["x"] * 10})
        with pa.ipc.new_file(str(tmp_path / name), batch.schema) as sink:
            for i in range(5):
                sink.write_batch(batch.slice(2 * i, 2))
    (tmp_path / "_SUCCESS").write_text("")
    df = readers.read_ipc(spark, str(tmp_path))
    assert sorted(r["id"] for r in df.collect()) == [*range(10), *range(100, 110)]
    monkeypatch.setattr(arrow_ipc, "SPLIT_BYTES", 300)
    reader = arrow_ipc.ArrowIpcReader(str(tmp_path))
    parts = reader.partitions()
    assert len(parts) > 2
    ids = [i for p in parts for b in reader.read(p) for i in b.column(0).to_pylist()]
    assert sorted(ids) == [*range(10), *range(100, 110)]


def test_csv_is_split_unless_fields_hold_line_breaks(spark, tmp_path):
    for name, text in (("plain", 'x"" ""y, z'), ("broken", "two\nlines")):
        (tmp_path / f"{name}.csv").write_text("a,b\n" + f'1,"{text}"\n' * 3)
        df = readers.read_csv(spark, str(tmp_path / f"{name}.csv"))
        assert [r["b"] for r in df.collect()] == [text.replace('""', '"')] * 3
        options = df._jdf.queryExecution().optimizedPlan().toString()
        assert df.count() == 3 and "CSV" in df._jdf.queryExecution().executedPlan().toString(), options


def warc_record(kind, url, body: bytes) -> bytes:
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{url}>\r\nWARC-Target-URI: {url}\r\n"
    return head.encode() + f"Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("zipped", [False, True])
def test_warc(spark, tmp_path, zipped):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=%s\r\n\r\n"
    records = [
        warc_record("warcinfo", "info", b"software: x\r\n"),
        warc_record("response", "http://a", http % b"utf-8" + "é\r\n\r\nsecond".encode()),
        warc_record("request", "http://a", b"GET / HTTP/1.1\r\n\r\n"),
        warc_record("response", "http://b", http % b"ISO-8859-1" + "ü".encode("latin-1")),
        warc_record("conversion", "http://c", "plain\n\ntext".encode()),
        warc_record("response", "http://d", http % b"utf-8"),
    ]
    if zipped:
        (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    else:
        (tmp_path / "x.warc").write_bytes(b"".join(records))
    rows = readers.read_warc(spark, str(tmp_path)).collect()
    assert {(r["url"], r["text"]) for r in rows} == {
        ("http://a", "é\r\n\r\nsecond"),
        ("http://b", "ü"),
        ("http://c", "plain\n\ntext"),
        ("http://d", ""),
    }
    assert not any(r["truncated"] for r in rows)


@pytest.mark.parametrize("kind", ["plain", "members", "one member", "padded"])
@pytest.mark.parametrize("split_bytes", [1, 900, 1 << 30])
def test_warc_records_end_where_they_say(spark, tmp_path, kind, split_bytes):
    inner = warc_record("response", "http://inner", b"HTTP/1.1 200 OK\r\n\r\ninner")
    pages = {f"http://{i}": f"page {i}\r\n\r\nWARC/1.0\r\n".encode() + inner * (i % 3) + b"x" * (37 * i % 301) for i in range(40)}
    pages["http://gz"] = gzip.compress(inner) * 2
    pages["http://empty"] = b""
    records = [warc_record("conversion", url, body) for url, body in pages.items()]
    records.insert(3, warc_record("request", "http://0", inner))
    whole = {
        "plain": b"".join(records),
        "members": b"".join(gzip.compress(r, 0) for r in records),
        "one member": gzip.compress(b"".join(records)),
        "padded": b"".join(gzip.compress(r) for r in records) + b"\0" * 100,
    }[kind]
    (tmp_path / "a b%20.warc").write_bytes(whole)
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = readers.read_warc(spark, str(tmp_path), split_bytes=split_bytes)
    found = {r["url"]: r for r in rows.collect()}
    assert len(found) == rows.count() == len(pages)
    assert all(found[u]["text"] == body.decode("utf-8", "replace") for u, body in pages.items())
    assert not any(r["truncated"] for r in found.values())
    ranges = archive_ranges(spark, str(tmp_path), split_bytes)
    assert (len(ranges) > 20) == (split_bytes == 1 and kind != "one member")


def test_warc_that_ends_early(spark, tmp_path):
    records = [warc_record("conversion", f"http://{i}", b"text " * 50) for i in range(3)]
    (tmp_path / "x.warc").write_bytes(b"".join(records)[:-60])
    packed = b"".join(gzip.compress(r, 0) for r in records)
    (tmp_path / "y.warc.gz").write_bytes(packed[:-60])
    rows = readers.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r["url"], r["truncated"]) for r in rows) == sorted(
        [(f"http://{i}", i == 2) for i in range(3)] * 2
    )


def test_warc_lines_between_records(spark, tmp_path):
    lone = b"WARC/1.0\r\nWARC-Type: conversion\r\nWARC-Target-URI: http://no-length\r\n\r\nlost\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(b"junk\r\n" + lone + b"\r\n\r\n" + warc_record("conversion", "http://a", b"kept"))
    rows = readers.read_warc(spark, str(tmp_path)).collect()
    assert {(r["url"], r["text"]) for r in rows} == {("http://no-length", ""), ("http://a", "kept")}


def test_warc_versions_and_charsets(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html%s\r\n\r\n"
    meta = '<html><head><meta charset="koi8-r"></head>мир</html>'
    pages = {
        "a": http % b"; charset=windows-1251" + "привет, ёлка".encode("cp1251"),
        "b": http % b'; charset="Shift_JIS"' + "日本語".encode("shift_jis"),
        "c": http % b"" + meta.encode("koi8-r"),
        "d": http % b"; charset=no-such-name" + "naïve".encode(),
        "e": http % b"; charset=utf-8" + b"bad \xff byte",
        "f": http % b"; charset=utf-8" + "kept \ufffd sign".encode(),
        "g": http % b"" + "日本語".encode(),
    }
    records = [warc_record("response", url, body).replace(b"WARC/1.0", b"WARC/1.1") for url, body in pages.items()]
    records.append(warc_record("response", "h", http % b"" + b"other version"))
    (tmp_path / "x.warc").write_bytes(b"".join(records))
    rows = {r["url"]: r for r in readers.read_warc(spark, str(tmp_path)).collect()}
    assert {u: r["text"] for u, r in rows.items()} == {
        "a": "привет, ёлка", "b": "日本語", "c": meta, "d": "naïve", "e": "bad \ufffd byte",
        "f": "kept \ufffd sign", "g": "日本語", "h": "other version",
    }
    assert [u for u in "abcdefgh" if rows[u]["lossy"]] == ["e"]
    assert not any(r["truncated"] for r in rows.values())
    assert [rows[u]["charset"] for u in "abcg"] == ["windows-1251", "shift_jis", "koi8-r", None]


def test_snapshot_splits_and_columns(spark, tmp_path):
    root = str(tmp_path / "data")
    df = spark.range(10).select("id", F.lit("x").alias("text"))
    writers.write_snapshot(df, root, "train")
    writers.write_snapshot(df.limit(3), root, "test")
    splits = readers.load_splits(spark, root, test_size=0.5, key="id", columns=["id"])
    assert {k: v.count() for k, v in splits.items()} == {"train": 10, "test": 3}
    assert splits["train"].columns == ["id"]


def test_load_splits_divides_train_without_test(spark, tmp_path):
    path = str(tmp_path / "rows.jsonl")
    spark.range(10).write.json(path)
    splits = readers.load_splits(spark, path, test_size=0.25, key="id", schema="id bigint")
    assert splits["train"].count() == 7 and splits["test"].count() == 3
    with pytest.raises(ValueError):
        readers.load_splits(spark, path, test_size=0.25, schema="id bigint")


def test_registry_names_the_choices(spark):
    with pytest.raises(ValueError, match="parquet"):
        create_io_object(spark, {"type": "xml"}, "reader")
    with pytest.raises(ValueError, match="writer"):
        create_io_object(spark, {"type": "json"}, "filter")


def test_registry_restores_columns(spark, tmp_path):
    spark.createDataFrame([(7, "Привет", "x")], "n int, ru string, chv string").write.json(
        str(tmp_path / "in")
    )
    source, sink = create_reader_and_writer(
        spark,
        {
            "reader": {"type": "json", "kwargs": {"path": str(tmp_path / "in"), "text_key": "ru"}},
            "writer": {"type": "json", "kwargs": {"output_folder": str(tmp_path / "out")}},
            "use_column_info_adapter": True,
        },
    )
    df, columns = source.load()
    assert {"text", "id"} <= set(df.columns)
    sink.save(df.withColumn("language", F.lit("rus")), columns)
    row = spark.read.json(str(tmp_path / "out")).first().asDict()
    assert row == {"n": 7, "ru": "Привет", "chv": "x"}


def test_columns_added_are_kept_on_request(spark):
    df = spark.createDataFrame([("a", 1)], "ru string, n int")
    columns = TextColumns.of(df, "ru", "n")
    worked = columns.assign(df).withColumn("language", F.lit("x"))
    assert columns.restore(worked).columns == ["ru", "n"]
    assert columns.restore(worked, keep_added=True).columns == ["ru", "n", "language"]
    with pytest.raises(ValueError):
        TextColumns.of(spark.createDataFrame([("a", "b")], "ru string, text string"), "ru")


def test_documents_merge_metadata(spark):
    df = spark.createDataFrame(
        [("1", "t", '{"k": "m", "n": "hidden"}', 5), ("2", "u", "no json", 6), ("3", "v", None, 7)],
        "id string, text string, metadata string, n int",
    )
    rows = {r["id"]: r["metadata"] for r in to_documents(df).collect()}
    assert rows == {
        "1": {"k": "m", "n": "5"},
        "2": {"metadata": "no json", "n": "6"},
        "3": {"n": "7"},
    }


def test_lines_are_rolled_by_size(spark, tmp_path):
    values = ["a" * 10, "b" * 10, "é" * 50, "c", None, "d"]
    df = spark.createDataFrame([(v,) for v in values], "text string").coalesce(1)
    lines = text_lines({"one": lambda: {"train": df}})
    placed = with_file_number(lines, 30).orderBy("line_no").collect()
    assert [r["file_no"] for r in placed] == [0, 0, 1, 2, 2]
    export_text_lines(lines, str(tmp_path / "out"), 30)
    back = spark.read.text(str(tmp_path / "out"))
    assert sorted(r["value"] for r in back.collect()) == sorted(v for v in values if v)


def test_line_order_is_column_then_row(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "n int, t string").coalesce(1)
    lines = text_lines({"one": lambda: {"train": df}}).collect()
    assert [r["line"] for r in lines] == ["1", "2", "x", "y"]
    with pytest.raises(ValueError):
        text_lines({"bad": lambda: spark.read.parquet("/nowhere")})


def test_empty_job_configuration(tmp_path):
    (tmp_path / "job.yaml").write_text("")
    with pytest.raises(ValueError):
        load_config(str(tmp_path / "job.yaml"))
    (tmp_path / "job.yaml").write_text("reader:\n  type: json\n")
    assert load_config(str(tmp_path / "job.yaml")) == {"reader": {"type": "json"}}


def test_shared_folder_is_the_configured_one(spark):
    assert shared_path(spark, "x").startswith(shared_root(spark))
    assert shared_path(spark, "x") != shared_path(spark, "x")


def lines_of(path):
    return [json.loads(x) for x in gzip.open(path, "rt", encoding="utf-8")]


def test_named_files_through_the_registry(spark, tmp_path):
    rows = [(i, f"été {i}" if i % 3 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(4)
    out = str(tmp_path / "results")
    kwargs = {"output_folder": out, "output_filename": "result_${rank}", "compression": "gzip"}
    sink = create_io_object(spark, {"type": "json", "kwargs": kwargs}, "writer")
    sink.save(df)
    assert sorted(os.listdir(out)) == [f"result_{i:05d}.gz" for i in range(4)]
    found = [r for f in os.listdir(out) for r in lines_of(f"{out}/{f}")]
    assert sorted((r["id"], r["text"]) for r in found) == rows
    with pytest.raises(FileExistsError):
        sink.save(df)
    writers.write_json(df.limit(3), out, "overwrite", "only", compression=None)
    assert os.listdir(out) == ["only"] and len(open(f"{out}/only").readlines()) == 3
    writers.write_json(df, out, "ignore", "x_${rank}")
    writers.write_json(df.limit(1), out, "append", "more/${rank}.jsonl")
    assert sorted(os.listdir(out)) == ["more", "only"] and os.listdir(f"{out}/more") == ["00000.jsonl.gz"]


def test_files_named_by_columns(spark, tmp_path):
    rows = [(i, "abc"[i % 3] if i % 7 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, lang string").repartition(3)
    writers.write_json(df, str(tmp_path / "a"), output_filename="${lang}/part-${rank}.jsonl")
    writers.write_json(df, str(tmp_path / "b"), output_filename="$lang.jsonl")
    for lang in ("a", "b", "c"):
        want = [i for i, x in rows if x == lang]
        parts = sorted((tmp_path / "a" / lang).iterdir())
        assert sorted(r["id"] for p in parts for r in lines_of(p)) == want
        assert sorted(r["id"] for r in lines_of(tmp_path / "b" / f"{lang}.jsonl.gz")) == want
    with pytest.raises(ValueError):
        writers.write_json(df, str(tmp_path / "c"), output_filename="${nothing}_${rank}")


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    @F.udf("int")
    def fails(i):
        if i == 77:
            raise RuntimeError("no")
        return i

    out = tmp_path / "out"
    df = spark.range(100).repartition(4).select(fails(F.col("id").cast("int")).alias("id"))
    with pytest.raises(Exception):
        writers.write_json(df, str(out), output_filename="result_${rank}")
    assert not out.exists() or os.listdir(out) == []
    writers.write_json(spark.range(0), str(out / "none"), output_filename="result_${rank}")
    assert os.listdir(out / "none") == []
