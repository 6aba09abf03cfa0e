import hashlib
import re

import pytest

from corpusweave.llm.line_dedup import dedup_lines, drop_repeated_lines
from corpusweave.llm.queries import QUERIES


def normal(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def plain(texts, min_docs=10, min_chars=1):
    """``kept, n_lines, n_dropped`` per text, line by line."""
    all_lines = [(t or "").split("\n") for t in texts]
    holders = {}
    for i, lines in enumerate(all_lines):
        for line in lines:
            if len(normal(line)) >= min_chars:
                holders.setdefault(normal(line), set()).add(i)
    gone = {k for k, v in holders.items() if len(v) >= min_docs}
    kept = [[x for x in lines if normal(x) not in gone] for lines in all_lines]
    return [("\n".join(k), len(lines), len(lines) - len(k)) for k, lines in zip(kept, all_lines)]


def check(spark, texts, hot_rows=20_000, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(dedup_lines(docs, hot_rows=hot_rows, **options).collect(), key=lambda r: r.row.doc_id)
    assert [(r.kept, r.n_lines, r.n_dropped) for r in got] == plain(texts, **options)


TEXTS = [
    None, "", "\n", "A\nb\nA", " a \nB\t\nc", "a", "\x0ba\x0c\nÀ", "à\nÀ\nb", "x\n\n\nb\n", "\xa0a\nb",
    "b\r\nb\r\nb", "  \n a", "B\n", "no repeats here", "ı\nI\ni", "İ\nb", "a b\na  b",
]


@pytest.mark.parametrize("min_docs, min_chars, hot_rows", [(2, 1, 20_000), (3, 1, 1), (1, 2, 2), (2, 0, 2), (99, 1, 3)])
def test_against_brute_force(spark, min_docs, min_chars, hot_rows):
    check(spark, TEXTS, hot_rows, min_docs=min_docs, min_chars=min_chars)


def test_given_documents_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want = plain([r.text for r in rows])
    assert any(d for *_, d in want)
    got = {r.doc_id: r for r in QUERIES["op12_line_dedup"](spark, sf_dir).collect()}
    for r, (kept, n, dropped) in zip(rows, want):
        sha = hashlib.sha256(kept.encode()).hexdigest()
        assert (got[r.doc_id].n_lines, got[r.doc_id].n_dropped, got[r.doc_id].kept_sha256) == (n, dropped, sha)


def test_lines_joined_instead_of_broadcast(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check(spark, TEXTS * 3, 2, min_docs=4)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_repeated_rows_count_each(spark):
    docs = spark.createDataFrame([(1, "same\nline")] * 5 + [(None, "line\nown")], "doc_id long, text string")
    got = dedup_lines(docs, min_docs=6).collect()
    assert sorted(r.kept for r in got) == ["own"] + ["same"] * 5


def test_one_very_long_document_and_one_line_in_all(spark, long_text):
    many = "\n".join(f"line {i % 5000}" for i in range(50_000))
    texts = [many, long_text, *["common\n" + str(i) for i in range(300)], many]
    check(spark, texts, 50, min_docs=2)


def test_other_columns_with_clashing_names(spark):
    docs = spark.createDataFrame(
        [("a\nb", 1, "p", 2, [1], "l"), ("b\nc", None, None, None, None, None)],
        "text string, h0 int, row string, d0 int, places array<int>, lines string",
    )
    got = drop_repeated_lines(docs, min_docs=2)
    assert got.columns == docs.columns
    assert sorted(r.text for r in got.collect()) == ["a", "c"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_lines(docs).count() == 0 and drop_repeated_lines(docs).columns == docs.columns


def test_wrong_options(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    with pytest.raises(ValueError):
        dedup_lines(docs, min_docs=0)


def test_no_python_in_the_plan(spark, sf_dir):
    plan = QUERIES["op12_line_dedup"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
