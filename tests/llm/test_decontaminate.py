import hashlib
import re

import pytest

from corpusweave.llm.decontaminate import contamination, decontaminate
from corpusweave.llm.queries import QUERIES, SQL
from tools.oracle_check import rows_of


def plain_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def plain(docs, items, window=10):
    out = []
    for text in docs:
        w, hit, found = plain_words(text), set(), set()
        for item, item_text in items:
            v = plain_words(item_text)
            n = min(window, len(v))
            for j in range(len(v) - n + 1) if n else ():
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[j : j + n]:
                        hit |= set(range(i, i + n))
                        if item is not None:
                            found.add(str(item))
        out.append((len(w), len(hit), sorted(found)))
    return out


PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
ITEMS = [
    (1, PASSAGE), (12, "Short item here"), (2, PASSAGE.upper() + "!"), (None, "nameless item of five words"),
    (3, ""), (4, None), (12, "Short item here"), (5, "Äther ÄTHER"),
]
DOCS = [
    None, "", "...", PASSAGE, f"x {PASSAGE.replace(' ', '--')} y {PASSAGE}", "a short, ITEM;here! b",
    "short item", "nameless item of five words", PASSAGE[:-3], "äther äther", "Äther ÄTHER", "alpha beta " * 50,
    "short item here short item here", "kappa lambda mu " + PASSAGE, PASSAGE, PASSAGE,
]


def tables(spark):
    docs = spark.createDataFrame(
        [(i if i % 5 else None, t, i, i) for i, t in enumerate(DOCS)], "doc_id long, text string, w int, idx int"
    )
    bench = spark.createDataFrame([(i, t, 1, 2) for i, t in ITEMS], "item_id long, text string, hash int, size int")
    return docs, bench


@pytest.mark.parametrize("max_broadcast", [0, 200_000])
@pytest.mark.parametrize("window", [10, 4])
def test_agrees_with_brute_force(spark, window, max_broadcast):
    docs, bench = tables(spark)
    got = contamination(docs, bench, window=window, max_broadcast=max_broadcast)
    rows = sorted(((r.id, r.n_words, r.n_hit, list(r["items"])) for r in got.collect()), key=str)
    want = plain(DOCS, ITEMS, window)
    ids = [i if i % 5 else None for i in range(len(DOCS))]
    assert rows == sorted(((i, *w) for i, w in zip(ids, want)), key=str)


@pytest.mark.parametrize("max_broadcast", [0, 200_000])
def test_documents_or_spans_go(spark, max_broadcast):
    docs, bench = tables(spark)
    clean = [t for t, (_, n, _) in zip(DOCS, plain(DOCS, ITEMS)) if not n]
    kept = decontaminate(docs, bench, max_broadcast=max_broadcast)
    assert kept.columns == docs.columns
    assert sorted((r.text for r in kept.collect()), key=str) == sorted(clean, key=str)
    cut = decontaminate(docs, bench, max_broadcast=max_broadcast, remove="spans")
    assert cut.columns == docs.columns and cut.count() == docs.count()
    by = {r.w: r.text for r in cut.collect()}
    assert by[0] is None and by[3] == "" and by[4] == "x y " and by[5] == "a b" and by[6] == "short item"
    for text in by.values():
        assert plain([text], ITEMS)[0][1] == 0


def test_spans_keep_what_stands_around(spark):
    docs = spark.createDataFrame([(1, "\n «So» one two three, four. End!\n")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    assert decontaminate(docs, bench, remove="spans").first().text == "\n «So» End!\n"


def test_empty_tables_and_long_texts(spark, long_text):
    docs, bench = tables(spark)
    assert contamination(docs.limit(0), bench).count() == 0
    none = contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(DOCS) and all(r.n_hit == 0 for r in none)
    assert decontaminate(docs, bench.limit(0)).count() == len(DOCS)
    long = spark.createDataFrame([(1, long_text + PASSAGE)], "doc_id long, text string")
    r = contamination(long, bench).first()
    assert (r.n_words, r.n_hit, r["items"]) == (len(plain_words(long_text)) + 12, 12, ["1", "2"])


def test_query_agrees_with_sql(spark, sf_dir, con):
    df = QUERIES["op7_decontaminate"](spark, sf_dir)
    cursor = con.execute(SQL["op7_decontaminate"])
    names = [d[0] for d in cursor.description]
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())


def test_query_agrees_with_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    grams = {}
    for item, text in items:
        v = plain_words(text)
        n = min(10, len(v))
        for j in range(len(v) - n + 1):
            grams.setdefault(tuple(v[j : j + n]), set()).add(str(item))
    got = {r.doc_id: r for r in QUERIES["op7_decontaminate"](spark, sf_dir).collect()}
    for d in docs:
        w, hit, found = plain_words(d.text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[tuple(w[i : i + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        r = got[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), len(hit), len(found), digest)
