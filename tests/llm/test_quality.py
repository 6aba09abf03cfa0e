import zlib

import numpy as np

from corpusweave.llm.common import labelled_sample
from corpusweave.llm.quality import (
    NEIGHBOURS,
    POWER,
    drop_low_quality,
    fit_quality,
    quality_score,
    surface_bins,
    trigram_counts,
    vote,
)
from corpusweave.llm.queries import QUERIES


def test_votes_agree_with_brute_force_in_any_blocks():
    rng = np.random.default_rng(5)
    docs = rng.standard_normal((7, 8)).astype(np.float32)
    known = rng.standard_normal((300, 8)).astype(np.float32)
    docs /= np.linalg.norm(docs, axis=1, keepdims=True)
    known /= np.linalg.norm(known, axis=1, keepdims=True)
    labels = rng.integers(0, 2, 300).astype(np.float32)
    want = []
    for d in docs:
        sims = sorted(((float(d @ k), y) for k, y in zip(known, labels)), reverse=True)[:NEIGHBOURS]
        w = [max(s, 1e-3) ** POWER for s, _ in sims]
        want.append(sum(a * y for a, (_, y) in zip(w, sims)) / sum(w))
    for block in (1, 40, 1000):
        assert np.allclose(vote(docs, known, labels, block=block), want, atol=1e-4)


def test_terms_of_short_texts():
    assert trigram_counts(b"").sum() == trigram_counts(b"ab").sum() == 0
    assert trigram_counts(b"abcd").sum() == 2
    assert len(surface_bins(b"")) == len(surface_bins(b"A a a 1!")) == 7


def test_odd_rows_and_missing_labels(spark, long_text):
    docs = spark.createDataFrame(
        [(1, None, "a"), (2, "", "b"), (None, "x y z", "c"), (4, long_text, "d"), (4, long_text, "d")],
        "doc_id long, text string, label string",
    )
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    model = spark.sparkContext.broadcast(fit_quality(docs, none))
    assert [r[0] for r in docs.select(quality_score(model)("text")).collect()] == [0.5] * 5
    assert drop_low_quality(docs, model).columns == docs.columns
    ids = [i for i in (1, 2, 4) if zlib.crc32(str(i).encode()) % 5]
    some = spark.createDataFrame([(i, 1, 0) for i in ids] * 2, "doc_id long, quality int, w int")
    model = spark.sparkContext.broadcast(fit_quality(docs, some))
    scores = [r[0] for r in docs.select(quality_score(model)("text")).collect()]
    assert all(s == 1 for s in scores)
    empty = docs.limit(0)
    model = spark.sparkContext.broadcast(fit_quality(empty, some.limit(0)))
    assert drop_low_quality(empty, model).count() == 0


def test_held_out_rows_are_not_learned_from(spark):
    ids = range(200)
    held = [i for i in ids if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame([(i, f"text number {i} " * 5) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i not in held)) for i in ids], "doc_id long, quality int")
    assert set(fit_quality(docs, labels).labels) == {1.0}
    assert len(fit_quality(docs, labels, limit=50).labels) == 50


def test_held_out_accuracy(spark):
    rows = QUERIES["op3_quality"](spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_ties_go_to_the_front():
    known = np.ones((4025, 1), np.float32)
    labels = np.array([1] * 25 + [0] * 4000, np.float32)
    for block in (7, 25, 1000, 5000):
        assert vote(np.ones((3, 1), np.float32), known, labels, block=block).tolist() == [1.0] * 3
        assert vote(np.ones((1, 1), np.float32), known, labels[::-1], block=block).tolist() == [0.0]


def test_labels_of_other_documents_take_no_place(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(2000)], "doc_id long, quality int")
    got = [r.text for r in labelled_sample(docs, labels, "quality", 5, 9, 4).collect()]
    assert len(set(got)) == len(got) == 4


def test_a_repeated_key_counts_once(spark):
    rows = [(1, f"copy {i % 3}") for i in range(100_000)] + [(2, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (3, 1)], "doc_id long, quality int")
    got = [tuple(r) for r in labelled_sample(docs, labels, "quality", 5, 9, 50).collect()]
    assert len(got) == 2 and ("", 0) in got and {x for _, x in got} == {0, 1}
