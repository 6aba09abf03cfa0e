import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusweave.llm import simhash as module
from corpusweave.llm.common import whole_row
from corpusweave.llm.queries import QUERIES
from corpusweave.llm.simhash import (
    fingerprint_links,
    forest,
    simhash,
    simhash_components,
    simhash_dedup,
    word_shingle_hashes,
)
from corpusweave.plans.staging import stage


def plain_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Smallest id reachable over links of at most 3 bits, per (id, fp)."""
    best = {k: i for k, (i, _) in enumerate(fps)}
    changed = True
    while changed:
        changed = False
        for a, (_, x) in enumerate(fps):
            for b, (_, y) in enumerate(fps):
                if (x ^ y).bit_count() <= 3 and best[b] < best[a]:
                    best[a], changed = best[b], True
    return list(best.values())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZÉß \t\n\x0b\x0c\r\x1c\xa0.x", max_size=60))
def test_fingerprint_of_any_text(text):
    assert simhash(word_shingle_hashes(text.encode())) % 2**64 == plain_fingerprint(text)


def signed(x):
    return x - 2**64 if x >> 63 else x


def flipped(fp, *bits):
    for b in bits:
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize("block, refine", [(1, 4096), (3, 4096), (128, 4096), (3, 1), (128, 20)])
def test_links_connect_what_brute_force_connects(spark, block, refine):
    rng = np.random.default_rng(3)
    fps = {0, 2**64 - 1}
    for _ in range(12):
        fp = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(2))
        fps.add(fp)
        for _ in range(8):
            fp = flipped(fp, *rng.integers(0, 64, int(rng.integers(1, 5))).tolist())
            fps.add(fp)
    # A bucket of more fingerprints than a block: they differ in the upper half only.
    fps |= {flipped(5, *(32 + int(b) for b in rng.integers(0, 32, 4))) for _ in range(60)}
    order = sorted(fps)
    want = plain_components(list(enumerate(order)))
    df = spark.createDataFrame([(signed(f),) for f in order], "fp bigint")
    best = list(range(len(order)))
    place = {signed(f): i for i, f in enumerate(order)}
    links = [(place[r.u], place[r.v]) for r in fingerprint_links(df, 3, block, refine).collect()]
    assert all((order[a] ^ order[b]).bit_count() <= 3 for a, b in links)
    for _ in order:
        for a, b in links:
            best[a] = best[b] = min(best[a], best[b])
    assert best == want


@pytest.mark.parametrize("max_bits", [1, 5])
def test_other_numbers_of_bits(spark, max_bits):
    rng = np.random.default_rng(8)
    fps = {int(rng.integers(0, 2**63)) for _ in range(10)}
    for fp in list(fps):
        fps |= {flipped(fp, *rng.integers(0, 64, k).tolist()) for k in range(1, 8)}
    order = sorted(fps)
    df = spark.createDataFrame([(signed(f),) for f in order], "fp bigint")
    for refine in (1, 4096):
        links = {(r.u, r.v) for r in fingerprint_links(df, max_bits, 4, refine).collect()}
        parent = {signed(f): signed(f) for f in order}

        def find(x):
            return x if parent[x] == x else find(parent[x])

        for a, b in links:
            assert ((a ^ b) % 2**64).bit_count() <= max_bits
            parent[find(a)] = find(b)
        for a in order:
            for b in order:
                if (a ^ b).bit_count() <= max_bits:
                    assert find(signed(a)) == find(signed(b))


def test_variants_are_never_broadcast(spark, monkeypatch):
    """The file of the fingerprints is small, their variants are 64 times as many rows."""
    plans = []

    def planned(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def seen(df, label):
        plans.append(planned(df))
        return stage(df, label)

    fps = stage(spark.range(300).select(F.xxhash64("id").alias("fp")), "fps")
    want = {tuple(r) for r in fingerprint_links(fps, refine=1).collect()}
    monkeypatch.setattr(module, "stage", seen)
    links = fingerprint_links(fps, refine=1)
    assert {tuple(r) for r in links.collect()} == want
    plans.append(planned(links))
    assert len(plans) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


def test_forest_has_fewer_edges_than_nodes():
    fps = np.array([signed(flipped(2**63, b)) for b in range(40)], np.int64)
    u, v = forest(fps, 3)
    assert len(u) == len(fps) - 1


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, row string, fp int, h0 string")


def test_components_of_odd_rows(spark, long_text):
    rows = [
        (4, None), (9, ""), (7, " \t\n"), (1, long_text), (2, long_text), (3, "one two"),
        (3, "one two"), (None, "one two"), (None, "quite another text here"), (11, "ONE TWO"),
        (12, "one Two three four five six"),
    ]
    df = make(spark, [(*r, "x", 1, "y") for r in rows])
    got = simhash_components(df)
    assert got.columns == ["id", "fp", "component"]
    texts = {}
    for r in got.collect():
        texts.setdefault(r.fp % 2**64, set()).add(r.component)
    assert texts[0] == {4}
    assert texts[plain_fingerprint("one two")] == {3}
    assert texts[plain_fingerprint(long_text)] == {1}
    assert texts[plain_fingerprint("quite another text here")] == {None}
    assert got.count() == len(rows)


def test_one_row_of_each_component_stays(spark):
    rows = [
        (5, "a b c", "x", 1, "p"), (2, "a b c", "x", 1, "q"), (2, "a b c", "x", 1, "q"),
        (2, "a b c", "x", 2, "q"), (8, None, "x", 1, None), (None, None, None, None, None),
        (None, "lonely words here", "z", None, None), (None, "lonely words here", "z", None, None),
        (9, "something else entirely", "x", 1, "p"),
    ]
    kept = simhash_dedup(make(spark, rows))
    assert kept.columns == ["doc_id", "text", "row", "fp", "h0"]
    got = sorted(map(tuple, kept.collect()), key=str)
    assert [(r[0], r[1]) for r in got] == sorted(
        [(2, "a b c"), (8, None), (9, "something else entirely"), (None, "lonely words here")], key=str
    )


def test_rows_that_differ_in_the_place_of_a_null(spark):
    rows = [("x", None), (None, "x"), (None, None), ("x", None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert df.select(*whole_row(df)[1]).distinct().count() == 3


def test_empty_table(spark):
    df = make(spark, [])
    assert simhash_components(df).count() == 0
    assert simhash_dedup(df).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    fps = [(d.doc_id, plain_fingerprint(d.text)) for d in docs]
    want = {
        (i, f"{fp:016x}", c) for (i, fp), c in zip(fps, plain_components(fps))
    }
    got = QUERIES["op2_simhash"](spark, sf_dir)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got.collect()} == want
