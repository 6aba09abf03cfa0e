import bisect
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusweave.llm.packing import (
    ByteLevelTokenizer,
    Capacities,
    best_fit_plan,
    cut,
    default_tokenizer,
    load_tokenizer,
    pack,
    pack_documents,
    sequences,
)
from corpusweave.llm.queries import QUERIES


def one_by_one(lengths, capacity):
    """Best fit decreasing without any shortcut: sorted remaining capacities of the bins."""
    rest, n = [], 0
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rest, x)
        left = rest.pop(k) if k < len(rest) else capacity
        n += left == capacity
        if left > x:
            bisect.insort(rest, left - x)
    return n, sorted(rest)


def placed(lengths, capacity):
    counts = {x: lengths.count(x) for x in set(lengths)}
    plan = best_fit_plan(counts, capacity)
    bins = {}
    for length, rank, n, per, first, at in plan.itertuples(index=False):
        for i in range(n):
            bins.setdefault(first + i // per, []).append((at + i % per * length, length))
    return bins


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_plan_is_best_fit_decreasing(lengths):
    bins = placed(lengths, 20)
    n, rest = one_by_one(lengths, 20)
    assert len(bins) == n
    full = [max(a + x for a, x in b) for b in bins.values()]
    assert sorted(20 - f for f in full if f < 20) == rest
    for b in bins.values():
        at = 0
        for start, length in sorted(b):
            assert start == at
            at += length
    assert sorted(x for b in bins.values() for _, x in b) == sorted(lengths)


def test_tightest_capacity():
    tree = Capacities(100)
    for rest in (7, 30, 100):
        tree.add(rest, rest, 1)
    assert [tree.tightest(x) for x in (1, 7, 8, 30, 31, 100)] == [7, 7, 30, 30, 100, 100]
    tree.take(100)
    assert tree.tightest(31) is None


def test_cuts():
    assert cut(1024, 1024) == [(0, 1024)]
    assert cut(1025, 1024) == [(0, 1), (1, 1024)]
    assert cut(2048, 1024) == [(0, 1024), (1024, 1024)]
    assert cut(5, 1024) == [(0, 5)]


@pytest.fixture(scope="module")
def tokens():
    return load_tokenizer(default_tokenizer())


@settings(max_examples=300, deadline=None)
@given(
    st.text(alphabet=st.characters(codec="utf-8"), max_size=40)
    | st.text(alphabet="aZ é'sß \n\t\r09.,!  <|>", max_size=60)
)
def test_ids_are_those_of_the_tokenizer(tokens, text):
    assert tokens.fast is not None
    want = tokens.exact.encode(text, add_special_tokens=False).ids
    assert tokens.ids(text).tolist() == want


def test_ids_of_words_and_odd_texts(tokens, sf_dir, spark):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    for text in [*(d.text for d in docs), "x" * 5000, "<|endoftext|> a", "   a\u0085b", "日本語 テキスト", "😀" * 9]:
        assert tokens.ids(text).tolist() == tokens.exact.encode(text, add_special_tokens=False).ids


def test_other_tokenizer_files_are_not_sped_up():
    import public_tokenizers

    assert ByteLevelTokenizer(public_tokenizers.path("word_bpe_49k.json")).fast is None


def check_packed(rows, texts, capacity=1024):
    exact = Tokenizer.from_file(default_tokenizer())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["key"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for key, text in texts.items():
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by_doc[key], key=lambda r: r["piece"])
        assert [(p["start"], p["length"]) for p in pieces] == cut(len(ids), capacity)
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        for p in pieces:
            own = ids[p["start"] : p["start"] + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(own.tobytes())
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    n, _ = one_by_one([r["length"] for r in rows], capacity)
    assert len(by_sequence) == n


def test_query_against_brute_force(spark, sf_dir):
    rows = [r.asDict() for r in QUERIES["op4_packing"](spark, sf_dir).collect()]
    texts = {d.doc_id: d.text for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_packed([r | {"key": r["doc_id"]} for r in rows], texts)


def test_odd_rows(spark, long_text):
    texts = [(1, None), (2, ""), (None, "no id"), (3, long_text), (3, long_text), (4, "a b")]
    docs = spark.createDataFrame([(*t, 5, "x") for t in texts], "doc_id long, text string, length int, piece string")
    got = pack_documents(docs, keep_ids=True)
    rows = [r.asDict() for r in got.collect()]
    doubled = [r for r in rows if r["id"] == 3]
    assert len(doubled) == 2 * len(cut(1 + len(Tokenizer.from_file(default_tokenizer()).encode(long_text).ids), 1024))
    assert {r["id"] for r in rows} == {1, 2, 3, 4, None}
    whole = sequences(got).collect()
    assert len(whole) == one_by_one([r["length"] for r in rows], 1024)[0]
    assert sum(len(s["ids"]) for s in whole) == sum(r["length"] for r in rows)
    assert pack_documents(docs.limit(0)).count() == 0


def test_equal_lengths_are_packed_once_each(spark):
    rng = random.Random(2)
    rows = [(i, 0, 0, rng.choice((1, 5, 5, 5, 9, 10, 3))) for i in range(500)]
    rows += rows[:50]
    pieces = spark.createDataFrame(rows, "id long, piece int, start long, length long")
    got = pack(pieces, 10).collect()
    assert len(got) == 550 and len({(r.sequence_id, r.offset) for r in got}) == 550
    used = {}
    for r in got:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 10
    assert len(used) == one_by_one([r[3] for r in rows], 10)[0]
