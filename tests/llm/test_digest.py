import hashlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpusweave.llm.digest import (
    digest,
    edit_fingerprints,
    edited,
    fingerprint,
    likeness,
    read_digest,
    write_digest,
)
from corpusweave.llm.queries import QUERIES


def plain_digest(text):
    """Bucket by bucket, in Python's integers."""
    counts = [0] * 256
    n, mask = len(text), 2**32 - 1
    for i in range(n):
        h = text[i] * 0x9E3779B1 ^ text[(i + 3) % n] * 0x85EBCA77 ^ text[(i + 8) % n] * 0xC2B2AE3D
        counts[((h & mask) * 0x27D4EB2F & mask) >> 24] += 1
    quartiles = {sorted(counts)[k] for k in (64, 128, 192)}
    return [sum(c > q for q in quartiles) for c in counts] if text else counts


@given(st.binary(max_size=200))
def test_digest_of_any_bytes(text):
    d = digest(text)
    assert d[1].tolist() == plain_digest(text)
    back = read_digest(write_digest(d))
    assert back[0] == d[0] and np.array_equal(back[1], d[1])
    assert likeness(d, d) == 1.0


@given(st.binary(max_size=80), st.binary(max_size=80))
def test_likeness_is_bounded_and_symmetric(a, b):
    x = likeness(digest(a), digest(b))
    assert 0 <= x <= 1 and x == likeness(digest(b), digest(a))


def test_edited_text():
    assert edited("abcdefgh", "XYZ") == "abcdefXY"
    assert edited("abcdefghi", "X") == "abcdefX"
    assert edited("ab", "XYZ") == "ab" and edited("", "X") == ""
    assert edited("éééñññ", "ü😀z") == "éééñü😀"


def check(got, rows):
    order = sorted(
        ((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode())
    )
    want = []
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        new = edited(text, following).encode()
        a, b, c = digest(text.encode()), digest(new), digest(following.encode())
        want.append(
            (i, len(text), hashlib.sha256(new).hexdigest(), write_digest(a), write_digest(b),
             likeness(a, b), likeness(a, c))
        )
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("rows_per_task", [7, 20_000])
def test_odd_rows(spark, long_text, rows_per_task):
    rows = [(i * 3, f"document {i} says é{i % 9}" * (i % 5 + 1)) for i in range(60)]
    rows += [(None, "x"), (None, None), (9, "again"), (9, "again"), (2**60 + 1, long_text), (2**60, ""), (-5, "ü")]
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, part int, ahead boolean")
    check(edit_fingerprints(docs, rows_per_task=rows_per_task).collect(), rows)


@pytest.mark.parametrize("rows", [[], [(1, "alone")], [(None, "a"), (None, "b")], [(4, "a b c"), (3, None)]])
def test_small_tables(spark, rows):
    check(edit_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_fingerprint_column(spark):
    df = spark.createDataFrame([("abc",), (None,), ("",)], "text string")
    got = [r[0] for r in df.select(fingerprint(df.text)).collect()]
    assert got == [write_digest(digest(b"abc")), "00" * 65, "00" * 65]


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check(QUERIES["op9_digest"](spark, sf_dir).collect(), [tuple(d) for d in docs])


def test_edits_are_nearer_than_other_documents(spark):
    rows = QUERIES["op9_digest"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r.near_edited > r.near_next for r in rows) > 0.97 * len(rows)
