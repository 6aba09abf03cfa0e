import random
import re
import zlib
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusweave.llm.queries import QUERIES
from corpusweave.llm.spelling import near_words, signatures, spelling_variants, word_counts


def one_apart(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_counts(rows, min_chars=6, min_count=5, every=199):
    counts = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_chars:
                counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if n >= min_count}


def plain_variants(counts, ratio=5):
    near = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if abs(len(a) - len(b)) <= 1 and one_apart(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out)


def check(spark, counts, **options):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = sorted(tuple(r) for r in spelling_variants(words, **options).collect())
    assert got == plain_variants(counts, options.get("ratio", 5))


@settings(max_examples=300, deadline=None)
@given(st.text("abcé", max_size=14), st.data())
def test_near_words_share_a_signature(word, data):
    at = data.draw(st.integers(0, len(word)))
    edits = [word[:at] + "b" + word[at:], word[:at] + word[at + 1 :], word[:at] + "é" + word[at + 1 :]]
    for parts in (3, 5, 7):
        for other in edits:
            assert set(signatures(word, parts)) & set(signatures(other, parts))


def test_signatures_leave_two_parts_out():
    assert len(signatures("letters")) == 21 and len(set(signatures("letters"))) == 21
    assert signatures("silent") == signatures("listen")
    assert not set(signatures("abcdef")) & set(signatures("uvwxyzuvwxyz"))


@pytest.mark.parametrize("parts, bucket", [(7, 64), (3, 4), (4, 1), (7, 2)])
def test_random_words_against_brute_force(spark, parts, bucket):
    rng = random.Random(parts)
    counts = {}
    for _ in range(60):
        base = "".join(rng.choice("aeinstéß") for _ in range(rng.randint(6, 12)))
        counts[base] = rng.randint(5, 2000)
        for _ in range(rng.randint(0, 5)):
            i = rng.randrange(len(base))
            new = rng.choice([base[:i] + base[i + 1 :], base[:i] + "x" + base[i:], base[:i] + "n" + base[i + 1 :]])
            counts[new] = rng.choice([5, 10, 25, 50, 1000])
    check(spark, counts, parts=parts, bucket=bucket)


def test_chains_and_ties(spark):
    check(spark, {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125})
    # Equally frequent forms: the smallest word; just below the ratio: none.
    check(spark, {"letter": 5, "better": 25, "lettel": 25, "metter": 25, "pillow": 5, "pillot": 24})


def test_given_documents_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op13_spelling"](spark, sf_dir).collect())
    want = plain_variants(plain_counts(rows))
    assert got == want and any(r[1] for r in want)


def test_counts_of_odd_rows(spark, long_text):
    rows = [
        (None, "Straße straße STRASSE"), (None, None), (1, ""), (2, "ÀÉÎÕÜX×÷ÿ ÀÉÎÕÜX×÷ÿ short"),
        (2, "a1abcdefİabcdefg_hijklmn"), (3, "q" * 100_000), (3, "q" * 100_000), (4, long_text), (4, long_text),
    ] + [(i, f"word{'x' * (i % 3)}letters {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"min_count": 1}, {"min_count": 1, "drop_every": 3}, {"min_count": 2, "min_chars": 1, "drop_every": 7}):
        got = {r.word: r.n for r in word_counts(docs, **options).collect()}
        assert got == plain_counts(
            rows, options.get("min_chars", 6), options.get("min_count", 5), options.get("drop_every", 199)
        )


def test_long_words_and_a_large_bucket(spark):
    counts = {"q" * 3000: 100, "q" * 3001: 7, "q" * 2999 + "z": 9}
    # Anagrams share every signature.
    counts |= {"".join(p): 5 + i for i, p in enumerate(sorted({tuple(random.Random(s).sample("abcdefgh", 8)) for s in range(300)}))}
    check(spark, counts, bucket=16)


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants(word_counts(docs)).collect() == []
    clash = spark.createDataFrame(
        [(1, "spelling spelling", "x", 1, "y")], "doc_id long, text string, word string, n int, run string"
    )
    assert [tuple(r) for r in word_counts(clash, min_count=2).collect()] == [("spelling", 2)]
    words = spark.createDataFrame([("abcdef", 5, 1), ("abcdeg", 50, 2)], "word string, n long, form int")
    assert sorted(tuple(r)[:3] for r in spelling_variants(words).collect()) == [
        ("abcdef", "abcdeg", "abcdeg"), ("abcdeg", None, "abcdeg")
    ]


def test_wrong_options(spark):
    words = spark.createDataFrame([], "word string, n long")
    with pytest.raises(ValueError):
        near_words(words, parts=2)
    with pytest.raises(ValueError):
        spelling_variants(words, ratio=1)
