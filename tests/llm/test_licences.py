import math
import re
import textwrap

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusweave.llm.licences import (
    AMONG,
    COMMON,
    CONFIRMED,
    FAMILIES,
    OTHER_TEXT,
    STATEMENTS,
    WINDOW,
    _ordinary_paragraphs,
    _percentile,
    document_licences,
    scan_licences,
    train_licences,
)
from corpusweave.llm.queries import QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return train_licences(docs)


def split_words(text):
    return [x for x in re.split(r"[\W_]+", text.lower()) if x]


def grams(w):
    return {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


def judge(model, found):
    logits = [
        model.intercepts[c] + sum(model.weights[g][c] for g in found) for c in range(len(FAMILIES))
    ]
    best = logits.index(max(logits))
    probability = 1 / sum(math.exp(x - max(logits)) for x in logits)
    if best == 0 or probability < model.threshold:
        return None
    likeness = max(
        sum(t in model.statement_grams.get(g, ()) for g in found) / model.statement_sizes[t]
        for t, (f, _) in enumerate(STATEMENTS)
        if f == FAMILIES[best]
    )
    return FAMILIES[best], round(probability, 9), round(likeness, 9), likeness >= CONFIRMED


def plain(model, text):
    """``paragraph, family, probability, likeness, confirmed, lines`` of a text's findings."""
    lines = [split_words(x) for x in re.split(r"\r\n|[\n\x0b\x0c\r\x85\u2028\u2029]", text or "")]
    hits = []
    for size in range(1, WINDOW + 1):
        for s in range(len(lines) - size + 1):
            part = lines[s : s + size]
            if not all(part):
                continue
            found = {g for g in grams(sum(part, [])) if g in model.weights}
            # Lines on which an n-gram begins; more than one must take part.
            begun = set()
            for k, line in enumerate(part):
                rest = sum(part[k:], [])
                begun |= {k for i in range(len(line)) for n in (1, 2, 3)
                          if i + n <= len(rest) and " ".join(rest[i : i + n]) in model.weights}
            got = judge(model, found) if found else None
            if got and (size == 1 or (got[3] and len(begun) > 1)):
                hits.append((s, *got, size))
    out = []
    for family in {h[1] for h in hits}:
        group, reached = [], None
        for h in [*sorted((h for h in hits if h[1] == family), key=lambda h: (h[0], h[5])), None]:
            if h is None or (reached is not None and h[0] >= reached):
                single = [x for x in group if x[5] == 1]
                wide = sorted((x for x in group if x[5] > 1), key=lambda x: (x[5], -x[3], x[0]))
                if any(x[4] for x in single) or not wide:
                    out += single
                else:
                    out += wide[:1]
                group, reached = [], None
            if h is not None:
                group.append(h)
                reached = max(reached or 0, h[0] + h[5])
    return sorted(out)


def found(df):
    out = {}
    for r in df.collect():
        rows = out.setdefault((r.row, r.id), [])
        if r.paragraph is not None:
            rows.append((r.paragraph, r.family, round(r.probability, 9), round(r.likeness, 9), r.confirmed, r.lines))
    return sorted(((k[1], sorted(v)) for k, v in out.items()), key=str)


def test_statements_are_told_apart(spark, model):
    texts = [f"Some words.\nAnd so: {s}\nThe end." for _, s in STATEMENTS]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = found(scan_licences(df, model))
    assert got == sorted(((i, plain(model, t)) for i, t in enumerate(texts)), key=str)
    families = {i: {f for _, f, _, _, sure, _ in rows if sure} for i, rows in got}
    assert sum(families[i] == {f} for i, (f, _) in enumerate(STATEMENTS)) >= len(STATEMENTS) - 2


@pytest.mark.parametrize("width, prefix", [(60, ""), (66, " * "), (72, "# "), (80, "    ")])
def test_wrapped_statements_are_found(spark, model, width, prefix):
    texts = []
    for _, s in STATEMENTS:
        lines = textwrap.wrap(f"{s}", width, initial_indent=prefix, subsequent_indent=prefix)
        texts.append("\n".join(["An ordinary heading.", "", *lines, "", "More words follow."]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scanned = scan_licences(df, model)
    assert found(scanned) == sorted(((i, plain(model, t)) for i, t in enumerate(texts)), key=str)
    named = {r.id: r.licences for r in document_licences(scanned).collect()}
    missed = [s for i, (f, s) in enumerate(STATEMENTS) if f not in named[i].split(",")]
    assert len(missed) <= 2


def test_identifiers_are_found(spark, model):
    ids = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-3.0-only": "GPL", "BSD-2-Clause": "BSD", "ISC": "ISC"}
    texts = [f"// SPDX-License-Identifier: {x}\npackage main" for x in ids]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    named = {r.id: r.licences for r in document_licences(scan_licences(df, model)).collect()}
    assert [named[i] for i in range(len(texts))] == list(ids.values())


def test_given_documents_against_brute_force(spark, docs, model):
    got = found(scan_licences(docs, model))
    assert got == sorted(((r.doc_id, plain(model, r.text)) for r in docs.collect()), key=str)


def test_other_text_states_no_licence(spark, model):
    df = spark.createDataFrame(list(enumerate(OTHER_TEXT)), "doc_id long, text string")
    assert all(not any(sure for *_, sure, _ in rows) for _, rows in found(scan_licences(df, model)))


def test_odd_rows(spark, model, long_text):
    mit = STATEMENTS[0][1]
    rows = [
        (1, None), (2, ""), (3, "\n\n"), (None, mit), (4, long_text + mit), (5, mit), (5, mit),
        (6, "..."), (7, mit + "\n" + mit), (8, "mit"), (9, "license license the mit mit license"),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, p string")
    got = found(scan_licences(df, model))
    assert got == sorted(((i, plain(model, t)) for i, t in rows), key=str)
    assert len(got) == len(rows)
    by = document_licences(scan_licences(df, model))
    assert by.count() == len(rows)
    assert {r.n_confirmed for r in by.where("id = 7").collect()} == {2}
    assert scan_licences(df.limit(0), model).count() == 0


def test_training_without_documents(spark, docs):
    empty = docs.limit(0)
    model = train_licences(empty)
    df = spark.createDataFrame([(1, STATEMENTS[4][1]), (2, "nothing")], "doc_id long, text string")
    assert found(scan_licences(df, model)) == [(1, plain(model, STATEMENTS[4][1])), (2, [])]


def test_query_against_planted_lines(spark, docs, sf_dir):
    want = {
        "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
        "All rights reserved.": "Proprietary",
    }
    got = {r.doc_id: r.licences for r in QUERIES["op5_licences"](spark, sf_dir).collect()}
    assert len(got) == docs.count()
    for d in docs.collect():
        lines = {want[x] for x in want if x in d.text}
        assert got[d.doc_id] == ",".join(sorted(lines))


def test_training_reads_every_document(spark):
    """A word of licences that only the last documents of any sample by hash use is common."""
    rank = F.row_number().over(Window.orderBy(F.xxhash64(F.lit("licences"), "doc_id")))
    line = F.when(rank > 1000, "we met at mit").otherwise("we met at noon")
    docs = spark.range(1050).withColumnRenamed("id", "doc_id").withColumn("text", line)
    assert 50 > COMMON * 1050
    assert "mit" not in train_licences(docs).weights


def test_every_paragraph_is_taken(spark):
    grams, sizes = ["a", "a b", "a b c", "b", "b c", "c"], [3, 5]
    text = F.concat(F.lit("x a b\n \na b c\n"), F.repeat(F.lit("b a\n"), AMONG + 1))
    rows = spark.range(2).select(F.when(F.col("id") == 0, 1).alias("doc_id"), text.alias("text"))
    got = _ordinary_paragraphs(rows, "doc_id", "text", grams, sizes)
    # Null ids count; the line that holds a statement's three words does not.
    assert {(tuple(r.grams), r["count"]) for r in got.groupBy("grams").count().collect()} == {
        (("a", "a b", "b"), 2), (("a", "b"), 2 * (AMONG + 1)),
    }
    for r in got.distinct().collect():
        known = ["", "a", "b"] if "a b" in r.grams else ["b", "a"]
        some = known[: r.i // 7 % 9]
        assert r.t == r.i % 2 and r.cut == (r.i % 5 if r.i % 4 == 2 and r.t == 1 else -1)
        assert (r.front, r.back) == (some if r.i % 4 == 0 else [], some if r.i % 4 == 1 else [])


@pytest.mark.parametrize("share", [0.0, 0.5, 0.9, 0.999, 1.0])
def test_percentile(spark, share):
    rng = np.random.default_rng(3)
    values = [(float(p), int(n)) for p, n in zip(rng.random(500) ** 9, rng.integers(1, 9, 500))]
    values += [(5e-324, 1), (0.25, 70), (0.25, 1)]
    df = spark.createDataFrame(values, "p double, n long")
    want = np.percentile([p for p, n in values for _ in range(n)], 100 * share)
    assert _percentile(df, share, bins=4) == pytest.approx(want, rel=1e-12)
    assert _percentile(df.limit(0), share) is None
