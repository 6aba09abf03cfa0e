import random
from collections import Counter
from itertools import combinations

import pytest
import regex

from corpusweave.operators import segmentation
from corpusweave.operators.segmentation import (
    BIT,
    WordModel,
    cohesive_words,
    fit_words,
    segmenter,
    word_candidates,
    word_usage,
)
from corpusweave.plans import jobs


def every_cut(run):
    for n in range(len(run)):
        for at in combinations(range(1, len(run)), n):
            yield [run[a:b] for a, b in zip((0, *at), (*at, len(run)))]


def price(model, words):
    cost = 0
    for w in words:
        own = model.costs.get(w, model.unknown if len(w) == 1 else None)
        if own is None or len(w) > model.max_chars:
            return None
        cost += own
    return cost, len(words)


def test_cut_is_the_cheapest_of_all_cuts():
    rng = random.Random(1)
    for _ in range(300):
        grams = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(8)}
        model = WordModel({g: rng.randint(1, 6) * BIT for g in grams}, 7 * BIT, letters="a-z")
        run = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))
        prices = [p for c in every_cut(run) if (p := price(model, c))]
        assert "".join(model.cut(run)) == run and price(model, model.cut(run)) == min(prices)


def plain_grams(texts, letters, max_chars, min_count):
    counts = {}
    for text in texts:
        runs = "".join(c if c in letters else " " for c in text or "").split()
        for run in runs:
            for i in range(len(run)):
                for n in range(1, min(max_chars, len(run) - i) + 1):
                    counts[run[i : i + n]] = counts.get(run[i : i + n], 0) + 1
    return {g: n for g, n in counts.items() if n >= min_count}


def test_candidates_are_all_frequent_grams(spark):
    rng = random.Random(2)
    texts = [None, "", "我", *["".join(rng.choice("我你他们好。 x") for _ in range(60)) for _ in range(30)]]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.word: r.n for r in word_candidates(docs, "text", 3, 4).collect()}
    assert got == plain_grams(texts, "我你他们好", 3, 4)


def sentences(n, seed=3):
    rng = random.Random(seed)
    words = ["天气", "今天", "我们", "喜欢", "图书馆", "的", "是", "北京", "很好", "学生"]
    return [[rng.choice(words) for _ in range(12)] for _ in range(n)]


def test_words_of_a_corpus_are_found(spark):
    told = sentences(400)
    docs = spark.createDataFrame([("".join(s) + "。ok x",) for s in told], "text string")
    model = fit_words(docs, "text", rounds=2)
    spaced = segmenter(spark, model)
    got = [r[0] for r in docs.select(spaced("text")).collect()]
    right = sum(g == " ".join(s) + "。ok x" for g, s in zip(got, told))
    cuts = sum(len(set(g.split("。")[0].split()) & set(s)) for g, s in zip(got, told))
    assert all(g.replace(" ", "") == "".join(s) + "。okx" for g, s in zip(got, told))
    assert right > 0.5 * len(told) and cuts > 0.9 * sum(len(set(s)) for s in told)


def test_words_hold_together(spark):
    counts = {"a": 40, "b": 40, "c": 20, "ab": 30, "bc": 5, "abc": 5}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    for bound in (0.1, 0.6, 1.0, 1.5, 5.0):
        want = {"a", "b", "c"} | {
            w for w, n in counts.items() if len(w) > 1
            and min(n * 100 / (counts[w[:i]] * counts.get(w[i:], 1e9)) for i in range(1, len(w))) >= bound
        }
        assert {r.word for r in cohesive_words(table, bound).collect()} == want


def test_usage_counts_every_word(spark):
    docs = spark.createDataFrame([("abab",), ("ab",), (None,), ("c-ab",)], "text string")
    model = WordModel({"ab": BIT, "a": 3 * BIT, "b": 3 * BIT}, 9 * BIT, letters="a-z")
    assert {r.word: r.n for r in word_usage(docs, "text", model).collect()} == {"ab": 4, "c": 1}


def test_odd_texts(spark, sf_dir):
    docs = spark.createDataFrame([(None,), ("",), ("latin only",), ("我" * 20_000,)], "text string")
    model = fit_words(docs, "text")
    got = [r[0] for r in docs.select(segmenter(spark, model)("text")).collect()]
    assert got[:3] == [None, "", "latin only"] and got[3].replace(" ", "") == "我" * 20_000
    empty = spark.createDataFrame([], "text string")
    assert fit_words(empty, "text").costs == {} and WordModel().cut("我们") == ["我", "们"]
    with_extra = spark.createDataFrame([("我们我们", 1, 2)], "text string, word int, n int")
    assert word_candidates(with_extra, "text", 2, 2).count() == 3


@pytest.mark.parametrize("kind", ["minhash", "sentence"])
def test_jobs_in_an_unspaced_language(spark, tmp_path, kind):
    told = ["".join(s) for s in sentences(60)]
    texts = [*told, told[3] + "。", told[5], "今天很好。" * 2 + told[7]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    docs.write.json(str(tmp_path / "in"))
    cfg = {
        "reader": {"type": "json", "kwargs": {"data_folder": str(tmp_path / "in"), "id_key": "doc_id"}},
        "writer": {"type": "json", "kwargs": {"output_folder": str(tmp_path / "out")}},
        "use_column_info_adapter": True,
        "language": "zho",
    }
    if kind == "minhash":
        jobs.run_minhash_job(spark, cfg)
        kept = {r.doc_id for r in spark.read.json(str(tmp_path / "out")).collect()}
        assert set(range(60)) == kept & set(range(60)) and not {60, 61} & kept
    else:
        jobs.run_sentence_job(spark, cfg | {"dedup_config": {"split_sentences": True, "n_sentences": 1}})
        kept = {r.doc_id: r.text for r in spark.read.json(str(tmp_path / "out")).collect()}
        assert 60 not in kept and 61 not in kept and kept[62] == "今天很好。"


@pytest.mark.parametrize("piece, lanes, longest", [(7, 1, 1 << 16), (50, 3, 5), (1 << 19, 16, 1 << 16)])
def test_many_runs_are_cut_at_once_as_one_by_one(monkeypatch, piece, lanes, longest):
    for name, value in (("PIECE", piece), ("LANES", lanes), ("LONGEST", longest)):
        monkeypatch.setattr(segmentation, name, value)
    rng = random.Random(4)
    for _ in range(12):
        alphabet = "abcé漢\U00020001"[: rng.randint(2, 6)]
        grams = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4))) for _ in range(30)]
        model = WordModel({g: rng.randint(0, 6) * BIT for g in grams}, 7 * BIT, 3, r"\p{L}")
        texts = ["".join(rng.choice(alphabet + " .x") for _ in range(rng.choice([0, 1, 9, 80]))) for _ in range(30)]
        assert model.spaced_all(texts) == [model.spaced(t) for t in texts]
        used = {}
        for batch in model.usage(texts):
            for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist()):
                used[word] = used.get(word, 0) + n
        words = [w for t in texts for run in regex.findall(r"\p{L}+", t) for w in model.cut(run)]
        assert used == Counter(words)


def test_grams_of_many_letters_are_counted_before_they_become_rows(spark, monkeypatch):
    monkeypatch.setattr(segmentation, "PIECE", 1 << 14)
    rng = random.Random(5)
    letters = [chr(c) for c in range(0x4E00, 0x9000)]
    texts = ["".join(rng.choice(letters) for _ in range(9000)) + "我们。我们" * 5 for _ in range(2)]
    # More letters than fit five digits of a 62-bit number.
    chars = segmentation._code_points([texts[0]])
    left = len(chars) - segmentation.np.arange(len(chars))
    got = {}
    for batch in segmentation._gram_counts(chars, left, 5):
        got |= dict(zip(batch["word"].to_pylist(), batch["n"].to_pylist()))
    assert got == plain_grams(texts[:1], set(texts[0]), 5, 1)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    found = word_candidates(docs, "text", 5, 2)
    assert "Generate" not in found._jdf.queryExecution().toString()
    assert {r.word: r.n for r in found.collect()} == plain_grams(texts, {*letters, "我", "们"}, 5, 2)
