"""Language scores, tokenizers, statistics, metrics, vocabularies and start vectors."""

import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusweave.operators import language as lg
from corpusweave.operators import statistics as stx
from corpusweave.operators import tokenizers as tk
from corpusweave.operators import translation_metrics as tm
from corpusweave.operators import vectors as vt
from corpusweave.operators import vocabulary as vb
from corpusweave.operators.embeddings import embed_texts, with_pair_embeddings
from corpusweave.streaming.token_stats import read_stream, tokenizer_stats_stream

TRAIN = [
    ("the cat and the dog are in the house with the other animals", "eng"),
    ("кошка и собака живут в доме вместе с другими животными", "rus"),
    ("le chat et le chien sont dans la maison avec les autres animaux", "fra"),
]


@pytest.fixture(scope="module")
def model(spark):
    train = spark.createDataFrame(TRAIN, "text string, lang string")
    return lg.train_language_model(train, "text", "lang")


def test_language_scores_and_filter(spark, model):
    rows = [(0, "the other house"), (1, "другие животные"), (2, "les autres\nmaisons"), (3, "")]
    docs = spark.createDataFrame(rows, "id int, text string")
    wanted = lg.LanguageFilter(["eng", "rus"], language_threshold=0.5)
    scored = lg.language_scores(docs, "text", model)
    judged = wanted.label(scored).withColumn("keep", wanted.verdict().keep).orderBy("id").collect()
    assert [(r["language"], r["keep"]) for r in judged[:3]] == [
        ("eng", True),
        ("rus", True),
        ("fra", False),
    ]
    assert judged[3]["scores"] == pytest.approx({k: 1 / 3 for k in ("eng", "rus", "fra")})
    assert sum(judged[0]["scores"].values()) == pytest.approx(1)


def test_both_ways_of_meeting_the_model_agree(spark, model):
    texts = [t for t, _ in TRAIN] + ["", None, "日本語のテキスト", TRAIN[0][0], "ab"]
    docs = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)], "id int, text string")
    both = [
        sorted(
            ((r["id"], r["text"], r["scores"] and {k: round(v, 12) for k, v in r["scores"].items()})
             for r in lg.language_scores(docs, "text", model, broadcast_cells=cells).collect()),
            key=str,
        )
        for cells in (0, 10**6)
    ]
    assert both[0] == both[1] and len(both[0]) == len(texts)
    assert [s for _, t, s in both[0] if t is None] == [None]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_sums_of_packed_ngrams(n):
    rng = random.Random(n)
    texts = ["", "a", "é😀xyz", *["".join(rng.choice("abcé😀 ") for _ in range(rng.randint(0, 40))) for _ in range(50)]]
    grams = sorted({t[i : i + n] for t in texts[::2] for i in range(len(t) - n + 1)})
    table = {g: [rng.randint(-9, 9), rng.randint(-9, 9)] for g in grams}
    packed, _ = lg.packed_ngrams(grams, n)
    order = np.argsort(packed)
    scores = np.array([table[grams[i]] for i in order] + [[7, 8]], np.int64)
    want = [
        np.sum([table.get(t[i : i + n], [7, 8]) for i in range(len(t) - n + 1)] or [[0, 0]], axis=0).tolist()
        for t in texts
    ]
    assert lg.language_sums(texts, packed[order], scores, n).tolist() == want
    tile, lg.TILE_CELLS = lg.TILE_CELLS, 7
    try:
        assert lg.language_sums(texts, packed[order], scores, n).tolist() == want
    finally:
        lg.TILE_CELLS = tile
    assert lg.language_sums([], packed[order], scores, n).shape == (0, 2)


def test_longer_ngrams_give_the_same_in_place_and_shuffled(spark):
    rows = [("one two three four", "en"), ("eins zwei drei vier", "de"), (None, "en"), ("one", "de"), ("xy", "en")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = lg.train_language_model(docs.where("text is not null"), "text", "lang", n=4)
    found = [
        {r["text"]: r["scores"] and {k: round(v, 9) for k, v in r["scores"].items()}
         for r in lg.language_scores(docs, "text", model, broadcast_cells=cells).collect()}
        for cells in (10**9, 0)
    ]
    assert found[0] == found[1]


def test_language_filter_keeps_the_table(spark, model):
    docs = spark.createDataFrame(
        [(1, "the other house", "x"), (1, "les autres maisons", "y"), (2, None, "z")], "id int, text string, more string"
    )
    judged = lg.language_filter(docs, "text", model, lg.LanguageFilter("eng", 0.5))
    assert judged.columns == [*docs.columns, "language", "language_score", "keep", "drop_reason"]
    assert {r["more"]: (r["language"], r["keep"]) for r in judged.collect()} == {
        "x": ("eng", True), "y": ("fra", False), "z": (None, False)
    }


@pytest.mark.parametrize(
    "options, keep",
    [
        ({"languages": "a", "language_threshold": 0.6}, False),
        ({"languages": ["a", "b"], "language_threshold": 0.59}, True),
        ({"languages": ["z"]}, False),
        ({"language_threshold": 0.6}, False),
        ({"language_threshold": 0.5}, True),
        ({"languages": ["z"], "label_only": True}, True),
    ],
)
def test_thresholds_are_strict(spark, options, keep):
    df = spark.createDataFrame([({"a": 0.6, "b": 0.4},)], "scores map<string,double>")
    rule = lg.LanguageFilter(**options, keep_top_pairs_threshold=0.3)
    row = rule.label(df).withColumn("keep", rule.verdict().keep).first()
    assert (row["language"], row["language_score"], row["keep"]) == ("a", 0.6, keep)
    named = options.get("languages")
    expected = {k: v for k, v in {"a": 0.6, "b": 0.4}.items() if named is None or k in named}
    assert row["top_language_scores"] == expected


def test_empty_language_list(spark):
    with pytest.raises(ValueError):
        lg.LanguageFilter([]).verdict()


def test_top_languages(spark):
    df = spark.createDataFrame([({"a": 0.1, "b": 0.7, "c": 0.2},)], "s map<string,double>")
    row = df.select(lg.top_languages(F.col("s"), 2).alias("t")).first()
    assert row["t"] == {"b": 0.7, "c": 0.2}


def test_predictor_sees_no_line_breaks(spark):
    def load():
        return lambda texts: [{"breaks": float("\n" in t), "none": 0.5} for t in texts]

    df = spark.createDataFrame([("a\nb",), (None,)], "text string")
    rows = df.select(lg.predicted_scores(load)(F.col("text")).alias("s")).collect()
    assert [r["s"] for r in rows] == [{"breaks": 0.0, "none": 0.5}, None]


def test_embedding_is_batched_and_skips_nulls(spark):
    def load():
        def embed(texts):
            assert len(texts) <= 2
            return [[float(len(t)), 1.0] for t in texts]

        return embed

    df = spark.createDataFrame([("a", "bb"), (None, "c"), ("ddd", None)], "x string, y string")
    rows = with_pair_embeddings(df.coalesce(1), ["x", "y"], embed_texts(load, 2), F.upper).collect()
    assert [(r["embedding_1"], r["embedding_2"]) for r in rows] == [
        ([1.0, 1.0], [2.0, 1.0]),
        (None, [1.0, 1.0]),
        ([3.0, 1.0], None),
    ]


VOCAB = [("a", 1), ("b", 2), ("c", 3)]


def test_statistics_count_an_unknown_id_of_zero(spark):
    vocab = spark.createDataFrame(VOCAB, "piece string, id int")
    both = {"known": tk.word_tokenizer(vocab, 0), "none": tk.Tokenizer(tk.word_tokenizer(vocab, 9).encode)}
    df = spark.createDataFrame([("a b x", "c"), ("x x", None)], "s string, t string")
    rows = {r["tokenizer"]: r.asDict() for r in stx.tokenizer_stats(df, ["s", "t"], both).collect()}
    counted = {"overall_sentences": 3, "overall_tokens": 6, "overall_chars": 9}
    assert rows["known"] == {
        "tokenizer": "known", "total_unk_tokens": 3, "total_sentences_with_unk": 2, **counted,
    }
    assert rows["none"] == {
        "tokenizer": "none", "total_unk_tokens": 0, "total_sentences_with_unk": 0, **counted,
    }
    with pytest.raises(ValueError, match="train"):
        stx.tokenizer_stats({"train": df}, ["s"], both)


def test_stream_and_batch_statistics_agree(spark, tmp_path):
    vocab = spark.createDataFrame(VOCAB, "piece string, id int")
    toks = {"v": tk.word_tokenizer(vocab, 0)}
    df = spark.range(50).select(F.concat(F.lit("a x "), F.col("id").cast("string")).alias("t"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    rows = read_stream(spark, str(tmp_path / "in"), "t string", maxFilesPerTrigger=1)
    tokenizer_stats_stream(rows, ["t"], toks, "streamed").awaitTermination()
    assert spark.table("streamed").collect() == stx.tokenizer_stats(df, ["t"], toks).collect()


def test_oversized_vocabulary(spark):
    with pytest.raises(ValueError):
        tk.word_tokenizer(spark.createDataFrame(VOCAB, "piece string, id int"), max_size=2)


def test_merge_and_compare_statistics(spark):
    a = spark.createDataFrame([("x", 1000, 2.5), ("y", 1, 0.5)], "tokenizer string, n bigint, share double")
    merged = stx.merge_stats(a, a.where("tokenizer = 'x'"))
    assert {tuple(r) for r in merged.collect()} == {("x", 2000, 5.0), ("y", 1, 0.5)}
    with pytest.raises(ValueError):
        stx.merge_stats(a, a.drop("share"))
    rows = stx.compare_stats(merged, ["x", "y", "z"]).orderBy("position").collect()
    assert [tuple(r)[1:] for r in rows] == [("N", "2,000", "1", "—"), ("Share", "5.00", "0.50", "—")]
    text = stx.stats_to_json(a.where("tokenizer = 'x'")).first()["stats"]
    assert json.loads(text) == {"n": 1000, "share": 2.5}


def test_tokenize_pairs_truncates_and_drops_columns(spark):
    vocab = spark.createDataFrame(VOCAB, "piece string, id int")
    df = spark.createDataFrame([("a b c", "c b a", 1)], "s string, t string, n int")
    out = tk.tokenize_pairs(df, "s", "t", tk.word_tokenizer(vocab, 0), 2, 2)
    assert out.columns == ["input_ids", "labels"] and tuple(out.first()) == ([1, 2], [3, 2])


def test_generated_length(spark):
    df = spark.createDataFrame([([5, 0, 0],), ([5, -100, 7],)], "ids array<int>")
    unmasked = stx.unmask_labels(df, "ids", 0)
    assert stx.mean_generated_length(unmasked, "ids", 0).first()["gen_len"] == 1.5


def test_pieces_are_bounded_and_whole():
    sizes = np.array([3, 4, 0, 9, 1, 30, 2, 8])
    rows = [range(len(sizes))[r] for r in tm.bounded_pieces(sizes, 10)]
    assert [i for part in rows for i in part] == list(range(len(sizes)))
    assert all(len(part) == 1 or sizes[list(part)].sum() <= 10 for part in rows)
    assert not list(tm.bounded_pieces(np.array([], np.int64)))


def test_pairs_are_counted_in_bounded_pieces(spark):
    rng = random.Random(4)
    rows = [(i, *("".join(rng.choices("abc ", k=rng.choice((0, 5, 600)))) for _ in "ab")) for i in range(30)]
    rows += [(30, "a b a b " * 20_000, "b a " * 30_000), (31, None, "a b"), (32, "a", None)]
    pairs = spark.createDataFrame(rows, "i int, h string, r string").coalesce(1)
    for chars in (True, False):
        want = {}
        for i, h, r in rows:
            numbers = {}
            cut = (lambda t: list(t or "")) if chars else (lambda t: (t or "").split())
            sides = [[np.array([numbers.setdefault(w, len(numbers)) for w in cut(t)], np.int64)] for t in (h, r)]
            want[i] = tm.clipped_matches(*sides, 4)[0].tolist()
        got = pairs.select("i", tm.ngram_matches(F.col("h"), F.col("r"), 4, chars).alias("n")).collect()
        assert {r.i: r.n for r in got} == want


def test_clipped_matches_of_many_different_tokens():
    rng = np.random.default_rng(5)
    hyps = [rng.integers(0, 2**40, 3000), np.arange(70_000) % 65_000]
    refs = [np.concatenate([hyps[0][500:900], hyps[0][:40]]), np.arange(40_000)]

    def grams(x, n):
        return Counter(tuple(x[i : i + n].tolist()) for i in range(len(x) - n + 1))

    got = tm.clipped_matches(hyps, refs, 6).reshape(2, 6, 3)
    for row, (a, b) in enumerate(zip(hyps, refs)):
        for n in (1, 2, 6):
            x, y = grams(a, n), grams(b, n)
            assert got[row, n - 1].tolist() == [sum(x.values()), sum(y.values()), sum((x & y).values())]


@pytest.mark.parametrize("order", [1, 4])
def test_clipped_matches(order):
    rng = random.Random(4)
    sides = [[[rng.randint(0, 3) for _ in range(rng.choice((0, 1, 2, 9)))] for _ in range(40)] for _ in range(2)]
    got = tm.clipped_matches(*([np.array(x, np.int64) for x in side] for side in sides), order)

    def grams(items, n):
        return Counter(zip(*(items[i:] for i in range(n))))

    want = []
    for h, r in zip(*sides):
        row = []
        for n in range(1, order + 1):
            a, b = grams(h, n), grams(r, n)
            row += [a.total(), b.total(), (a & b).total()]
        want.append(row)
    assert got.tolist() == want
    assert tm.clipped_matches([], [], order).shape == (0, 3 * order)


def naive_bleu(rows):
    match, total, sys_len, ref_len = [0] * 4, [0] * 4, 0, 0
    for hyp, ref in rows:
        h, r = hyp.split(), ref.split()
        sys_len, ref_len = sys_len + len(h), ref_len + len(r)
        for n in range(1, 5):
            a = Counter(tuple(h[i : i + n]) for i in range(len(h) - n + 1))
            b = Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
            match[n - 1] += sum((a & b).values())
            total[n - 1] += sum(a.values())
    logs, halved = 0.0, 1.0
    for m, t in zip(match, total):
        if t == 0:
            return 0.0
        if m == 0:
            halved *= 2
        logs += math.log(100 * m / t if m else 100 / (halved * t))
    penalty = 1.0 if sys_len >= ref_len else math.exp(1 - ref_len / sys_len)
    return penalty * math.exp(logs / 4)


def bleu(spark, rows):
    df = spark.createDataFrame(rows, "p string, r string")
    return tm.corpus_bleu(df, "p", "r").first()


def test_bleu(spark):
    rnd = random.Random(4)
    words = "red green blue cyan pink".split()
    rows = [
        (" ".join(rnd.choices(words, k=rnd.randrange(1, 9))), " ".join(rnd.choices(words, k=9)))
        for _ in range(40)
    ]
    assert bleu(spark, rows)["bleu"] == pytest.approx(naive_bleu(rows))
    same = [("The cat, it sat on 3.5 mats.", "The cat, it sat on 3.5 mats. ")]
    assert bleu(spark, same)["bleu"] == pytest.approx(100)
    assert bleu(spark, same)["sys_len"] == 9
    smoothed = [("a b c d x", "a y b z c")]
    assert bleu(spark, smoothed)["bleu"] == pytest.approx(naive_bleu(smoothed))
    assert bleu(spark, [("", "a b c d")])["bleu"] == 0
    short = bleu(spark, [("a b c d", "a b c d e f g h")])
    assert short["brevity_penalty"] == pytest.approx(math.exp(-1))


def test_chrf(spark):
    def chrf(rows, **kwargs):
        df = spark.createDataFrame(rows, "p string, r string")
        return tm.corpus_chrf(df, "p", "r", **kwargs).first()["chrf"]

    assert chrf([("Guten Tag, Welt!", "Guten Tag, Welt!")]) == pytest.approx(100)
    assert chrf([("abc", "xyz")]) == 0
    # Unigrams 2/3 and 2/4, bigrams 1/2 and 1/3, trigrams 0/1 and 0/2, the rest unusable.
    p, r = (2 / 3 + 1 / 2 + 0) / 3, (2 / 4 + 1 / 3 + 0) / 3
    assert chrf([("abx", "abcd")], word_order=0) == pytest.approx(100 * 5 * p * r / (4 * p + r))


def vocab(spark, rows):
    return spark.createDataFrame(rows, vb.SCHEMA)


OLD = [(0, "<unk>", 0.0, "UNKNOWN"), (1, "▁a", -1.0, "NORMAL"), (2, "▁b", -3.0, "NORMAL")]
NEW = [
    (0, "<unk>", 0.0, "UNKNOWN"), (1, "<new>", 0.0, "CONTROL"), (2, "<tag>", 5.0, "USER_DEFINED"),
    (3, "▁a", -0.5, "NORMAL"), (4, "▁c", -2.0, "NORMAL"), (5, "<0x0A>", 0.0, "BYTE"),
]


def test_merge_vocabularies(spark):
    merged = vb.merge_vocab(vocab(spark, OLD), vocab(spark, NEW)).orderBy("id").collect()
    assert [tuple(r) for r in merged[3:]] == [
        (3, "<tag>", 0.0, "USER_DEFINED"),
        (4, "▁c", -5.0, "NORMAL"),
    ]
    assert [tuple(r) for r in merged[:3]] == OLD


def test_shrink_vocabulary(spark):
    rows = [(i, f"p{i}", s, "NORMAL") for i, s in enumerate([0.0, -2.0, -1.0, -2.0, -2.0])]
    table = vocab(spark, rows)

    def pieces(**kwargs):
        kept = vb.shrink_vocab(table, **kwargs).orderBy("id").collect()
        assert [r["id"] for r in kept] == list(range(len(kept)))
        return [r["piece"] for r in kept]

    assert pieces(target_size=2, remove_count=1) == ["p0", "p1"]
    assert pieces(remove_count=2) == ["p0", "p1", "p2"]
    assert pieces(remove_count=2, by_score=True) == ["p0", "p2", "p4"]
    with pytest.raises(ValueError):
        vb.shrink_vocab(table, remove_count=5)
    with pytest.warns(UserWarning):
        assert vb.shrink_vocab(table) is table


def test_corpus_vocabulary(spark):
    docs = spark.createDataFrame([("bb a bb 12",), ("bb a c",)], "text string")
    rows = vb.corpus_vocab(docs, "text", 7, ["<x>"]).orderBy("id").collect()
    assert [r["piece"] for r in rows] == ["<unk>", "<s>", "</s>", "<x>", "▁bb", "▁a", "1"]
    assert rows[4]["score"] == pytest.approx(math.log(3 / 9))
    with pytest.raises(ValueError):
        vb.corpus_vocab(docs, "text", 2)


def test_frequencies(spark, tmp_path):
    rows = vb.vocab_frequencies(vocab(spark, [*OLD, (3, "x", math.log(0.25), "NORMAL")]))
    assert [r["freq"] for r in rows.orderBy("id").collect()] == [367879, 49787, 250000]
    vb.write_frequencies(rows, str(tmp_path / "freq"))
    lines = {r["value"] for r in spark.read.text(str(tmp_path / "freq")).collect()}
    assert lines == {" a\t367879", " b\t49787", "x\t250000"}
    with pytest.raises(ValueError):
        vb.vocab_frequencies(rows, "bpe")


def test_diff_is_sorted(spark):
    ids = [r["id"] for r in vb.diff_vocab(vocab(spark, OLD), vocab(spark, NEW)).collect()]
    assert ids == [1, 2, 4, 5]


@pytest.mark.parametrize("hot_rows", [1, 10**9])
def test_start_vectors(spark, hot_rows):
    old = spark.createDataFrame(
        [("▁", [9.0, 9.0]), ("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "token string, vec array<float>"
    )
    parts = [("ab", 0, "a"), ("ab", 1, "b"), ("▁b", 0, "▁"), ("▁b", 1, "b"), ("▁▁", 0, "▁"), ("a", 0, "b")]
    seg = spark.createDataFrame(parts, "token string, pos int, piece string")
    tokens = seg.select("token").distinct()

    def got(df):
        return {r["token"]: r["vec"] for r in df.collect()}

    args = (tokens, old, seg)
    assert got(vt.init_vectors_mean(*args, hot_rows=hot_rows)) == {
        "ab": [0.5, 1.5], "▁b": [4.5, 6.0], "▁▁": [9.0, 9.0], "a": [1.0, 0.0],
    }
    assert got(vt.init_vectors_first(*args, hot_rows=hot_rows))["▁b"] == [9.0, 9.0]
    clear = got(vt.init_vectors_first(*args, clear_tokenization=True, hot_rows=hot_rows))
    assert clear == {"ab": [1.0, 0.0], "▁b": [0.0, 3.0], "▁▁": [9.0, 9.0], "a": [1.0, 0.0]}
    mean = got(vt.init_vectors_mean(*args, mode="mean"))
    assert mean["ab"] == pytest.approx([10 / 3, 4.0]) and mean["a"] == [1.0, 0.0]
    with pytest.raises(ValueError):
        vt.init_vectors_mean(*args, mode="median")
