import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusweave.operators import filters as fl
from corpusweave.operators.embeddings import translation_similarity

# The two number patterns.
FLOAT_BASIC = r"[+-]?\d+(?:\.\d+)?"
FLOAT_EXTENDED = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
TEXTS = ["text_1", "text_2"]


def verdicts(spark, verdict, pairs):
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "id int, text_1 string, text_2 string")
    judged = fl.with_verdict(df, verdict).orderBy("id").collect()
    return [(r["keep"], r["drop_reason"]) for r in judged]


def test_length_ratio_bounds_are_inclusive(spark):
    pairs = [("a" * 100, "b" * n) for n in (100, 179, 180, 181)]
    pairs += [("filled", ""), (None, "x"), ("x", None), ("日本語", "abc")]
    assert verdicts(spark, fl.length_ratio(TEXTS, 1.8), pairs) == [
        (True, None),
        (True, None),
        (True, None),
        (False, None),
        (False, "empty_text"),
        (False, "missing_text"),
        (False, "missing_text"),
        (True, None),
    ]


def test_length_ratio_in_words(spark):
    pairs = [("one two three four", "eins  zwei\t\n"), ("one two three", "eins"), ("a", " \t ")]
    assert verdicts(spark, fl.length_ratio(TEXTS, 2.0, "words"), pairs) == [
        (True, None),
        (False, None),
        (False, "empty_text"),
    ]


@pytest.mark.parametrize("pattern", [FLOAT_BASIC, FLOAT_EXTENDED])
def test_regex_counts_ignore_order(spark, pattern):
    pairs = [
        ("n 1 2 3", "3 1 2"),
        ("a=10 b=2.50", "a=10 b=2.51"),
        ("1 1 2", "1 2 2"),
        ("none", "nichts"),
        (None, "1"),
        ("٣ items", "٣ Dinge"),
    ]
    assert verdicts(spark, fl.regex_counter(TEXTS, pattern), pairs) == [
        (True, None),
        (False, None),
        (False, None),
        (True, None),
        (False, "missing_text"),
        (True, None),
    ]


def test_scientific_numbers_depend_on_the_pattern(spark):
    pairs = [("x 1e-3 y 2.5E+10", "x 1 -3 y 2.5 +10")]
    assert verdicts(spark, fl.regex_counter(TEXTS, FLOAT_BASIC), pairs)[0][0]
    assert not verdicts(spark, fl.regex_counter(TEXTS, FLOAT_EXTENDED), pairs)[0][0]


def test_regex_groups_follow_findall(spark):
    pairs = [("a1 b2", "a9 b8"), ("a1 b2", "b8 a1")]
    one = verdicts(spark, fl.regex_counter(TEXTS, r"([a-z])\d"), pairs)
    two = verdicts(spark, fl.regex_counter(TEXTS, r"([a-z])(\d)"), pairs)
    assert [k for k, _ in one] == [True, True]
    assert [k for k, _ in two] == [False, False]


def test_bad_arguments():
    with pytest.raises(ValueError):
        fl.length_ratio(["text"], 1.8)
    with pytest.raises(ValueError):
        fl.regex_counter(["a", "b", "c"], "x")
    with pytest.raises(ValueError):
        translation_similarity(["a", "b"], 1.5)
    with pytest.raises(ValueError):
        translation_similarity(["a"], 0.5)


def test_calc_method_is_checked(spark):
    with pytest.raises(ValueError):
        fl.length_ratio(TEXTS, 1.8, "bytes")


def test_chain_charges_the_first_step(spark):
    df = spark.createDataFrame(
        [(0, "aa 1", "bb 1"), (1, "a", "b" * 9), (2, "aa 1", "bb 2"), (3, None, "x")],
        "id int, text_1 string, text_2 string",
    )
    steps = {"length": fl.length_ratio(TEXTS, 2.0), "digits": fl.regex_counter(TEXTS, r"\d")}
    judged = fl.apply_filters(df, steps)
    rows = {r["id"]: (r["keep"], r["drop_step"], r["drop_reason"]) for r in judged.collect()}
    assert rows == {
        0: (True, None, None),
        1: (False, "length", None),
        2: (False, "digits", None),
        3: (False, "length", "missing_text"),
    }
    summary = fl.filter_summary(judged, list(steps)).orderBy("position").collect()
    assert [(r["total"], r["forwarded"], r["dropped"]) for r in summary] == [(4, 2, 2), (2, 1, 1)]


def test_similarity_is_strict_and_zero_vectors_are_dropped(spark):
    rows = [
        (0, [3.0, 4.0], [6.0, 8.0]),
        (1, [1.0, 0.0], [0.5, 0.5]),
        (2, [0.0, 0.0], [1.0, 0.0]),
        (3, None, [1.0, 0.0]),
        (4, [1.0, 0.0], [0.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, "id int, a array<float>, b array<float>")
    judged = fl.with_verdict(df, translation_similarity(["a", "b"], 0.0)).orderBy("id").collect()
    assert [r["keep"] for r in judged] == [True, True, False, False, False]
    assert judged[3]["drop_reason"] == "missing_embedding"


def test_row_wise_filters_need_no_shuffle(spark):
    df = spark.createDataFrame([("a", "b")], "text_1 string, text_2 string")
    judged = fl.apply_filters(df, {"r": fl.length_ratio(TEXTS, 2.0)}).where(F.col("keep"))
    assert "Exchange" not in judged._jdf.queryExecution().executedPlan().toString()


def test_later_steps_do_not_work_on_dropped_rows(spark):
    """A model in the second step gets nulls for what the first step has dropped."""

    @F.pandas_udf("boolean")
    def model(texts: pd.Series) -> pd.Series:
        assert not texts.dropna().str.startswith("drop").any()
        return texts.fillna("").str.len() > 3

    rows = [(1, "drop me please", 5), (2, "ok", None), (3, "keep it", 7), (4, None, 1)]
    df = spark.createDataFrame(rows, "id int, text string, keep int")
    steps = {
        "first": fl.Verdict(~F.coalesce(F.col("text"), F.lit("")).startswith("drop"), F.lit("prefix")),
        "second": fl.Verdict(model("text"), F.lit("short")),
    }
    judged = fl.apply_filters(df.drop("keep"), steps)
    assert judged.columns == ["id", "text", "keep", "drop_step", "drop_reason"]
    assert {tuple(r) for r in judged.collect()} == {
        (1, "drop me please", False, "first", "prefix"),
        (2, "ok", False, "second", "short"),
        (3, "keep it", True, None, None),
        (4, None, False, "second", "short"),
    }
