import pytest

import corpus_pipeline
from corpusweave.llm import simhash
from corpusweave.llm.decontaminate import contamination
from corpusweave.llm.queries import QUERIES
from corpusweave.llm.simhash import simhash_components
from corpusweave.plans.staging import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    """The documents after each stage, then the result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, fn in corpus_pipeline.STAGES:
        out.append(stage(fn(spark, out[-1], sf_dir), f"test-{name}"))
    return out


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_stages_keep_columns_and_rows(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "quality", "near_duplicates", "decontamination", "packing"
    ]
    whole = {r.doc_id: r for r in kept[0].collect()}
    for before, after in zip(kept[:-2], kept[1:-1]):
        assert after.columns == COLUMNS
        assert len(set(ids(after))) == len(ids(after)) and set(ids(after)) <= set(ids(before))
        assert all(r == whole[r.doc_id] for r in after.collect())


def test_labelled_documents(spark, sf_dir, kept):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    start, clean, good = (set(ids(d)) for d in kept[:3])
    assert not any(labels[i].toxic == 0 for i in start - clean if i in labels)
    assert not any(labels[i].quality == 1 for i in clean - good if i in labels)
    gone = [labels[i].quality for i in clean - good if i in labels]
    stays = [labels[i].quality for i in good if i in labels]
    assert gone and not any(gone) and sum(stays) > 0.95 * len(stays)


def test_one_of_each_group_stays(kept):
    groups = {}
    for r in simhash_components(kept[2]).collect():
        groups.setdefault(r.component, []).append(r.id)
    assert sorted(min(g) for g in groups.values()) == sorted(ids(kept[3]))


def test_no_passage_stays(spark, sf_dir, kept):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    before = {r.id for r in contamination(kept[3], bench).collect() if r.n_hit}
    assert set(ids(kept[3])) - set(ids(kept[4])) == before and before
    assert not any(r.n_hit for r in contamination(kept[4], bench).collect())


def test_pieces_of_all_that_stays(kept):
    rows = kept[5].collect()
    assert {r.doc_id for r in rows} == set(ids(kept[4]))
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 1024


def test_run_gives_the_last_stage(spark, sf_dir, kept):
    got = corpus_pipeline.run(spark, sf_dir)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, kept[5].select(*key).collect()))


def test_odd_rows_pass_every_stage(spark, sf_dir, long_text):
    rows = [
        (1, None, None, None, None), (None, "no id here", "en", "s", 10), (2, "", "en", "s", 0),
        (3, long_text, "en", "s", 1), (3, long_text, "en", "s", 1), (4, "same text", "a", "b", 1), (5, "same text", "a", "b", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, fn in corpus_pipeline.STAGES:
            docs = stage(fn(spark, docs, sf_dir), f"odd-{name}")
    extra = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], f"{schema}, row int, h0 string, score int")
    for name, fn in corpus_pipeline.STAGES[:-1]:
        assert fn(spark, extra, sf_dir).columns == extra.columns


def test_near_duplicates_by_the_fingerprints_of_the_contract(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = QUERIES["op2_simhash"](spark, sf_dir).collect()
    assert set(ids(corpus_pipeline.near_duplicates(spark, docs, sf_dir))) == {r.component_id for r in found}


def test_near_duplicates_broadcast_no_variants(spark, sf_dir, monkeypatch):
    plans = {}

    def seen(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, label)

    monkeypatch.setattr(simhash, "stage", seen)
    corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    for label in ("simhash-members", "simhash-links"):
        assert "SortMergeJoin" in plans[label] and "Broadcast" not in plans[label]
