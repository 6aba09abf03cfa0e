import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import catalog
from corpusweave.operators import minhash as mh
from corpusweave.operators import pivot_cells as pivots
from corpusweave.operators import sentences as st
from corpusweave.operators import similarity as sim
from corpusweave.operators.pivot_cells import pivot_cells
from corpusweave.plans import jobs
from corpusweave.plans.staging import stage

BASE = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_minhash_keeps_the_first_of_a_cluster(spark):
    edited = BASE.replace("wordcc", "changed")
    other = " ".join(f"else{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))
    texts = ["too short text", BASE, other, BASE.upper() + "!!", edited, "too short text", ""]
    kept, removed = mh.minhash_dedup(docs(spark, texts), "doc_id", "text")
    assert {r["doc_id"] for r in kept.collect()} == {0, 1, 2, 5, 6}
    gone = {r["doc_id"]: r["token_count"] for r in removed.collect()}
    assert gone == {3: 120, 4: 120}


def test_minhash_with_a_hot_group_of_copies(spark):
    rnd, letters = random.Random(1), "abcdefghijkl"

    def text(i):
        return " ".join("".join(rnd.choices(letters, k=6)) for _ in range(20)) if i % 3 else BASE

    table = docs(spark, [text(i) for i in range(300)])
    config = mh.MinhashConfig(hot_rows=20, hash_fc="xxhash")
    kept, removed = mh.minhash_dedup(table, "doc_id", "text", config)
    assert kept.count() == 201 and removed.count() == 99
    assert kept.where("doc_id = 0").count() == 1


def test_minhash_arguments():
    with pytest.raises(ValueError):
        mh.MinhashConfig(hash_fc="md5")
    with pytest.raises(ValueError):
        mh.MinhashConfig(precision=16)


@pytest.mark.parametrize("precision", [32, 64])
def test_signatures_of_any_tiles(spark, monkeypatch, precision):
    """Minima do not depend on the tiles; copies and repeats change nothing."""
    texts = [BASE, BASE + " " + BASE, "a b c d", " ".join(BASE.split()[3:50]), BASE]
    config = mh.MinhashConfig(precision=precision, hash_fc="xxhash")
    found = []
    for tile in (1, 500, 1 << 20):
        monkeypatch.setattr(mh, "TILE", tile)
        rows = mh.minhash_signatures(docs(spark, texts).coalesce(1), "doc_id", "text", config).collect()
        found.append({r["doc_id"]: r["signature"] for r in rows})
    assert found[0] == found[1] == found[2] and set(found[0]) == {0, 1, 3, 4}
    assert found[0][0] == found[0][4] and min(found[0][0]) >= 0


def test_null_texts_stay(spark):
    table = docs(spark, ["same line", None, "same line", ""])
    out = st.sentence_dedup(table, "doc_id", "text", config=st.SentenceConfig(min_doc_words=1))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: "same line", 1: None}


def job(tmp_path, **options):
    reader = {"type": "json", "kwargs": {"data_folder": str(tmp_path / "in"), "id_key": "doc_id"}}
    writer = {"type": "json", "kwargs": {"output_folder": str(tmp_path / f"out-{len(options)}")}}
    reader["kwargs"] |= options.pop("reading", {})
    writer["kwargs"] |= options.pop("writing", {})
    return {"reader": reader, "writer": writer, "use_column_info_adapter": True} | options


@pytest.mark.parametrize(
    "options",
    [
        {"hash_config": {"hash_fc": "sha1", "seed": 3}},
        {"hash_config": {"precision": 16}},
        {"writing": {"output_filename": "x_${page}.jsonl"}},
        {"reading": {"adapter": print}},
        {"minhash_config": {"buckets": 3}},
    ],
)
def test_options_that_cannot_be_honoured_raise(spark, tmp_path, options):
    docs(spark, [BASE]).write.json(str(tmp_path / "in"))
    with pytest.raises((ValueError, TypeError)):
        jobs.run_minhash_job(spark, job(tmp_path, **options))


def test_limit_and_skip_of_a_reader(spark, tmp_path):
    table = docs(spark, [f"{BASE} {chr(97 + i) * 9}" for i in range(10)]).coalesce(1)
    table.write.json(str(tmp_path / "in"))
    for k, (reading, want) in enumerate([({"limit": 3, "skip": 2}, 3), ({"limit": -1}, 10), ({"skip": 4}, 6)]):
        cfg = job(tmp_path, reading=reading | {"shuffle_files": False}, language="rus_Cyrl", hash_config={"precision": 64})
        cfg["writer"]["kwargs"]["output_folder"] = str(tmp_path / f"limited-{k}")
        cfg["minhash_config"] = {"n_grams": 200}
        jobs.run_minhash_job(spark, cfg)
        assert spark.read.json(str(tmp_path / f"limited-{k}")).count() == want


LINES = [
    "Header line\nfirst body\n\nfooter",
    "header LINE!\nsecond body\n\nsecond body",
    "footer\nHeader line",
    "",
    "alone",
]


def test_repeated_lines_go_and_emptied_documents_with_them(spark):
    out = st.sentence_dedup(docs(spark, LINES), "doc_id", "text")
    assert {r["doc_id"]: (r["text"], r["token_count"]) for r in out.collect()} == {
        0: (LINES[0], 5),
        1: ("second body\n", 6),
        4: ("alone", 1),
    }


@pytest.mark.parametrize("hot_rows", [1, 10**9])
def test_hot_lines_give_the_same_positions(spark, hot_rows):
    config = st.SentenceConfig(hot_rows=hot_rows)
    signatures = st.sentence_signatures(docs(spark, LINES), "doc_id", "text", config)
    found = st.find_duplicate_sentences(signatures, "doc_id", config=config)
    assert {tuple(r) for r in found.collect()} == {(1, 0), (1, 3), (2, 0), (2, 1)}


def test_index_only_or_index_and_corpus(spark):
    index = docs(spark, ["Footer", "unseen"])
    for only, expected in ((True, {(0, 3), (2, 0)}), (False, {(0, 3), (1, 0), (1, 3), (2, 0), (2, 1)})):
        config = st.SentenceConfig(only_dedup_in_index=only)
        signatures = st.sentence_signatures(docs(spark, LINES), "doc_id", "text", config)
        listed = st.sentence_signatures(index, "doc_id", "text", config)
        found = st.find_duplicate_sentences(signatures, "doc_id", listed, config)
        assert {tuple(r) for r in found.collect()} == expected


def test_windows_and_minimum_sizes(spark):
    texts = ["a b\nc d\ne f", "x y\na b\nc d\nz", "c d\nq r"]
    config = st.SentenceConfig(n_sentences=2)
    out = st.sentence_dedup(docs(spark, texts), "doc_id", "text", config=config)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: texts[0], 1: "x y\nz", 2: texts[2]}
    for extra in ({"min_doc_words": 4}, {"min_num_sentences": 3}):
        config = st.SentenceConfig(n_sentences=2, **extra)
        out = st.sentence_dedup(docs(spark, texts), "doc_id", "text", config=config)
        assert {r["doc_id"] for r in out.collect()} == {0, 2}


def test_split_into_sentences(spark):
    texts = ["One is here. Two is there! Three?", "Two is there. New one."]
    config = st.SentenceConfig(split_sentences=True)
    out = st.sentence_dedup(docs(spark, texts), "doc_id", "text", config=config)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: texts[0], 1: "New one."}


def naive_greedy(matrix, threshold):
    scores, keep = matrix @ matrix.T, []
    for i in range(len(matrix)):
        if not any(scores[i, j] > threshold for j in keep):
            keep.append(i)
    return keep


def vectors(spark, matrix):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")


def cloud(n, seed, copies=()):
    rng = np.random.default_rng(seed)
    matrix = rng.normal(size=(n, 6)) * rng.uniform(0.3, 1.3, size=(n, 1)) / 2
    for i, j in copies:
        matrix[j] = matrix[i]
    return matrix


COPIES = [(3, 9), (3, 40), (10, 11), (0, 59)]


@pytest.mark.parametrize(
    "seed, threshold, rounds, scan_pairs",
    [(1, 0.8, 8, 99), (2, 0.2, 8, 0), (3, 0.5, 0, 10**6), (4, 0.4, 1, 10**6), (5, -0.1, 0, 5), (6, 0.0, 2, 3)],
)
def test_greedy_removal_equals_the_scan(spark, seed, threshold, rounds, scan_pairs):
    matrix = cloud(60, seed, COPIES)
    got = sim.greedy_dedup(
        vectors(spark, matrix), "vec_id", "embedding", threshold, block_rows=7, cell_rows=9,
        rounds=rounds, scan_pairs=scan_pairs,
    )
    assert sorted(r["vec_id"] for r in got.collect()) == naive_greedy(matrix, threshold)


def test_greedy_removal_of_a_chain(spark):
    angles = np.arange(12) * 0.3
    matrix = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    got = sim.greedy_dedup(
        vectors(spark, matrix), "vec_id", "embedding", 0.95, block_rows=5, rounds=2
    )
    assert sorted(r["vec_id"] for r in got.collect()) == [0, 2, 4, 6, 8, 10]


def test_greedy_removal_with_a_hot_group(spark):
    rng = np.random.default_rng(0)
    matrix = rng.normal(size=(90, 24))
    matrix[::3] = matrix[0] + rng.normal(size=(30, 24)) * 1e-3
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    got = sim.greedy_dedup(
        vectors(spark, matrix), "vec_id", "embedding", 0.9, block_rows=20, cell_rows=10
    )
    assert sorted(r["vec_id"] for r in got.collect()) == [0, *(i for i in range(90) if i % 3)]


def test_zero_vectors_have_no_neighbours(spark):
    matrix = np.zeros((4, 3))
    got = sim.greedy_dedup(vectors(spark, matrix), "vec_id", "embedding", 0.5)
    assert sorted(r["vec_id"] for r in got.collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("threshold", [0.95, 0.7, 0.3, 0.0, -0.2])
@pytest.mark.parametrize("cell_rows, block_rows, max_pivots", [(10, 4, 1024), (25, 100, 1024), (1000, 1000, 1024), (4, 9, 5)])
def test_pivot_cells_find_every_pair(spark, threshold, cell_rows, block_rows, max_pivots):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 5))
    matrix = centres[rng.integers(0, 6, 70)] + rng.normal(size=(70, 5)) * 0.3
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix *= rng.uniform(0.6, 1.2, size=(70, 1))
    matrix[13] = 0
    got = sim.similarity_join(
        vectors(spark, matrix), "vec_id", "embedding", threshold, block_rows, cell_rows=cell_rows,
        max_pivots=max_pivots,
    )
    pairs = [(r["src"], r["dst"]) for r in got.collect()]
    scores = matrix @ matrix.T
    assert sorted(pairs) == [(i, j) for i in range(70) for j in range(i + 1, 70) if scores[i, j] > threshold]


def test_cells_prune(spark):
    # Tight clusters far from each other: hardly any row leaves its cell.
    rng = np.random.default_rng(2)
    matrix = np.repeat(np.eye(16), 20, axis=0) + rng.normal(size=(320, 16)) * 0.01
    rows = vectors(spark, matrix).select(
        "vec_id", "embedding"
    ).toDF("n", "vec")
    before = sim._cell_pairs
    seen = {}

    def counted(placed, visits, *rest):
        seen["visits"] = 0 if visits is None else visits.count()
        return before(placed, visits, *rest)

    sim._cell_pairs = counted
    try:
        assert sim.exact_pairs(rows, 320, 0.9, 64, cell_rows=8).count() == 16 * 190
    finally:
        sim._cell_pairs = before
    assert seen["visits"] < 320 * 6


def test_visits_follow_the_rows_in_two_levels(spark):
    rng = np.random.default_rng(2)
    per_row = {}
    for copies in (20, 200):
        n = 16 * copies
        matrix = np.repeat(np.eye(16), copies, axis=0) + rng.normal(size=(n, 16)) * 0.01
        rows = vectors(spark, matrix).toDF("n", "vec")
        placed, visits = pivot_cells(rows, n, 0.9, cell_rows=copies // 2, max_pivots=8)
        assert placed.count() == n and placed.select("cell").distinct().count() > 20
        per_row[n] = visits.count() / n
    # Ten times the rows in as many cells: a row visits no more cells than before, give or take.
    print(per_row)
    assert per_row[3200] < 1.3 * per_row[320]


def test_a_long_chain_is_decided_in_few_rounds(spark):
    n = 60_000
    edges = stage(spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), "chain")
    dropped = sim._drop_later_neighbours(edges, n - 1, rounds=1, scan_pairs=25_000, max_rounds=8)
    assert sorted(r.n for r in dropped.collect()) == list(range(1, n, 2))


def test_projected_buckets_give_true_pairs(spark):
    matrix = cloud(60, 3)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    scores = matrix @ matrix.T
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if scores[i, j] > 0.8}
    table = vectors(spark, matrix)
    for options, least in (({"tables": 24, "bits": 2}, 1.0), ({"tables": 4, "bits": 6}, 0.3)):
        got = sim.similarity_join(table, "vec_id", "embedding", 0.8, 16, index="projections", **options)
        pairs = [(r["src"], r["dst"]) for r in got.collect()]
        assert len(set(pairs)) == len(pairs) and set(pairs) <= want
        assert len(pairs) >= least * len(want)
    with pytest.raises(ValueError):
        sim.similarity_join(table, "vec_id", "embedding", index="flat")


def test_ids_of_any_ordered_type(spark):
    matrix = cloud(40, 8, COPIES[:1])
    rows = [(f"v{i:03d}", [float(x) for x in v]) for i, v in enumerate(matrix)]
    table = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    got = sim.greedy_dedup(table, "vec_id", "embedding", 0.4, block_rows=9, cell_rows=10)
    assert sorted(r["vec_id"] for r in got.collect()) == [f"v{i:03d}" for i in naive_greedy(matrix, 0.4)]
    pairs = sim.similarity_join(table, "vec_id", "embedding", 0.4, cell_rows=10)
    assert all(r["src"] < r["dst"] for r in pairs.collect())
    best = sim.nearest(table, table, "vec_id", "embedding", block_rows=8)
    assert best.where("src = dst").count() >= 38


def test_similarity_join_lists_copies_once(spark):
    matrix = cloud(40, 7, [(2, 5), (2, 8)])
    matrix[2] = matrix[5] = matrix[8] = [1, 0, 0, 0, 0, 0]
    got = sim.similarity_join(vectors(spark, matrix), "vec_id", "embedding", 0.4, block_rows=9)
    pairs = {(r["src"], r["dst"]) for r in got.collect()}
    scores = matrix @ matrix.T
    distinct = [i for i in range(40) if i not in (5, 8)]
    expected = {(i, j) for i in distinct for j in distinct if i < j and scores[i, j] > 0.4}
    assert pairs == expected | {(2, 5), (2, 8)}


def every_pair(ids, matrix, threshold):
    """Pairs of rows with different ids, as often as there are rows."""
    scores = matrix @ matrix.T
    some = range(len(ids))
    return sorted((ids[i], ids[j]) for i in some for j in some if ids[i] < ids[j] and scores[i, j] > threshold)


@pytest.mark.parametrize("sent", [0, 100_000])
@pytest.mark.parametrize("index, options", [("exact", {"cell_rows": 10}), ("projections", {"tables": 40, "bits": 1})])
def test_similarity_join_of_all_copies(spark, monkeypatch, index, options, sent):
    monkeypatch.setattr(sim, "PART_IDS", 3)
    monkeypatch.setattr(sim, "SENT_IDS", sent)
    matrix = cloud(60, 7)
    matrix[[2, 5, 8, 9, 11, 12, 13, 40, 41]] = [1, 0, 0, 0, 0, 0]
    matrix[[3, 30]] = [0.1, 0.1, 0, 0, 0, 0]
    matrix[[4, 31]] = 0
    matrix[50:52] = matrix[20]
    plain = list(range(60))
    # Ids of several rows: of equal vectors, and of different ones.
    for ids in (plain, [7 if i in (5, 8, 20, 33) else i for i in plain], [f"v{i:03d}" for i in plain]):
        kind = "string" if isinstance(ids[0], str) else "int"
        rows = [(k, [float(x) for x in v]) for k, v in zip(ids, matrix)] + [(None, [1.0] * 6), (ids[1], None)]
        table = spark.createDataFrame(rows, f"vec_id {kind}, embedding array<double>")
        got = sim.similarity_join(table, "vec_id", "embedding", 0.4, 9, index=index, copies="all", **options)
        assert [t for _, t in got.dtypes] == [kind, kind, "double"]
        assert sorted((r.src, r.dst) for r in got.collect()) == every_pair(ids, matrix, 0.4)


@pytest.mark.parametrize("name", ["similarity_join", "similarity_join_projected"])
def test_similarity_join_queries_list_copies_as_their_sql(spark, tmp_path, name):
    catalog.load()
    rng = np.random.default_rng(5)
    matrix = rng.standard_normal((40, 8))
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix[30:36], matrix[36:38] = matrix[0], matrix[1]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(matrix)]
    table = spark.createDataFrame([*rows, rows[3]], "vec_id bigint, embedding array<float>, label int")
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(catalog.SQL[name]).fetchall()
    got = catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert {(30, 31), (30, 35), (36, 37)} <= {r[:2] for r in want}
    assert sorted((r.src, r.dst) for r in got) == sorted(r[:2] for r in want)
    assert np.allclose(sorted(r.score for r in got), sorted(r[2] for r in want), atol=2e-6)


@pytest.mark.parametrize("rows, columns", [(1, 1), (7, 5), (256, 4096)])
def test_scan_in_tiles(rows, columns):
    for seed, threshold in ((1, 0.5), (2, -0.2), (3, 0.0)):
        matrix = cloud(60, seed, COPIES).astype(np.float32)
        keep = sim.greedy_scan(matrix, threshold, rows, columns)
        assert np.flatnonzero(keep).tolist() == naive_greedy(matrix.astype(np.float64), threshold)
    assert sim.greedy_scan(np.empty((0, 0)), 0.5).tolist() == []


def test_batches_and_second_pass(spark):
    matrix = cloud(70, 9, COPIES)
    table, t = vectors(spark, matrix), 0.5
    first = []
    for start in range(0, 70, 20):
        first += [start + i for i in naive_greedy(matrix[start : start + 20], t)]
    got = sim.batched_dedup(table, "vec_id", "embedding", t, batch_size=20)
    assert sorted((r["vec_id"], r["batch"]) for r in got.collect()) == [(i, i // 20) for i in first]
    second = [first[i] for i in naive_greedy(matrix[first], t)]
    both = sim.two_pass_dedup(table, "vec_id", "embedding", t, batch_size=20, block_rows=11)
    assert sorted(r["vec_id"] for r in both.collect()) == second
    once = sim.two_pass_dedup(table, "vec_id", "embedding", t, batch_size=100)
    assert sorted(r["vec_id"] for r in once.collect()) == naive_greedy(matrix, t)
    with pytest.raises(ValueError):
        sim.two_pass_dedup(table.limit(0), "vec_id", "embedding")


@pytest.mark.parametrize("seed, zeros, cell_rows", [(1, False, 8), (2, True, 8), (3, False, 500), (4, True, 3)])
def test_nearest_equals_brute_force(spark, seed, zeros, cell_rows):
    rng = np.random.default_rng(seed)
    source, target = rng.normal(size=(50, 4)), rng.normal(size=(60, 4))
    target[7], target[30] = target[31], 3 * target[9]
    source[5], source[6] = target[31] / 2, source[8]
    if zeros:
        source[0] = target[2] = target[40] = 0
        target[50:] = 0
    a, b = vectors(spark, source), vectors(spark, target)
    got = sorted(map(tuple, sim.nearest(a, b, "vec_id", "embedding", 7, cell_rows=cell_rows).collect()))
    with np.errstate(invalid="ignore"):
        unit = [np.nan_to_num(m / np.linalg.norm(m, axis=1, keepdims=True)) for m in (source, target)]
    scores = np.round(unit[0] @ unit[1].T, 9)
    assert [(s, d) for s, d, _ in got] == list(enumerate(scores.argmax(axis=1).tolist()))
    assert np.allclose([x for *_, x in got], scores.max(axis=1))


def test_nearest_without_rows(spark):
    some, none = vectors(spark, cloud(3, 1)), vectors(spark, cloud(0, 1))
    assert sim.nearest(some, none, "vec_id", "embedding").count() == 0
    assert sim.nearest(none, some, "vec_id", "embedding").count() == 0
    assert sim.similarity_join(none, "vec_id", "embedding", 0.5).count() == 0
    assert sim.greedy_dedup(none, "vec_id", "embedding", 0.5).count() == 0
    zero = vectors(spark, np.zeros((2, 3)))
    assert [tuple(r) for r in sim.nearest(zero, zero, "vec_id", "embedding").orderBy("src").collect()] == [
        (0, 0, 0.0), (1, 0, 0.0)
    ]


def test_nearest_prefers_the_smallest_id(spark):
    matrix = cloud(30, 12)
    matrix[4] = matrix[20] * 2
    table = vectors(spark, matrix)
    got = sim.nearest(table, table, "vec_id", "embedding", block_rows=8)
    best = {r["src"]: r["dst"] for r in got.collect()}
    assert best[20] == 4 and best[4] == 4
    assert all(best[i] == i for i in range(30) if i != 20)


def test_retrieval_accuracy(spark):
    rows = [(0, [1.0, 0.0], [1.0, 0.1]), (1, [0.0, 1.0], [0.9, 0.2]), (2, [-1.0, 0.0], [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, s array<double>, t array<double>")
    got = sim.translation_retrieval_accuracy(df, "id", "s", "t")
    assert {r["way"]: round(r["accuracy"], 6) for r in got.collect()} == {
        "src2trg": 1.0,
        "trg2src": round(2 / 3, 6),
    }


def test_signatures_are_not_shuffled(spark):
    many_files = docs(spark, [BASE]).union(docs(spark, [BASE]))
    plan = mh.minhash_signatures(many_files, "doc_id", "text")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_visits_are_never_broadcast(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(120)]
    vectors = spark.createDataFrame(rows, "n bigint, vec array<double>")
    for most in (1024, 4):
        _, visits = pivot_cells(vectors, 120, 0.3, cell_rows=8, max_pivots=most)
        assert visits.count()
        plan = visits._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [n#" in plan and "BroadcastHashJoin [n#" not in plan


def counted(df, accumulator):
    """``df`` with the rows that are computed added up."""

    def rows(batches):
        for batch in batches:
            accumulator.add(batch.num_rows)
            yield batch

    return df.mapInArrow(rows, df.schema)


def test_signatures_are_computed_once(spark):
    texts = ["one two three four five six", "one two three four five six", "a b c d e f g"]
    seen = spark.sparkContext.accumulator(0)
    signatures = counted(mh.minhash_signatures(docs(spark, texts), "doc_id", "text").repartition(2), seen)
    assert [tuple(r) for r in mh.minhash_buckets(signatures, "doc_id").collect()] == [(0, 1)]
    assert seen.value == 3


@pytest.mark.parametrize("with_index", [False, True])
def test_line_signatures_are_computed_once(spark, with_index):
    seen = spark.sparkContext.accumulator(0)
    config = st.SentenceConfig(only_dedup_in_index=False)
    signatures = counted(st.sentence_signatures(docs(spark, ["a\nb", "a", "c"]), "doc_id", "text"), seen)
    index = st.sentence_signatures(docs(spark, ["c"]), "doc_id", "text") if with_index else None
    found = st.find_duplicate_sentences(signatures, "doc_id", index, config)
    assert {tuple(r) for r in found.collect()} == {(1, 0), (2, 0)} if with_index else {(1, 0)}
    assert seen.value == 4


def scanned(matrix, threshold):
    kept = []
    for i, row in enumerate(matrix):
        if not any(row @ matrix[k] > threshold for k in kept):
            kept.append(i)
    return kept


@pytest.mark.parametrize("scan_pairs", [0, 50, 10**6])
def test_prefixes_settle_rows_before_pairs_are_looked_for(spark, monkeypatch, scan_pairs):
    monkeypatch.setattr(sim, "PLAIN_ROWS", 20)
    matrix = np.random.default_rng(3).standard_normal((300, 6))
    matrix[200:] *= 0.3
    found = []
    before = sim._cell_pairs
    monkeypatch.setattr(sim, "_cell_pairs", lambda *a: found.append(a[0].count()) or before(*a))
    got = sim.greedy_dedup(vectors(spark, matrix), "vec_id", "embedding", 0.9, scan_pairs=scan_pairs, cell_rows=9)
    assert sorted(r.vec_id for r in got.collect()) == scanned(matrix, 0.9)
    assert sum(found) < 150


def test_rows_without_neighbours_leave_the_prefixes(spark, monkeypatch):
    monkeypatch.setattr(sim, "PLAIN_ROWS", 8)
    matrix = np.eye(60) * 2
    matrix[50:] = matrix[:10] + 0.01
    got = sim.greedy_dedup(vectors(spark, matrix), "vec_id", "embedding", 3.0)
    assert sorted(r.vec_id for r in got.collect()) == list(range(50))


@pytest.mark.parametrize("index, options", [("exact", {"cell_rows": 4}), ("projections", {"tables": 6, "bits": 1})])
def test_rows_that_no_bound_keeps_apart_travel_once_per_block(spark, monkeypatch, index, options):
    matrix = np.random.default_rng(4).standard_normal((120, 8))
    table = vectors(spark, matrix)
    want = sim.similarity_join(table, "vec_id", "embedding", 0.5, 30, index=index, **options)
    want = {(r.src, r.dst): round(r.score, 6) for r in want.collect()}
    travelled = []
    before = sim._cell_pairs
    monkeypatch.setattr(sim, "PLAIN_ROWS", 50)
    monkeypatch.setattr(sim, "_cell_pairs", lambda p, v, *a: travelled.append((p.count(), v)) or before(p, v, *a))
    got = sim.similarity_join(table, "vec_id", "embedding", 0.5, 30, index=index, **options).collect()
    assert len(got) == len(want) and {(r.src, r.dst): round(r.score, 6) for r in got} == want
    assert travelled == [(120, None)]


def test_nearest_rows_in_wide_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    left, right = rng.standard_normal((90, 7)), rng.standard_normal((110, 7))
    cosines = (left / np.linalg.norm(left, axis=1)[:, None]) @ (right / np.linalg.norm(right, axis=1)[:, None]).T
    sizes = []
    before = pivots._best_of_cells
    monkeypatch.setattr(pivots, "_best_of_cells", lambda a, b, n: sizes.append(n) or before(a, b, n))
    monkeypatch.setattr(sim, "BLOCK_ROWS", 5)
    monkeypatch.setattr(sim, "WIDE_ROWS", 40)
    got = sim.nearest(vectors(spark, left), vectors(spark, right), "vec_id", "embedding", cell_rows=5)
    assert {r.src: r.dst for r in got.collect()} == dict(enumerate(cosines.argmax(axis=1)))
    assert sizes == [5, 40]
