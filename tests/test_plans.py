import os
import pathlib
import random
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusweave import ship_package
from corpusweave.operators import sampling as sm
from corpusweave.operators.components import connected_components
from corpusweave.operators.ranges import compress_ranges, expand_ranges, flat_ranges_to_table
from corpusweave.operators.ranges import ids_to_mask, ranges_to_mask
from corpusweave.plans import partitions, staging
from corpusweave.plans.ordering import first_by_hash, first_by_key, with_row_index
from corpusweave.plans.skew import join_facts


def hot_table(spark):
    """A third of the rows share one key."""
    return spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), "id"
    )


@pytest.mark.parametrize("hot_rows", [100, 10**9])
def test_facts_reach_every_row_once(spark, hot_rows):
    rows = hot_table(spark)
    facts = rows.groupBy("k").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    joined = join_facts(rows, facts.where("n > 1"), ["k"], "n", ["least"], hot_rows)
    got = joined.groupBy("least").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"))
    assert {(r["least"], r["n"], r["d"]) for r in got.collect()} == {
        (0, 3000, 3000),
        (None, 6000, 6000),
    }


def test_more_hot_keys_than_are_broadcast(spark):
    rows = spark.range(3000).select((F.col("id") % 10).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    got = join_facts(rows, facts, ["k"], "n", ["least"], hot_rows=20, hot_keys=3).collect()
    assert len(got) == 3000 and all(r["least"] == r["k"] == r["id"] % 10 for r in got)


@pytest.mark.parametrize("n", [1, 7, 400, 999, 1000])
def test_edges_are_found_in_several_steps(spark, n):
    ids = random.Random(1).sample(range(-(10**17), 10**17), 1000)
    df = spark.createDataFrame([(i, f"k{i}") for i in ids], "id bigint, name string")
    least = sorted(ids)[:n]
    assert sorted(r["id"] for r in df.where(first_by_key(df, "id", n, bins=3)).collect()) == least
    names = sorted(f"k{i}" for i in ids)[:n]
    assert sorted(r["name"] for r in df.where(first_by_key(df, "name", n)).collect()) == names
    few, many = (df.where(first_by_hash(df, "id", n, 5, edge_rows=e)).collect() for e in (1, 10**6))
    assert sorted(few) == sorted(many) and len(few) == n


def test_hot_rows_are_spread_by_the_salt(spark):
    rows = hot_table(spark)
    facts = rows.groupBy("k").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    joined = join_facts(rows, facts, ["k"], "n", ["least"], 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plan = joined._jdf.queryExecution().executedPlan().toString()
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    partitionings = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert sum("_salt" in line for line in partitionings) == 2
    assert max(r["count"] for r in sizes) < 2000


def test_row_index_is_the_global_position(spark):
    ids = random.Random(3).sample(range(100_000), 5000)
    df = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(7)
    got = {r["id"]: r["row_index"] for r in with_row_index(df, ["id"]).collect()}
    assert got == {v: i for i, v in enumerate(sorted(ids))}


@pytest.mark.parametrize("n", [0, 1, 499, 1000, 1500])
def test_first_rows_have_the_asked_number(spark, n):
    df = spark.range(1000)
    assert df.where(first_by_hash(df, "id", n, 42)).count() == min(n, 1000)
    assert sorted(r["id"] for r in df.where(first_by_key(df, "id", n)).collect()) == list(
        range(min(n, 1000))
    )


def test_splits_are_exact_disjoint_and_reproducible(spark):
    df = spark.range(101)
    train, test = sm.train_test_split(df, "id", 0.2)
    again = sm.train_test_split(df.repartition(5), "id", 0.2)[1]
    a, b = ({r["id"] for r in part.collect()} for part in (train, test))
    assert len(b) == 21 and not a & b and len(a | b) == 101
    assert b == {r["id"] for r in again.collect()}
    other = {r["id"] for r in sm.train_test_split(df, "id", 0.2, seed=1)[1].collect()}
    assert b != other


def test_sampling_arguments(spark):
    df = spark.range(10)
    for kwargs in ({}, {"num_samples": 1, "ratio": 0.5}, {"num_samples": 11}):
        with pytest.raises(ValueError):
            sm.sample_rows(df, "random", "id", **kwargs)
    with pytest.raises(ValueError):
        sm.sample_rows(df, "sorted", "id", num_samples=1)
    assert [r["id"] for r in sm.sample_rows(df, "sequential", "id", ratio=0.39).collect()] == [0, 1, 2]


def test_eval_split_choices(spark):
    splits = {"train": spark.range(10), "validation": spark.range(3)}
    assert sm.select_eval_split(splits, "id", eval_split="validation")[1].count() == 3
    assert sm.select_eval_split(splits, "id", eval_data={"train": spark.range(4)})[1].count() == 4
    assert sm.select_eval_split(splits, "id", test_size=0.5)[1].count() == 5
    with pytest.raises(ValueError):
        sm.select_eval_split(splits, "id")


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in parent}


GRAPHS = {
    "chain": [(i, i + 1) for i in range(40)],
    "reversed chain": [(i + 1, i) for i in range(40)],
    "hub": [(500, i) for i in range(300)] + [(600, i) for i in range(700, 720)],
    "random": [(r.randrange(300), r.randrange(300)) for r in [random.Random(5)] for _ in range(150)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components_equal_union_find(spark, name):
    edges = GRAPHS[name]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = connected_components(df, "a", "b", hot_rows=50)
    expected = union_find([e for e in edges if e[0] != e[1]])
    assert {r["node"]: r["component"] for r in got.collect()} == expected


def test_ranges_round_trip(spark):
    rnd = random.Random(11)
    groups = {g: sorted(rnd.choices(range(60), k=rnd.randrange(1, 50))) for g in range(20)}
    df = spark.createDataFrame([(g, i) for g, ids in groups.items() for i in ids], "g int, id int")
    runs = compress_ranges(df, "id", ["g"]).collect()
    for g, ids in groups.items():
        own = sorted((r["start"], r["end"]) for r in runs if r["g"] == g)
        assert sorted(i for s, e in own for i in range(s, e + 1)) == sorted(set(ids))
        assert all(later[0] > earlier[1] + 1 for earlier, later in zip(own, own[1:]))


def test_range_masks_are_clamped(spark):
    ranges = flat_ranges_to_table(spark, [-5, 1, 4, 3, 7, 99])
    assert sorted(r["id"] for r in expand_ranges(ranges, 10).collect()) == [0, 1, 7, 8, 9]
    mask = {r["id"]: r["member"] for r in ranges_to_mask(ranges, 10).collect()}
    assert mask == {i: i in (0, 1, 7, 8, 9) for i in range(10)}
    ids = spark.createDataFrame([(2,), (2,), (4,)], "id int")
    assert [r["member"] for r in ids_to_mask(ids, 5).orderBy("id").collect()] == [
        False, False, True, False, True,
    ]
    with pytest.raises(ValueError):
        flat_ranges_to_table(spark, [1, 2, 3])


def test_long_ranges_are_cut(spark):
    df = spark.createDataFrame([(0, 10**6)], "start bigint, end bigint")
    assert expand_ranges(df, 10**9).count() == 10**6 + 1


def test_only_small_input_is_spread(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a folder")
    spark.range(100).coalesce(1).write.parquet(path)
    cores = spark.sparkContext.defaultParallelism

    def parts():
        df = partitions.spread(spark.read.parquet(path).where("id >= 0"))
        assert df.count() == 100
        return df.rdd.getNumPartitions()

    assert parts() == 2 * cores
    monkeypatch.setattr(partitions, "BYTES_PER_CORE", 1)
    assert parts() == 1
    assert partitions.spread(spark.range(5)).rdd.getNumPartitions() == cores


WITHOUT_FOLDER = """
import pathlib, sys
from pyspark.sql import SparkSession
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from corpusweave.plans import staging
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
try:
    staging.shared_root(spark)
except RuntimeError as error:
    assert "spark.checkpoint.dir" in str(error)
else:
    raise AssertionError("no folder was asked for")
rows = entry.queries()["minhash_clusters"](spark, {sf_dir!r}).count()
table = staging.stage(spark.range(3), "three")
assert rows and table.count() == 3
staging.remove(table, spark.range(1))
left = [str(p) for p in pathlib.Path(staging.shared_root(spark).removeprefix("file:")).iterdir()]
assert left and not any("three" in p for p in left), left
"""


def test_written_tables_need_a_folder(sf_dir, tmp_path):
    """The library asks for one; the registered queries name one on a single machine."""
    repo = str(pathlib.Path(__file__).resolve().parents[1])
    code = WITHOUT_FOLDER.format(repo=repo, sf_dir=sf_dir)
    # An empty folder of settings, in case the installation has some.
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True
    )
    assert done.returncode == 0, done.stderr[-2000:]


def test_python_workers_get_batches_of_bounded_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    ship_package(spark)
    texts = spark.range(0, 8000, 1, 1).select(F.repeat(F.lit("x"), 3000).alias("text"))
    got = [r.n for r in texts.mapInArrow(sizes, "n bigint").collect()]
    assert sum(got) >= 24_000_000 and max(got) <= 5 << 20
    lengths = texts.select(F.pandas_udf(lambda t: t.map(lambda _: len(t)), "int")("text").alias("n"))
    assert lengths.agg(F.max("n")).first()[0] < 2000
