import hashlib
import math

import numpy as np
import pytest

from corpusweave.llm.clustering import Heaps, cluster_vectors, nearest_with_gap, squared_distances


def plain(rows, clusters, rounds, dim, scale=256):
    """Every vector against every centroid in every round, in Python's integers."""
    kept = [
        (i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)
    ]
    def start(r):
        text = f"2:{'' if r[0] is None else r[0]}"
        return hashlib.sha256(text.encode()).hexdigest(), r[1]

    cents = [v for _, v in sorted(kept, key=start)[:clusters]]

    def place(v):
        away = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
        return away.index(min(away)), min(away)

    for _ in range(rounds):
        at = [place(v)[0] for _, v in kept]
        for c in range(len(cents)):
            mine = [v for (_, v), a in zip(kept, at) if a == c]
            if mine:
                cents[c] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *place(v)) for i, v in kept]
    total = sum(d for *_, d in found)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(i, c, d, sum(e for _, b, e in found if b == c), total, sha[c]) for i, c, d in found]


def key(row):
    return tuple((x is None, x) for x in row)


def check(spark, rows, **options):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in cluster_vectors(vectors, **options).collect()]
    want = plain(rows, options["clusters"], options["rounds"], options["dim"])
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


@pytest.mark.parametrize("block", [3, 64, 4096])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 5))
    rows = [(i, (centres[i % 6] + 0.3 * rng.normal(size=5)).tolist()) for i in range(300)]
    check(spark, rows, clusters=7, rounds=5, dim=5, block=block)


def test_ties_copies_and_empty_clusters(spark):
    grid = [[float(x), float(y)] for x in (-1, 0, 1) for y in (-1, 0, 1)]
    rows = [(i, grid[i % 9]) for i in range(60)] + [(100 + i, [0.5, 0.5]) for i in range(60)]
    got = check(spark, rows, clusters=12, rounds=4, dim=2, block=16)
    # Equal centroids: the smaller number gets the vectors.
    assert len({r[1] for r in got}) < 12


def test_odd_rows(spark):
    good = [(i, [i / 7, -i / 3]) for i in range(20)] + [(3, [9.0, 9.0]), (3, [9.0, 9.0]), (None, [1.0, 2.0])]
    odd = [
        (50, None), (51, []), (52, [1.0]), (53, [1.0, 2.0, 3.0]), (54, [None, 1.0]),
        (55, [math.nan, 1.0]), (56, [math.inf, 1.0]), (57, [1.0, -math.inf]),
    ]
    check(spark, good + odd, clusters=4, rounds=3, dim=2, block=8)
    check(spark, good[:3], clusters=5, rounds=2, dim=2)
    check(spark, good[:3], clusters=1, rounds=2, dim=2)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [1.0])]])
def test_nothing_to_cluster(spark, rows):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = cluster_vectors(vectors)
    assert found.count() == 0 and found.columns == [
        "id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    ]


def test_huge_components(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 70000.0]), (4, [0.0, -70000.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r.id: r for r in cluster_vectors(vectors, clusters=3, rounds=2, dim=2).collect()}
    assert len(found) == 4 and all(r.distance >= 0 for r in found.values())
    big = np.array([[1 << 27, 3], [-(1 << 27), 5]])
    assert squared_distances(big, big)[0].tolist() == [0, (1 << 56) + 4]


def test_other_columns_and_ids(spark):
    rows = [(f"v{i}", [float(i), 1.0], i, "x") for i in range(9)]
    vectors = spark.createDataFrame(rows, "vec_id string, embedding array<float>, cluster int, vec string")
    found = cluster_vectors(vectors, clusters=2, rounds=3, dim=2)
    assert sorted(r.id for r in found.collect()) == [f"v{i}" for i in range(9)]
    assert found.schema["id"].dataType.typeName() == "string"


def test_few_vectors_are_compared_again(spark):
    rng = np.random.default_rng(4)
    centres = 20 * rng.normal(size=(8, 8))
    rows = [(i, (centres[i % 8] + rng.normal(size=8)).tolist()) for i in range(1200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    scans = []
    cluster_vectors(vectors, clusters=8, rounds=5, dim=8, trace=scans)
    assert len(scans) == 6 and scans[0] == 1200 and scans[5] < 300


def test_heaps_pop_what_has_expired_and_keep_the_rest():
    rng = np.random.default_rng(2)
    keys, cluster = rng.random(500), rng.integers(0, 4, 500)
    heaps = Heaps.empty(4)
    heaps.push(cluster, keys, np.arange(500))
    offsets = np.array([0.1, 0.5, 0.0, 2.0])
    again = Heaps(*heaps.flat())
    out = again.pop_expired(offsets)
    assert sorted(out) == np.flatnonzero(keys <= offsets[cluster]).tolist()
    left, rows, sizes = again.flat()
    assert len(left) + len(out) == 500 == sizes.sum() + len(out)
    assert (keys[rows] == left).all()


def test_gap_is_a_lower_bound():
    rng = np.random.default_rng(3)
    rows, cents = rng.integers(-300, 300, (200, 6)), rng.integers(-300, 300, (9, 6))
    best, gap = nearest_with_gap(rows, cents)
    away = np.sqrt(((rows[:, None] - cents) ** 2).sum(axis=2))
    order = np.sort(away, axis=1)
    assert (best == away.argmin(axis=1)).all() and (gap <= order[:, 1] - order[:, 0]).all()
