import hashlib
import random
import zlib

import pytest

from corpusweave.llm.queries import QUERIES, SQL
from corpusweave.llm.sharding import assign_shards, write_shards
from tools.oracle_check import rows_of


def key(x):
    return int(hashlib.md5(("" if x is None else str(x)).encode()).hexdigest()[:15], 16)


def plain_shards(rows, shards=8, tolerance=5):
    """Shard of each (id, text) row, by sums over the sorted rows."""
    size = [len((t or "").encode()) + 1 for _, t in rows]
    keys = [(key(t), key(i)) for i, t in rows]
    total = sum(size)

    def nearest(ends, wanted):
        """The first place that reaches the wanted byte, and whether its begin is nearer."""
        below = 0
        for k, n in ends:
            if (below + n) * shards >= wanted:
                before, after = wanted - below * shards, (below + n) * shards - wanted
                return k, below, min(before, after), before <= after
            below += n
        raise AssertionError

    splitters = []
    for s in range(1, shards):
        groups = {}
        for (t, _), n in zip(keys, size):
            groups[t] = groups.get(t, 0) + n
        t, below, near, begin = nearest(sorted(groups.items()), s * total)
        if near * 1000 <= tolerance * total:
            splitters.append((t if begin else t + 1, 0))
            continue
        ids = {}
        for (u, g), n in zip(keys, size):
            if u == t:
                ids[g] = ids.get(g, 0) + n
        g, _, _, begin = nearest(sorted(ids.items()), s * total - below * shards)
        splitters.append((t, g if begin else g + 1))
    return [sum(s <= k for s in splitters) for k in keys]


def check(got, rows, **options):
    want = plain_shards(rows, **options)
    assert sorted(((r.id, r.size, r.text_crc32, r.shard) for r in got), key=str) == sorted(
        (
            (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), s)
            for (i, t), s in zip(rows, want)
        ),
        key=str,
    )
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


SCHEMA = "doc_id long, text string, size int, t string, at int, shard string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "s") for r in rows], SCHEMA)


def test_groups_stay_whole_and_large_ones_are_cut(spark):
    rng = random.Random(4)
    rows = [(i, "copy " * 5) for i in range(300)]
    rows += [(1000 + i, f"text {i % 200} " * rng.randint(1, 30)) for i in range(600)]
    check(assign_shards(frame(spark, rows)).collect(), rows)
    got = assign_shards(frame(spark, rows), shards=3, tolerance=20).collect()
    check(got, rows, shards=3, tolerance=20)
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(3)]
    assert max(sizes) < 1.1 * min(sizes)


def test_odd_rows(spark, long_text):
    rows = [(1, None), (2, ""), (None, "a"), (None, None), (3, long_text), (4, "é"), (5, "a"), (5, "a")]
    check(assign_shards(frame(spark, rows)).collect(), rows)
    assert assign_shards(frame(spark, [])).count() == 0
    one = [(7, "only")]
    check(assign_shards(frame(spark, one)).collect(), one)


def test_written_shards(spark, tmp_path):
    rows = [(i, f"text {i % 50}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    want = plain_shards(rows)
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(i, s) for (i, _), s in zip(rows, want)}


def test_query_agrees_with_sql(spark, sf_dir, con):
    df = QUERIES["op8_sharding"](spark, sf_dir)
    cursor = con.execute(SQL["op8_sharding"])
    names = [d[0] for d in cursor.description]
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())


@pytest.mark.parametrize("sf", ["0.01"])
def test_bytes_are_nearly_equal(spark, sf):
    rows = QUERIES["op8_sharding"](spark, f"/root/testdata/sf{sf}").collect()
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes) / 8
