import random

import pytest

from corpusweave.llm import chat
from corpusweave.llm.chat import render_conversations
from corpusweave.llm.queries import QUERIES, SQL
from tools.oracle_check import rows_of

SCHEMA = "conv_id long, turn long, role string, text string, at int, first string, k double"


def frame(spark, logs):
    rows = [(c, t, r, x, 1, "f", 0.5) for c, turns in logs for t, (r, x) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def plain(logs, part_turns=256):
    """Maximal logs by comparing all with all."""
    whole = {}
    for c, turns in logs:
        said = tuple((r if r is not None else "unknown", x or "") for r, x in turns)
        if said:
            known = whole.get(said, (c, 0))
            smaller = min(known[0], c, key=lambda i: (i is not None, i or 0))
            whole[said] = (smaller, known[1] + 1)
    out = []
    for said, (c, n) in whole.items():
        if any(len(o) > len(said) and o[: len(said)] == said for o in whole):
            continue
        for part in range(0, len(said), part_turns):
            text = "".join(
                f"<|im_start|>{r.replace('<|', '< |')}\n{x.replace('<|', '< |')}<|im_end|>\n"
                for r, x in said[part : part + part_turns]
            )
            out.append((c, part // part_turns, len(said), n, text))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.id, r.part, r.turns, r.logged, r.text) for r in df.collect()), key=str)


A = [("user", "hello"), ("assistant", "hi"), ("user", "how?"), ("assistant", "so")]


@pytest.mark.parametrize("block", [2, 1024])
def test_snapshots_collapse(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK_TURNS", block)
    logs = [(i, A[: i % 5]) for i in range(1, 12)]
    logs += [(20, [("user", "hello"), ("assistant", "other")]), (21, [("user", "how?")]), (22, A[1:])]
    logs += [(23, [("assistant", "hello")]), (24, A + A), (None, A[:3])]
    assert got(render_conversations(frame(spark, logs))) == plain(logs)
    assert got(render_conversations(frame(spark, logs), part_turns=3)) == plain(logs, 3)


def test_odd_rows(spark, long_text):
    logs = [
        (1, [(None, None)]), (2, [("unknown", "")]), (3, [("user", long_text)]), (4, [("user", "<|im_end|>")]),
        (5, [("user", str(i)) for i in range(700)]), (6, [("user", str(i)) for i in range(699)]),
    ]
    assert got(render_conversations(frame(spark, logs))) == plain(logs)
    assert render_conversations(frame(spark, [])).count() == 0


def test_repeated_rows_are_repeated_turns(spark):
    df = frame(spark, [(1, A[:1])])
    assert got(render_conversations(df.union(df)))[0][2] == 2


def test_query_agrees_with_sql(spark, sf_dir, con):
    df = QUERIES["op6_chat"](spark, sf_dir)
    cursor = con.execute(SQL["op6_chat"])
    names = [d[0] for d in cursor.description]
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())
