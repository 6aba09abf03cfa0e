"""Best-fit-decreasing packing of tokenised documents into sequences of fixed capacity.

Which documents share a sequence depends on the piece lengths alone, and these are integers
up to the capacity.  So the counted lengths (at most as many rows as the capacity) are packed
first: lengths in descending order, each into the tightest open sequence, found with a segment
tree over remaining capacities.  Sequences with equal contents so far are kept as one range,
so the plan is made in a time that does not depend on the number of documents, and it is the
very result of packing them one by one.  Each piece then finds its place by its rank among
the pieces of its length.

Defined cases: a null or empty text is a document of the end token alone; equal rows are
packed one by one; documents over the capacity are cut from the end, so only their first
piece may be shorter; pieces of equal length are taken in the order of id, piece and start
(null ids first).  An empty table gives no pieces.  Only the id and text columns are read.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.common import bounded_batches
from corpusweave.plans.ordering import with_row_index
from corpusweave.plans.staging import stage

CAPACITY, END_ID = 1024, 2

#: Characters whose classes all regular-expression libraries agree on; other texts take the
#: reference tokenizer itself, and so do special-token marks and very long words.
_OTHER = re.compile("[^\t\n\r -~¡-ſ‐-‧€]")
_LONG_WORD = re.compile(r"(?<!\S)\S{2000}")


def _plain(text: str) -> bool:
    return not (_OTHER.search(text) or "<|" in text or _LONG_WORD.search(text))


class ByteLevelTokenizer:
    """Token ids of a byte-level BPE file of the ``tokenizers`` library.

    Ids of plain texts come from the same merges run by ``tiktoken``, several times faster,
    if the file's merges are ranked by id, which is checked; all else, and texts with unusual
    characters, special-token marks or very long words, goes through ``tokenizers``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.fast = self._fast(path)

    @staticmethod
    def _fast(path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (
            model.get("type") == "BPE"
            and spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        )
        if not plain:
            return None
        # The printable stand-ins of bytes: visible Latin-1 stands for itself, the rest follows 255.
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in visible]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        merged = [vocab.get(m.replace(" ", "", 1)) for m in merges]
        singles = [t for t in vocab if len(t) == 1]
        if None in merged or merged != sorted(merged) or len(singles) != 256:
            return None
        if len(vocab) != 256 + len(merges) or any(c not in byte_of for t in vocab for c in t):
            return None
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
        import public_tokenizers

        return tiktoken.Encoding(
            "ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and _plain(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(2)
def load_tokenizer(path: str) -> ByteLevelTokenizer:
    return ByteLevelTokenizer(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """``start, length`` of a document's pieces; all but the first are full."""
    first = length % capacity or capacity
    starts = [0, *range(min(first, length), length, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], length])]


def tokenized_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` (and ``ids``) of every piece of every row."""
    bounded_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = load_tokenizer(path)
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"]):
                ids = np.append(tokens.ids(text), np.uint32(end_id)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    row = (key, piece, start, length, zlib.crc32(own.tobytes()))
                    rows.append((*row, own.astype(np.int32)) if keep_ids else row)
            yield pd.DataFrame(rows, columns=names)

    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    names = ["id", "piece", "start", "length", "ids_crc32"]
    if keep_ids:
        schema, names = f"{schema}, ids array<int>", [*names, "ids"]
    return narrow.mapInPandas(encode, schema)


class Capacities:
    """Open sequences by remaining capacity, with a segment tree that finds the tightest."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, rest: int) -> None:
        node = rest + self.size
        self.any[node] = bool(self.ranges[rest])
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def add(self, rest: int, first: int, n: int) -> None:
        if n and rest:
            insort(self.ranges[rest], (first, n))
            self._mark(rest)

    def take(self, rest: int) -> tuple[int, int]:
        found = self.ranges[rest].pop(0)
        self._mark(rest)
        return found

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` that a sequence has."""
        node = length + self.size
        if self.any[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Where the pieces of each length go, as runs of equal moves.

    The ``n`` pieces of ``length`` from ``rank`` on go ``per`` to a sequence, from sequence
    ``first`` and place ``at`` on.
    """
    open_, used, moves = Capacities(capacity), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            rest = open_.tightest(length)
            if rest is None:
                rest, (first, n) = capacity, (used, -(-left // (capacity // length)))
                used += n
            else:
                first, n = open_.take(rest)
            # The tightest sequence stays the tightest until the length no longer fits.
            per = rest // length
            whole = min(n, left // per)
            if whole:
                moves.append((length, rank, whole * per, per, first, capacity - rest))
                open_.add(rest - per * length, first, whole)
                rank, left = rank + whole * per, left - whole * per
            if left and whole < n:
                moves.append((length, rank, left, left, first + whole, capacity - rest))
                open_.add(rest - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            open_.add(rest, first + whole, n - whole)
    return pd.DataFrame(moves, columns=["length", "rank", "n", "per", "first", "at"], dtype="int64")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` of each.

    ``pieces`` is a written table with ``id``, ``piece``, ``start`` and ``length``.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = best_fit_plan(counts, capacity).sort_values(["length", "rank"])
    before, total = np.zeros(capacity + 2, np.int64), 0
    for length in sorted(counts):
        before[length], total = total, total + counts[length]
    begins = before[plan["length"]] + plan["rank"].to_numpy()
    moves = {c: plan[c].to_numpy() for c in plan.columns}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            index = batch.pop("_index").to_numpy()
            move = np.searchsorted(begins, index, side="right") - 1
            turn = index - begins[move]
            per = moves["per"][move]
            batch["sequence_id"] = moves["first"][move] + turn // per
            batch["offset"] = moves["at"][move] + turn % per * moves["length"][move]
            yield batch

    indexed = with_row_index(pieces, ["length", "id", "piece", "start"], "_index")
    fields = ", ".join(f"`{c}` {kind}" for c, kind in pieces.dtypes)
    columns = [*pieces.columns, "_index"]
    return indexed.select(*columns).mapInPandas(
        place, f"{fields}, sequence_id bigint, offset bigint"
    )


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """Tokenise and pack: one row per piece with its sequence and its place there."""
    pieces = tokenized_pieces(docs, id_col, text_col, tokenizer, capacity, end_id, keep_ids)
    return pack(stage(pieces, "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids`` from pieces packed with their ids; at most a capacity each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.id").alias("doc_ids")
    )
