"""Equi-join against per-key facts when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.plans.staging import stage

#: At most this many hot keys travel by broadcast; more of them are spread by a join.
HOT_KEYS = 4096
#: A key with fewer rows than this is never worth special treatment.
HOT_ROWS = 100_000


def join_facts(
    rows: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    count_col: str,
    payload: Sequence[str],
    hot_rows: int = HOT_ROWS,
    hot_keys: int = HOT_KEYS,
    total_rows: int | None = None,
) -> DataFrame:
    """Left-join one-row-per-key ``facts`` onto ``rows`` without a hot task.

    ``count_col`` of ``facts`` says how many rows share the key.  Keys of at least ``hot_rows``
    rows are hot: their rows are spread over a salt, and their facts repeated for each salt,
    so that a task gets about ``hot_rows`` rows of a key however many there are.  Which keys
    are hot is a small written table; up to ``hot_keys`` of them it is broadcast to the rows,
    beyond that number, which takes ``hot_keys * hot_rows`` rows at least, it is joined.
    Every row comes back exactly once.

    With ``total_rows``, the known size of ``rows``, below ``hot_rows`` no key can be hot and
    the join is an ordinary one.
    """
    keys, payload = list(keys), list(payload)
    if total_rows is not None and total_rows < hot_rows:
        return rows.join(facts.select(*keys, *payload), keys, "left").select(*rows.columns, *payload)
    # The join would infer this for one use of the facts only, and then compute them twice.
    for key in keys:
        facts = facts.where(F.col(key).isNotNull())
    salts = F.ceil(F.col(count_col) / F.lit(hot_rows)).cast("int")
    hot = stage(facts.where(F.col(count_col) >= hot_rows).select(*keys, salts.alias("_salts")), "hot-keys")
    few = hot.count() <= hot_keys
    # The salt of a row depends on the row alone, so a task that runs again deals it alike.
    own = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.coalesce("_salts", F.lit(1)))
    salted = rows.join(F.broadcast(hot) if few else hot, keys, "left").withColumn("_salt", own.cast("int"))
    each = F.when(F.col(count_col) >= hot_rows, F.sequence(F.lit(0), salts - 1)).otherwise(
        F.array(F.lit(0))
    )
    spread = facts.select(*keys, *payload, F.explode(each).alias("_salt"))
    joined = salted.join(spread, [*keys, "_salt"], "left")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], *payload)
