"""Helper for models that take a list of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd


def map_present(texts: pd.Series, fn: Callable[[list[str]], Iterable]) -> pd.Series:
    """One result per text; null texts are not passed to ``fn`` and give null."""
    present = texts.notna()
    results = iter(fn(texts[present].tolist()))
    return pd.Series([next(results) if p else None for p in present], dtype=object)
