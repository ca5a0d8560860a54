"""Similarity of two strings by their longest common subsequence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a column of the table at a time as the bits of one integer."""
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, ch in enumerate(b):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(b)) - 1
    free = full
    for ch in a:
        hit = free & where.get(ch, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(b) - free.bit_count()


def lcs_ratio(a: str | None, b: str | None) -> float:
    """2 * LCS / (both lengths); 0 if either is null or empty."""
    if not a or not b:
        return 0.0
    return 1.0 if a == b else 2 * lcs_length(a, b) / (len(a) + len(b))


@pandas_udf(DoubleType())
def lcs_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """``lcs_ratio`` of two text columns, batch by batch."""
    return pd.Series([lcs_ratio(x, y) for x, y in zip(a, b)], dtype="float64")
