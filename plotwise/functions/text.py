"""Text similarity; Jaro has no Spark built-in, so it runs on Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    from_a = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == ch:
                free[j] = False
                from_a.append(ch)
                break
    if not from_a:
        return 0.0
    from_b = [b[j] for j, unused in enumerate(free) if not unused]
    m = len(from_a)
    swaps = sum(x != y for x, y in zip(from_a, from_b)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


@F.pandas_udf(T.DoubleType())
def jaro_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _jaro(x, y) for x, y in zip(a, b)], dtype="float64")
