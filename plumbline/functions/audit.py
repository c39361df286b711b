"""Exact finite-population bounds (Arrow-batched, big integers)."""

from __future__ import annotations

from bisect import bisect_left
from math import comb

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

#: One-sided level 1/40, kept as integers.
ALPHA = (1, 40)


def hypergeom_upper(population: int, sample: int, found: int) -> int:
    """Largest number of defects K for which at most ``found`` in the sample are not less likely than alpha; the level itself counts as likely enough.

    Without a sample nothing is known, so K is the population. The chance falls as K grows, so the
    bound is bisected; every comparison is one of whole numbers.
    """
    if not 0 <= found <= sample <= population:
        raise ValueError("0 <= found <= sample <= population")
    if sample == 0:
        return population
    whole = comb(population, sample) * ALPHA[0]

    def too_unlikely(defects: int) -> bool:
        few = sum(comb(defects, i) * comb(population - defects, sample - i) for i in range(found + 1))
        return few * ALPHA[1] < whole

    return found + bisect_left(range(found + 1, population + 1), True, key=too_unlikely)


@pandas_udf(T.LongType())
def upper_bound(population: pd.Series, sample: pd.Series, found: pd.Series) -> pd.Series:
    return pd.Series([hypergeom_upper(int(a), int(b), int(c)) for a, b, c in zip(population, sample, found, strict=True)], dtype="int64")
