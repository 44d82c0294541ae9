"""Shortest paths in a sentence's dependency tree, given as an array of heads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tree_distance(heads: list[int], a: int, b: int) -> int | None:
    """Edges between two tokens; None if they are in different trees."""
    up, k, steps = {}, a, 0
    while k not in up:
        up[k] = steps
        steps, k = steps + 1, heads[k]
    k, steps, seen = b, 0, set()
    while k not in up:
        if k in seen:
            return None
        seen.add(k)
        steps, k = steps + 1, heads[k]
    return up[k] + steps


def nearest(heads: list[int], candidates: list[list[int]], target: list[int]) -> list[int]:
    """The indexes of all candidates (each a list of tokens) with the least distance to the target's tokens."""
    gaps = [min((d for a in c for b in target if (d := tree_distance(heads, a, b)) is not None), default=None) for c in candidates]
    known = [g for g in gaps if g is not None]
    return [k for k, g in enumerate(gaps) if known and g == min(known)]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def nearest_candidates(heads: pd.Series, candidates: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([nearest(list(h), [list(x) for x in c], list(t)) for h, c, t in zip(heads, candidates, target, strict=True)])
