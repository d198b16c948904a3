"""Placing whole groups into splits, and carrying a split over to another rendering of the same articles."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.keys import running_before, seeded


def _chosen(deficits: list[int], step: int, places: np.ndarray) -> np.ndarray:
    """Which split takes each of equal groups, by the groups' places: always the one with the largest deficit, which then falls by ``step``; ties to the first split.

    The deficits that split j offers are D_j, D_j - step, D_j - 2 step, ...; place r has the r-th largest offer of all, found by halving.
    """
    d = np.array(deficits, dtype=np.int64)[:, None]
    r = places.astype(np.int64)
    above = lambda x: np.maximum((d - x - 1) // step + 1, 0).sum(axis=0)
    # The least offer x with at most r larger ones.
    low, high = np.full(len(r), int(d.min()) - step * (int(r.max(initial=0)) + 2), dtype=np.int64), np.full(len(r), int(d.max()), dtype=np.int64)
    while (low < high).any():
        middle = (low + high) // 2
        few = above(middle) <= r
        low, high = np.where(few, low, middle + 1), np.where(few, middle, high)
    equal = ((d - high) % step == 0) & (d >= high)
    nth = r - above(high)
    return np.argmax(np.cumsum(equal, axis=0) == nth + 1, axis=0)


def greedy_split(sizes: DataFrame, *, proportions: dict[str, float], seed: int = 20260929) -> DataFrame:
    """``root, split``: groups by falling size, equal ones in a seeded order, each whole into the split that lacks most of its share.

    Groups of one size are interchangeable, so the driver keeps one row per distinct size (about the root of the total),
    and each group computes its own split from its place among its equals. Shares that don't sum to 1 raise ValueError.
    """
    parts = {s: Fraction(str(p)) for s, p in proportions.items()}
    if sum(parts.values()) != 1 or min(parts.values()) < 0:
        raise ValueError("the proportions have to sum to 1")
    unit = math.lcm(*[p.denominator for p in parts.values()])
    counts = {r["size"]: r["n"] for r in sizes.groupBy("size").agg(F.count("*").alias("n")).collect()}
    total = sum(s * n for s, n in counts.items())
    left = [int(p * unit) * total for p in parts.values()]
    before: dict[int, list[int]] = {}
    for s in sorted(counts, reverse=True):
        before[s] = list(left)
        for j, n in enumerate(_taken(left, unit * s, counts[s])):
            left[j] -= unit * s * n
    names = list(parts)
    sent = sizes.sparkSession.sparkContext.broadcast((before, unit))

    @F.pandas_udf("int")
    def place(size: pd.Series, at: pd.Series) -> pd.Series:
        known, unit = sent.value
        out = np.zeros(len(size), dtype=np.int32)
        for s in size.unique():
            own = (size == s).to_numpy()
            out[own] = _chosen(known[int(s)], unit * int(s), at[own].to_numpy())
        return pd.Series(out)

    h = sizes.withColumn("_h", seeded(seed, F.col("root")))
    ranked = running_before(h, ["size"], ["_h", "root"], F.lit(1), "_at", bucket=F.shiftright("_h", 42))
    return ranked.select("root", F.element_at(F.array(*[F.lit(n) for n in names]), place("size", "_at") + 1).alias("split"))


def _taken(deficits: list[int], step: int, n: int) -> list[int]:
    """How many of ``n`` equal groups each split takes."""
    d = [int(x) for x in deficits]
    low, high = min(d) - step * (n + 2), max(d)
    above = lambda x: [max((v - x - 1) // step + 1, 0) for v in d]
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if sum(above(middle)) <= n else (middle + 1, high)
    out = above(high)
    for j, v in enumerate(d):
        if sum(out) < n and v >= high and (v - high) % step == 0:
            out[j] += 1
    return out


def projected(rows: DataFrame, split: DataFrame, name: str, *, article: str = "article_id") -> DataFrame:
    """The rows of another rendering whose articles a split of this one has; each row once, whatever the split repeats."""
    return rows.join(split.where(F.col("split") == name).select(F.col(article)).distinct(), article, "left_semi")
