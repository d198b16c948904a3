"""Hyper-parameter search on held-out text: grids that grow while the best point is at their edge, and coordinate descent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def perplexities(events: DataFrame, points: list, probability: Callable[[object], Column]) -> list[float]:
    """Perplexity of each point over all events, in one pass: one pair of sums per point."""
    sums = [F.sum(F.log2(probability(x))).alias(f"_s{i}") for i, x in enumerate(points)]
    r = events.agg(F.count("*").alias("_events"), *sums).first()
    return [2 ** (-r[f"_s{i}"] / r["_events"]) if r["_events"] else float("nan") for i in range(len(points))]


def growing_grid(events: DataFrame, start: list[float], probability: Callable[[float], Column], *, factor: float, bound: float, most: int = 20) -> tuple[float, dict[float, float]]:
    """The best value and all perplexities. While the extreme value on the side of ``factor`` (under 1: the least, over 1: the greatest) is best, the grid goes on by ``factor`` up to ``bound``."""
    found = dict(zip(start, perplexities(events, start, probability), strict=True))
    for _ in range(most):
        best = min(found, key=lambda x: (found[x], x))
        edge = min(found) if factor < 1 else max(found)
        further = edge * factor
        if best != edge or (further < bound if factor < 1 else further > bound):
            break
        found[further] = perplexities(events, [further], probability)[0]
    return min(found, key=lambda x: (found[x], x)), found


def coordinate_descent(events: DataFrame, start: list[float], steps: list[float], probability: Callable[[list[float]], Column], *, rounds: int = 2) -> tuple[list[float], float]:
    """Each coordinate in turn is multiplied by each step and keeps the best; all steps of a coordinate are one pass."""
    best = list(start)
    value = perplexities(events, [best], probability)[0]
    for _ in range(rounds):
        for i in range(len(best)):
            tried = [[*best[:i], best[i] * s, *best[i + 1 :]] for s in steps]
            got = perplexities(events, tried, probability)
            j = min(range(len(got)), key=got.__getitem__)
            if got[j] < value:
                best, value = tried[j], got[j]
    return best, value
