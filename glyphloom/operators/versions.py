"""Differences between two copies of one keyed dataset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one_row_per_key(df: DataFrame, key: str, fields: list[str], latest: list[str]) -> DataFrame:
    """Of a key's rows the one that is greatest by ``latest`` and then by its own values; NULL keys are left out."""
    rank = F.struct(*[F.col(c) for c in latest], *[F.col(c) for c in fields])
    kept = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(rank).alias("_r"))
    return kept.select("_key", *[F.col("_r")[c].alias(c) for c in dict.fromkeys([*fields, *latest])])


def _differs(a: Column, b: Column, tolerance: float | None) -> Column:
    if tolerance is None:
        return ~a.eqNullSafe(b)
    close = F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
    return ~(a.eqNullSafe(b) | close)


def compare_versions(first: DataFrame, second: DataFrame, *, key: str, fields: list[str], tolerance: dict[str, float] | None = None, latest: list[str] | None = None, labels: list[str] | None = None) -> DataFrame:
    """One row per key that isn't the same on both sides: ``_key, side, changed`` and the labels of either side.

    EXCEPT ALL runs in both directions over normalised rows (one row per key, no number rounded);
    only keys in one of the two residues are full-joined, and there the tolerance decides. ``side`` is 'both', 'only_first' or
    'only_second'; ``changed`` lists the differing fields (empty: equal within the tolerance).

    NULL equals NULL only; an empty string isn't NULL; NaN equals NaN. Rows without a key are left
    out. Repeated rows count once; of rows that share a key but not their values the one greatest by
    ``latest`` counts. Empty tables give every key of the other side. Further columns are ignored.
    """
    tolerance, latest, labels = tolerance or {}, latest or [], labels or []
    keep = list(dict.fromkeys([*fields, *labels]))
    a, b = (_one_row_per_key(x, key, keep, latest) for x in (first, second))

    def normal(x: DataFrame) -> DataFrame:
        return x.select("_key", *fields)

    residue = normal(a).exceptAll(normal(b)).select("_key").union(normal(b).exceptAll(normal(a)).select("_key")).distinct()
    pick = lambda x, tag: x.join(residue, "_key", "left_semi").select("_key", F.struct(*keep).alias(tag))
    both = pick(a, "_a").join(pick(b, "_b"), "_key", "full_outer")
    side = F.when(F.col("_b").isNull(), "only_first").when(F.col("_a").isNull(), "only_second").otherwise("both")
    changed = F.array_compact(F.array(*[F.when(_differs(F.col(f"_a.{c}"), F.col(f"_b.{c}"), tolerance.get(c)), F.lit(c)) for c in fields]))
    return both.select("_key", side.alias("side"), F.when(side == "both", changed).otherwise(F.array().cast("array<string>")).alias("changed"), *[F.coalesce(F.col(f"_a.{c}"), F.col(f"_b.{c}")).alias(f"label_{c}") for c in labels])


def field_report(differences: DataFrame, key: str) -> DataFrame:
    """``key, field_name, status``: a row per differing field, or one with '*' for a key on one side only."""
    lines = F.when(F.col("side") != "both", F.array(F.struct(F.lit("*").alias("field_name"), F.col("side").alias("status")))).otherwise(
        F.transform("changed", lambda c: F.struct(c.alias("field_name"), F.lit("differs").alias("status")))
    )
    return differences.select(F.col("_key").alias(key), F.inline(lines))


def counts_by(first: DataFrame, second: DataFrame, differences: DataFrame, *, key: str, group: str) -> DataFrame:
    """Counts per ``group`` over the union of keys: paragraphs, identical, different, only_first, only_second.

    The group of a key is its least value on the first side, else on the second.
    """
    tagged = [x.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(group).alias("_g"), F.lit(i).alias("_i")) for i, x in enumerate((first, second))]
    of = reduce(DataFrame.unionByName, tagged).groupBy("_key").agg(F.coalesce(F.min(F.when(F.col("_i") == 0, F.col("_g"))), F.min("_g")).alias(group))
    state = differences.select("_key", F.when(F.col("side") != "both", F.col("side")).when(F.size("changed") > 0, F.lit("different")).otherwise(F.lit("identical")).alias("_s"))
    s = F.coalesce(F.col("_s"), F.lit("identical"))
    return of.join(state, "_key", "left").groupBy(group).agg(F.count("*").alias("paragraphs"), *[F.count_if(s == v).alias(v) for v in ("identical", "different", "only_first", "only_second")])
