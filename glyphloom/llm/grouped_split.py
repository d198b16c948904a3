"""Splits that keep related records together: components of shared keys, placed by grouped iterative stratification."""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.plans.materialise import cut

#: Components that one task stratifies, on average.
BUCKET = 20_000
#: Components with more than this share of all nodes are placed before the others, on the driver; there are at most 1 / LARGE.
LARGE = 0.001
ALL = "*"


def place(components: list[tuple[object, dict[str, int]]], need: dict[str, dict[str, float]], order: list[object]) -> dict[object, str]:
    """The split of every component, by iterative stratification.

    ``components`` are names with label vectors (ALL counts the nodes). Again and again the label with the
    fewest outstanding nodes is taken; its components, those with most of it first (then in the order of ``order``), each go to the
    split that needs that label most, of equal ones to the one that needs most nodes. What a component brings
    is taken off its split's needs of all its labels and off what is outstanding. ``need`` is changed.
    """
    rank = {c: i for i, c in enumerate(order)}
    vectors = dict(components)
    outstanding: dict[str, int] = defaultdict(int)
    having: dict[str, list] = defaultdict(list)
    for c, v in components:
        for x, n in v.items():
            outstanding[x] += n
            having[x].append(c)
    splits = list(need[ALL])
    placed: dict[object, str] = {}
    while len(placed) < len(vectors):
        # ALL comes last, for the components that no other label is left in.
        label = min((x for x, n in outstanding.items() if n > 0 and x != ALL), key=lambda x: (outstanding[x], x), default=ALL)
        own = sorted((c for c in having[label] if c not in placed), key=lambda c: (-vectors[c][label], rank[c]))
        outstanding[label] = 0
        for c in own:
            to = max(splits, key=lambda s: (need[label][s], need[ALL][s]))
            placed[c] = to
            for x, n in vectors[c].items():
                need[x][to] -= n
                outstanding[x] -= n
    return placed


def stratified(members: DataFrame, *, proportions: dict[str, float], seed: int = 20260929, bucket: int = BUCKET) -> DataFrame:
    """``root, split`` for every component of ``members`` (``node, root, labels array<string>``).

    Label vectors are aggregated per component. Components of more than LARGE of all nodes (at most 1 / LARGE) are
    placed on the driver against the needs of the whole; the others are dealt by hash into buckets of about ``bucket``
    components, and each bucket is stratified by ``place`` in a task of its own, with its share of what
    the splits still need. A component is never cut. Labels are not limited in number; one total per label comes to the driver.
    Shares that sum to other than 1 raise ValueError. NULL and missing labels count as none.
    """
    if abs(sum(proportions.values()) - 1) > 1e-9 or min(proportions.values(), default=-1) < 0:
        raise ValueError("the proportions have to sum to 1")
    spark = members.sparkSession
    labels = F.filter(F.coalesce("labels", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ALL))
    each = members.select("root", F.explode(F.concat(F.array(F.lit(ALL)), labels)).alias("label"))
    counts = each.groupBy("root", "label").agg(F.count("*").alias("n"))
    vectors = cut(counts.groupBy("root").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("v")))
    kind = members.schema["root"].dataType.simpleString()
    totals = {r["label"]: r["n"] for r in vectors.select(F.explode("v").alias("label", "n")).groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return spark.createDataFrame([], f"root {kind}, split string")
    need = {x: {s: n * p for s, p in proportions.items()} for x, n in totals.items()}
    size = F.col("v")[ALL]
    limit = max(totals[ALL] * LARGE, 1)
    large = [(r["root"], dict(r["v"])) for r in vectors.where(size > limit).orderBy(F.desc(size), "root").collect()] if totals[ALL] * LARGE >= 1 else []
    first = place(large, need, [c for c, _ in large]) if large else {}
    rest = vectors.where(size <= limit) if large else vectors
    left = dict(totals)
    for _, v in large:
        for x, n in v.items():
            left[x] -= n
    buckets = max(1, math.ceil(rest.count() / bucket))
    sent = spark.sparkContext.broadcast((need, left))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        need, left = sent.value
        own = own.sort_values(["_h", "root"])
        components = [(r, dict(v)) for r, v in zip(own["root"], own["v"], strict=True)]
        here: dict[str, int] = defaultdict(int)
        for _, v in components:
            for x, n in v.items():
                here[x] += n
        mine = {x: {s: a * n / left[x] for s, a in need[x].items()} for x, n in here.items()}
        placed = place(components, mine, list(own["root"]))
        return pd.DataFrame({"root": list(placed), "split": list(placed.values())})

    keyed = rest.withColumn("_h", F.xxhash64(F.lit(seed), "root")).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    spread = keyed.groupBy("_b").applyInPandas(run, f"root {kind}, split string")
    if not first:
        return spread
    return spark.createDataFrame(list(first.items()), f"root {kind}, split string").unionByName(spread)
