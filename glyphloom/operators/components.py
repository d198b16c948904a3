"""Connected components over shared keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.joins import left_lookup
from glyphloom.plans.materialise import cut

#: A key or component with more than this share of all rows (and a thousand) is hot; there are at most 1 / HOT_SHARE of them, so they are broadcast.
HOT_SHARE = 0.001


def _hot(rows: DataFrame, on: str, most: float) -> DataFrame:
    return rows.groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(on)


def _look_up(rows: DataFrame, on: str, values: DataFrame, value: str, hot: DataFrame) -> DataFrame:
    """Inner join of ``rows`` with one ``value`` per ``on``; ``hot`` keys, at most 1 / HOT_SHARE of them, by broadcast."""
    near = values.join(F.broadcast(hot), on)
    return left_lookup(rows, values, [on], near, F.xxhash64("node")).where(F.col(value).isNotNull())


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the least node of each component, from ``node, key`` rows (strings) where nodes with a key in common are linked.

    Every round takes the least root per key, then per node, then follows roots twice (pointer
    jumping), so the rounds grow with the logarithm of the longest chain. Keys are aggregated before they are
    joined back, so a key of a third of all nodes is one row in a shuffle; every round is written to
    the shared folder. Rows with NULL are ignored; a node without a shared key is its own root.
    """
    typed = links.where("node IS NOT NULL AND key IS NOT NULL").select(F.col("node").cast("string").alias("node"), F.col("key").cast("string").alias("key"))
    pairs = cut(typed.distinct())
    most = max(pairs.count() * HOT_SHARE, 1000)
    hot_keys = cut(_hot(pairs, "key", most))
    roots = cut(pairs.groupBy("node").agg(F.min("node").alias("root")))
    while True:
        by_key = pairs.join(roots, "node").groupBy("key").agg(F.min("root").alias("least"))
        reached = cut(_look_up(pairs, "key", by_key, "least", hot_keys).groupBy("node").agg(F.min("least").alias("root")))
        for _ in range(2):
            step = reached.select(F.col("node").alias("root"), F.col("root").alias("next"))
            reached = cut(_look_up(reached, "root", step, "next", _hot(reached, "root", most)).select("node", F.least("root", "next").alias("root")))
        old = roots.withColumnRenamed("root", "old")
        if reached.join(old, "node").where("root <> old").isEmpty():
            return reached
        roots = reached


def groups(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, root`` of every distinct node and ``root, size``; links of nodes that ``nodes`` doesn't have are ignored."""
    known = nodes.select("node").where("node IS NOT NULL").distinct()
    linked = links.join(known, "node", "left_semi")
    keys = linked.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("key")
    found = components(linked.join(keys, "key", "left_semi"))
    all_ = cut(known.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    return all_, all_.groupBy("root").agg(F.count("*").alias("size"))
