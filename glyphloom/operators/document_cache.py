"""Words seen earlier in the same article, as a second model beside an n-gram model."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cached(events: DataFrame, article: str, order: list[str], decay: float | None = None) -> DataFrame:
    """``events`` with ``pc, has, seen``: cache probability of the event's word, whether the cache holds anything, whether it holds the word.

    ``events`` has w and oov. The cache holds the article's earlier known words and sentence ends;
    unknown ones don't enter it but move the distance on. With a decay (between 0 and 1, else ValueError) a word counts decay^distance.
    Weights grow from the start of a block of places to at most 1e200; the block's length follows from the decay, so that no power
    overflows and even a long article has few blocks. One article is one window.
    """
    if decay is not None and not 0 < decay < 1:
        raise ValueError("a decay lies between 0 and 1")
    w = Window.partitionBy(article).orderBy(*order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy(article, "w").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    e = events.withColumn("_i", F.row_number().over(w))
    known = F.when(F.col("oov"), 0.0).otherwise(1.0)
    if decay is None:
        e = e.withColumn("_x", known)
        total, mine = F.sum("_x").over(past), F.sum("_x").over(own)
    else:
        # Sums are kept relative to the block of the current place.
        block = max(1, int(200 * math.log(10) / -math.log(decay)))
        e = e.withColumn("_b", F.floor((F.col("_i") - 1) / block)).withColumn("_x", known * F.pow(F.lit(1 / decay), F.col("_i") - F.col("_b") * block))
        in_block = Window.partitionBy(article, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        own_block = Window.partitionBy(article, "w", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        sums = e.groupBy(article, "_b").agg((F.sum("_x") * decay**block).alias("_t"))
        own_sums = e.groupBy(article, "w", "_b").agg((F.sum("_x") * decay**block).alias("_t"))

        def carried(s: DataFrame, keys: list[str]) -> DataFrame:
            """What all earlier blocks weigh at a block's start, each one decay^block per block passed (underflow there is right)."""
            p = s.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_b").alias("_pb"), "_t")
            on = F.lit(True)
            for k in keys:
                on = on & (F.col(k) == F.col(f"_{k}"))
            here = e.select(*keys, "_b").distinct()
            return here.join(p, on & (F.col("_pb") < F.col("_b"))).groupBy(*keys, "_b").agg(F.sum(F.col("_t") * F.pow(F.lit(decay), (F.col("_b") - F.col("_pb") - 1) * block)).alias("_c"))

        a, b = carried(sums, [article]).withColumnRenamed("_c", "_ca"), carried(own_sums, [article, "w"]).withColumnRenamed("_c", "_cb")
        e = e.withColumn("_s", F.coalesce(F.sum("_x").over(in_block), F.lit(0.0))).withColumn("_m", F.coalesce(F.sum("_x").over(own_block), F.lit(0.0)))
        e = e.join(a, [article, "_b"], "left").join(b, [article, "w", "_b"], "left")
        total, mine = F.col("_s") + F.coalesce("_ca", F.lit(0.0)), F.col("_m") + F.coalesce("_cb", F.lit(0.0))
    out = e.withColumn("_tot", F.coalesce(total, F.lit(0.0))).withColumn("_own", F.when(F.col("oov"), 0.0).otherwise(F.coalesce(mine, F.lit(0.0))))
    out = out.withColumn("pc", F.when(F.col("_tot") > 0, F.col("_own") / F.col("_tot")).otherwise(0.0)).withColumn("has", F.col("_tot") > 0).withColumn("seen", F.col("_own") > 0)
    return out.select(*events.columns, "pc", "has", "seen")


def mixed(p: Column, lam: Column | float) -> Column:
    """(1 - lambda) p + lambda pc where the cache holds anything, else p."""
    x = F.lit(float(lam)) if isinstance(lam, int | float) else lam
    return F.when(F.col("has"), (1 - x) * p + x * F.col("pc")).otherwise(p)
