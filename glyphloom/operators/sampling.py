"""Vocabularies, nested samples and frequency coverage."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.functions.keys import seeded


def coverage(vocabulary: DataFrame, share: float) -> DataFrame:
    """The most frequent words up to the one that reaches ``share`` of all tokens: ``w, c``. Ties in the order of the words.

    The running sum is taken over distinct counts, not over words; of the words with the count at the edge the first ones are taken.
    """
    total = vocabulary.agg(F.sum("c")).first()[0] or 0
    levels = vocabulary.groupBy("c").agg(F.sum("c").alias("mass"))
    w = Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)  # one row per distinct count
    edge = levels.withColumn("before", F.coalesce(F.sum("mass").over(w), F.lit(0))).where(F.col("before") < share * total).orderBy("c").first()
    if edge is None:
        return vocabulary.select("w", "c").limit(0)
    need = math.ceil((share * total - edge["before"]) / edge["c"])
    last = vocabulary.where(F.col("c") == edge["c"]).orderBy("w").limit(need)
    return vocabulary.where(F.col("c") > edge["c"]).select("w", "c").unionByName(last.select("w", "c"))


def nested_articles(sentences: DataFrame, target: int, seed: int, article: str = "article_id") -> DataFrame:
    """Articles in a seeded order until their words reach ``target``, the one that crosses it included; a smaller target gives a subset."""
    sizes = sentences.groupBy(article).agg(F.sum(F.size("tokens")).alias("words")).withColumn("_h", seeded(seed, F.col(article)))
    # The order is by ranges of the hash, so no task holds more than one of 64 ranges.
    ranged = sizes.withColumn("_b", F.shiftright("_h", 42))
    inner = Window.partitionBy("_b").orderBy("_h", article).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_b").agg(F.sum("words").alias("_t"))
    outer = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_b", F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_off"))
    before = F.coalesce(F.sum("words").over(inner), F.lit(0)) + F.col("_off")
    return ranged.join(totals, "_b").withColumn("_before", before).where(F.col("_before") < target).select(article, "words")


def sampled(df: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    """``n`` rows, always the same ones for a seed."""
    return df.withColumn("_h", seeded(seed, *[F.col(k) for k in keys])).orderBy("_h", *keys).limit(n).drop("_h")
