"""Stupid Backoff: relative frequencies at the longest match, times a factor per order; and its normalisation for any factor."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.joins import left_lookup
from glyphloom.operators import ngrams as ng
from glyphloom.operators.lm import HOT
from glyphloom.plans.materialise import cut


@dataclass
class Backoff:
    order: int
    entries: DataFrame  # k, hist, w, s: relative frequency
    covered: DataFrame  # k, hist, covered: share of the shorter history's mass that this history's followers have there; NULL for order 1
    words: DataFrame


def train(sentences: DataFrame, order: int) -> Backoff:
    c = cut(ng.counts(sentences, order))
    totals = c.groupBy("k", "hist").agg(F.sum("c").alias("total"))
    entries = cut(c.join(totals, ["k", "hist"]).select("k", "hist", "w", (F.col("c") / F.col("total")).alias("s")))
    upper = entries.where("k > 1").select("k", "hist", "w", (F.col("k") - 1).alias("_k"), ng.suffix(F.col("hist")).alias("_h"))
    lower = entries.select(F.col("k").alias("_k"), F.col("hist").alias("_h"), F.col("w"), "s")
    covered = upper.join(lower, ["_k", "_h", "w"]).groupBy("k", "hist").agg(F.sum("s").alias("covered"))
    one = entries.where("k = 1").select("k", "hist").distinct().withColumn("covered", F.lit(None).cast("double"))
    words = sentences.select(F.explode("tokens").alias("w")).distinct().unionByName(sentences.sparkSession.createDataFrame([(ng.EOS,)], "w string"))
    return Backoff(order, entries, cut(covered.unionByName(one)), cut(words))


def profiles(model: Backoff, sentences: DataFrame, keep: list[str]) -> DataFrame:
    """``keep, pos, w, n, level, value, mass``: highest order, matched order and its relative frequency, and per order the mass of the words whose longest match it is.

    None of it depends on the factors, so any factors can be tried on the same table. An unknown word has value 0.
    """
    e = ng.grams(sentences, model.order, keep)
    known = model.covered.withColumn("_seen", F.lit(True))
    # The empty history covers nothing below it; frequent words and the histories that they alone are come by broadcast.
    frequent = model.entries.where("k = 1").orderBy(F.desc("s"), "w").limit(int(1 / HOT))
    salt = F.xxhash64(*keep, "pos", "k")
    j = left_lookup(e, model.entries, ["k", "hist", "w"], frequent, salt)
    hot = known.join(F.broadcast(frequent.select(F.lit(2).alias("k"), F.col("w").alias("hist"))), ["k", "hist"]).unionByName(known.where("k = 1"))
    j = left_lookup(j, known, ["k", "hist"], hot, salt)
    g = j.groupBy(*keep, "pos", "w").agg(F.max("k").alias("n"), F.max(F.when(F.col("s").isNotNull(), F.struct("k", "s"))).alias("m"), F.array_sort(F.collect_list(F.struct("k", F.coalesce("_seen", F.lit(False)).alias("seen"), F.coalesce("covered", F.lit(0.0)).alias("covered")))).alias("lv"))

    def mass(x: Column, i: Column) -> Column:
        above = F.try_element_at("lv", i + 2)
        return F.when(x["seen"], 1 - F.when(above["seen"], above["covered"]).otherwise(0.0)).otherwise(F.lit(0.0))

    return g.select(*keep, "pos", "w", "n", F.coalesce(F.col("m.k"), F.lit(1)).alias("level"), F.coalesce(F.col("m.s"), F.lit(0.0)).alias("value"), F.transform("lv", mass).alias("mass"))


def score(alpha: Column | float) -> Column:
    """The unnormalised score of a profile under one factor for all orders."""
    a = F.lit(float(alpha)) if isinstance(alpha, int | float) else alpha
    return F.col("value") * F.pow(a, F.col("n") - F.col("level"))


def normalised(alpha: Column | float) -> Column:
    """The score divided by the sum of the scores of all words."""
    a = F.lit(float(alpha)) if isinstance(alpha, int | float) else alpha
    z = F.aggregate(F.transform("mass", lambda m, i: m * F.pow(a, F.col("n") - i - 1)), F.lit(0.0), lambda s, x: s + x)
    return score(a) / z


def _factor(alphas: list[float], level: Column, top: Column) -> Column:
    """The product of the factors of orders above ``level`` up to ``top``; alphas[0] belongs to order 2."""
    a = F.array(*[F.lit(float(x)) for x in alphas])
    return F.aggregate(F.filter(F.sequence(F.lit(2), F.lit(len(alphas) + 1)), lambda k: (k > level) & (k <= top)), F.lit(1.0), lambda s, k: s * F.element_at(a, k - 1))


def normalised_by_order(alphas: list[float]) -> Column:
    """Like ``normalised`` with a factor for each order from 2 on."""
    z = F.aggregate(F.transform("mass", lambda m, i: m * _factor(alphas, i + 1, F.col("n"))), F.lit(0.0), lambda s, x: s + x)
    return F.col("value") * _factor(alphas, F.col("level"), F.col("n")) / z
