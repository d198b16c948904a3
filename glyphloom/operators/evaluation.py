"""Ranks, bootstrap intervals and growth laws."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.joins import left_lookup
from glyphloom.functions.keys import seeded
from glyphloom.operators import ngrams as ng
from glyphloom.operators.lm import HOT, Trained
from glyphloom.plans.materialise import cut


def harmonic(n: Column) -> Column:
    """The n-th harmonic number for n >= 0, as digamma(n + 1) + Euler's constant.

    The recurrence digamma(x) = digamma(x + 10) - 1/x - ... - 1/(x + 9) moves the argument to where four terms of the asymptotic series are exact to 1e-11.
    """
    x = n + 11.0
    series = F.ln(x) - 1 / (2 * x) - 1 / (12 * F.pow(x, F.lit(2.0))) + 1 / (120 * F.pow(x, F.lit(4.0))) - 1 / (252 * F.pow(x, F.lit(6.0)))
    return series - reduce(Column.__add__, [1 / (n + float(i)) for i in range(1, 11)]) + F.lit(0.5772156649015329)


def rank_metrics(greater: Column, equal: Column, known: Column) -> dict[str, Column]:
    """Expected hit@1, 5, 10, reciprocal rank and rank when ``equal`` other words tie; unknown words miss and have no rank."""
    hit = lambda k: F.when(known, F.least(F.greatest((F.lit(k) - greater) / (equal + 1), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    rr = F.when(known, (harmonic(greater + equal + 1) - harmonic(greater)) / (equal + 1)).otherwise(0.0)
    return {"hit_1": hit(1), "hit_5": hit(5), "hit_10": hit(10), "rr": rr, "rank": F.when(known, greater + 1 + equal / 2)}


def ranks(model: Trained, sentences: DataFrame, key: str) -> DataFrame:
    """``key, pos, w, oov, greater, equal``: how many words of the whole vocabulary score above and beside the true one.

    Only followers of an event's histories differ from scaled unigrams. Level by level, a follower's score there counts and the
    score it had by its next lower entry is taken back; followers with equal probabilities on both levels are one row with a
    count. Of the unigrams the distinct probabilities with their counts tell how many lie above; there is one per
    distinct count, about the root of the corpus size, and they are searched by halving.
    """
    entries = model.entries.where(F.col("w") != ng.UNK)
    e = ng.grams(sentences, model.order, [key]).withColumnRenamed("w", "true")
    hot = model.hot_stats.select("k", "hist", "gamma")
    with_gamma = left_lookup(e, model.backoff, ["k", "hist"], hot, F.xxhash64(key, "pos", "k")).withColumn("gamma", F.coalesce("gamma", F.lit(1.0)))
    chain = with_gamma.groupBy(key, "pos", "true").agg(F.collect_list(F.struct("k", "hist", "gamma")).alias("lv"))
    weight = lambda k: F.aggregate(F.array_sort(F.filter("lv", lambda x: x["k"] > k)), F.lit(1.0), lambda s, x: s * x["gamma"])
    chain = cut(chain.withColumn("g", F.array(*[weight(k) for k in range(1, model.order + 1)])))
    at = lambda k: F.element_at("g", F.col(k))
    per = chain.select(key, "pos", "true", "g", F.explode("lv").alias("x")).select(key, "pos", "true", "g", F.col("x.k").alias("k"), F.col("x.hist").alias("hist"))
    true = entries.withColumnRenamed("w", "true")
    frequent = true.where("k = 1").orderBy(F.desc("p"), "true").limit(int(1 / HOT))
    own = left_lookup(per, true, ["k", "hist", "true"], frequent, F.xxhash64(key, "pos", "k")).where("p IS NOT NULL")
    own = own.groupBy(key, "pos").agg(F.max(F.struct("k", (at("k") * F.col("p")).alias("s")))["s"].alias("t"))
    truth = cut(chain.drop("lv").join(own, [key, "pos"], "left"))
    follow = entries.where("k > 1").join(per.where("k > 1").select("k", "hist").distinct(), ["k", "hist"], "left_semi")
    below = follow.select("k", "hist", "w", "p", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("j")).withColumn("low", F.expr(f"substring_index(hist, '{ng.SEP}', 1 - j)"))
    lower = entries.select(F.col("k").alias("j"), F.col("hist").alias("low"), "w", F.col("p").alias("q"))
    steps = below.join(lower, ["j", "low", "w"]).groupBy("k", "hist", "w", "p").agg(F.max(F.struct("j", "q")).alias("m"))
    steps = cut(steps.groupBy("k", "hist", "p", F.col("m.j").alias("j"), F.col("m.q").alias("q")).agg(F.count("*").alias("n")))
    x = per.where("k > 1").drop("true", "g").join(truth.where("t IS NOT NULL").select(key, "pos", "t", "g"), [key, "pos"]).join(steps, ["k", "hist"])
    here, there = at("k") * F.col("p"), at("j") * F.col("q")
    changed = lambda new, old: F.sum(F.col("n") * (new.cast("int") - old.cast("int")))
    above = x.groupBy(key, "pos").agg(changed(here > F.col("t"), there > F.col("t")).alias("ga"), changed(here == F.col("t"), there == F.col("t")).alias("ea"))
    levels = entries.where("k = 1").groupBy("p").agg(F.count("*").alias("n")).orderBy("p").toPandas()
    sent = sentences.sparkSession.sparkContext.broadcast((levels.p.to_numpy(dtype=float), np.concatenate([[0], np.cumsum(levels.n.to_numpy(dtype=np.int64))])))

    @F.pandas_udf("struct<gl:bigint,el:bigint>")
    def among(scale: pd.Series, target: pd.Series) -> pd.DataFrame:
        p, upto = sent.value
        g, t = scale.to_numpy(dtype=float), target.to_numpy(dtype=float)
        low = _first(p, g, t, lambda a, b: a >= b)
        high = _first(p, g, t, lambda a, b: a > b)
        return pd.DataFrame({"gl": upto[-1] - upto[high], "el": upto[high] - upto[low]})

    counted = truth.where("t IS NOT NULL").select(key, "pos", among(F.element_at("g", 1), "t").alias("u")).select(key, "pos", "u.gl", "u.el")
    out = truth.join(above, [key, "pos"], "left").join(counted, [key, "pos"], "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    oov = F.col("t").isNull()
    return out.select(key, "pos", F.when(oov, F.lit(ng.UNK)).otherwise(F.col("true")).alias("w"), oov.alias("oov"), (z("ga") + z("gl")).alias("greater"), F.greatest(z("ea") + z("el") - 1, F.lit(0)).alias("equal"))


def _first(p: np.ndarray, g: np.ndarray, t: np.ndarray, reached) -> np.ndarray:
    """For each row the first place of the rising ``p`` where ``reached(p * g, t)`` holds; the halving is corrected by the products themselves."""
    at = np.searchsorted(p, t / g)
    padded = np.concatenate([[-np.inf], p, [np.inf]])
    while (back := reached(padded[at] * g, t)).any():
        at = at - back
    while (on := ~reached(padded[at + 1] * g, t)).any():
        at = at + on
    return at


def _times(seed: int, key: str) -> Column:
    """How often a group counts in repetition ``rep``: a Poisson(1) number drawn from a hash of both."""
    u = (seeded(seed, F.col(key), F.col("rep")) + 0.5) / F.lit(float(1 << 48))
    steps, total, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 8):
        total += term
        steps = steps + (u > total).cast("int")
        term /= k
    return steps


def _interval(groups: DataFrame, key: str, columns: list[str], value: Column, repetitions: int, seed: int) -> DataFrame:
    """``low, high``: the 2.5 and 97.5 percentiles over bootstrap repetitions of ``value`` of the weighted sums ``s_<column>``."""
    reps = groups.select(key, *columns, F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("rep")).withColumn("_times", _times(seed, key))
    per = reps.groupBy("rep").agg(*[F.sum(F.col("_times") * F.col(c)).alias(f"s_{c}") for c in columns]).select(value.alias("x"))
    return per.agg(F.percentile("x", F.lit(0.025)).alias("low"), F.percentile("x", F.lit(0.975)).alias("high"))


def bootstrap(groups: DataFrame, key: str, a: str, b: str, events: str, *, repetitions: int = 1000, seed: int = 20260930) -> DataFrame:
    """Relative change of perplexity from loss ``a`` to loss ``b`` (sums of -log10 p per group), with the 2.5 and 97.5 percentiles of Poisson bootstrap repetitions.

    Each group counts a Poisson(1) number of times in a repetition, drawn from a hash of group and
    repetition, so groups are never gathered and other engines can repeat it.
    """
    change = F.pow(F.lit(10.0), (F.col(f"s_{b}") - F.col(f"s_{a}")) / F.nullif(F.col(f"s_{events}"), F.lit(0))) - 1
    point = groups.agg((F.pow(F.lit(10.0), (F.sum(b) - F.sum(a)) / F.sum(events)) - 1).alias("change"), F.count("*").alias("groups"))
    return point.join(_interval(groups, key, [a, b, events], change, repetitions, seed))


def paired_bootstrap(pairs: DataFrame, key: str, a: str, b: str, *, repetitions: int = 1000, seed: int = 20260930) -> DataFrame:
    """``pairs, difference, low, high``: the mean of a - b over all pairs, with the percentiles of Poisson bootstrap repetitions."""
    d = pairs.select(key, (F.col(a) - F.col(b)).alias("d"), F.lit(1.0).alias("one"))
    point = d.agg(F.count("*").alias("pairs"), F.avg("d").alias("difference"))
    return point.join(_interval(d, key, ["d", "one"], F.col("s_d") / F.nullif(F.col("s_one"), F.lit(0.0)), repetitions, seed))


def power_law(points: DataFrame, x: str, y: str) -> DataFrame:
    """``factor, exponent`` of y = factor x^exponent by least squares on logarithms; NULL under two points."""
    lx, ly = F.ln(x), F.ln(y)
    return points.agg(F.exp(F.regr_intercept(ly, lx)).alias("factor"), F.regr_slope(ly, lx).alias("exponent"))
