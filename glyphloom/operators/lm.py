"""Back-off language models of any order as relations.

A trained model is two tables: ``counted`` (k, hist, w with raw and adjusted counts) and ``stats`` (what a
history's followers add up to and what it leaves to the next lower order). Interpolated probabilities
are sums over the orders, so events are scored from these two tables alone; ``entries`` and
``backoff``, the usual form of a model (the interpolated probability of each n-gram seen, and the weight
of each history), are only built where the model itself is wanted.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.joins import left_lookup
from glyphloom.operators import ngrams as ng
from glyphloom.plans.materialise import cut

#: A history or n-gram with more than this share of all training words is hot; an order has at most 1 / HOT of them.
HOT = 0.001


@dataclass
class Model:
    """A model given by its entries, as read from a file or quantised."""

    order: int
    entries: DataFrame
    backoff: DataFrame
    words: DataFrame  # w: the words that aren't out of vocabulary


@dataclass
class Trained:
    """``counted``: k, hist, w, c, a, kept; ``stats``: k, hist, n, denom, types, gamma; discounts per order (none for Witten-Bell); words with the sentence end and the unknown one; weight and total of order 1."""

    order: int
    counted: DataFrame
    stats: DataFrame
    discounts: dict[int, tuple[float, float, float]] | None
    size: int
    total: int
    first: tuple[float, float, float]  # denom, types and gamma of the empty history

    def own(self, a: Column, denom: Column, types: Column) -> Column:
        """An n-gram's discounted share of its history."""
        if self.discounts is None:
            return a / (denom + types)
        return (a - _discount(self.discounts, a)) / denom

    @property
    def hot_stats(self) -> DataFrame:
        """The empty history and those that more than HOT of all words follow; at most 1 / HOT an order."""
        return self.stats.where((F.col("k") == 1) | (F.col("n") > self.total * HOT))

    @property
    def words(self) -> DataFrame:
        return self.counted.where("k = 1").select("w")

    @property
    def backoff(self) -> DataFrame:
        return self.stats.select("k", "hist", "gamma")

    @cached_property
    def entries(self) -> DataFrame:
        """``k, hist, w, p``, order by order: each one's discounted share, and its history's weight times the next lower order's p."""
        s = self.stats.select("k", "hist", "denom", "types", "gamma")
        seen = self.counted.where("kept AND k > 1").join(s.where("k > 1"), ["k", "hist"])
        seen = cut(seen.select("k", "hist", "w", self.own(F.col("a"), F.col("denom"), F.col("types")).alias("own"), "gamma"))
        spark = self.counted.sparkSession
        denom, types, gamma = self.first
        one = self.counted.where("kept AND k = 1").select("k", "hist", "w", self.own(F.col("a"), F.lit(denom), F.lit(types)).alias("own"))
        unknown = spark.createDataFrame([(1, "", ng.UNK, 0.0)], "k int, hist string, w string, own double")
        level = cut(one.unionByName(unknown).select("k", "hist", "w", (F.col("own") + gamma / self.size).alias("p")))
        out = level
        for k in range(2, self.order + 1):
            lower = level.select(F.col("hist").alias("_h"), "w", F.col("p").alias("_p"))
            at = seen.where(F.col("k") == k).withColumn("_h", ng.suffix(F.col("hist")))
            level = cut(at.join(lower, ["_h", "w"]).select("k", "hist", "w", (F.col("own") + F.col("gamma") * F.col("_p")).alias("p")))
            out = out.unionByName(level)
        return out


def _discount(discounts: dict[int, tuple[float, float, float]], a: Column) -> Column:
    own = F.element_at(F.array(*[F.array(*[F.lit(x) for x in discounts[k]]) for k in sorted(discounts)]), F.col("k"))
    return F.element_at(own, F.least(a, F.lit(3)).cast("int"))


def train(sentences: DataFrame, order: int, *, method: str = "modified", prune: list[int] | None = None, fallback: tuple[float, float, float] | None = (0.5, 1.0, 1.5)) -> Trained:
    """Interpolated modified or original Kneser-Ney, or recursive Witten-Bell ('witten_bell'), of orders 1..order.

    Pruning drops n-grams whose raw count is at most the order's threshold and gives their discounted
    mass to the back-off weight, so every history's probabilities still sum to one. Two tables are
    written; one row an order comes to the driver.
    """
    limits = (prune or [0])[: order]
    limit = F.element_at(F.array(*[F.lit(t) for t in limits]), F.least(F.col("k"), F.lit(len(limits))))
    both = ng.both_counts(sentences, order)
    if method == "witten_bell":
        both = both.withColumn("a", F.col("c"))
    counted = cut(both.withColumn("kept", F.col("c") > limit))
    per = {r["k"]: r for r in ng.counts_of_counts(counted).join(counted.groupBy("k").agg(F.count("*").alias("types"), F.sum("c").alias("total")), "k").collect()}
    discounts = None
    if method != "witten_bell":
        coc = counted.sparkSession.createDataFrame([(k, *[r[f"n{i}"] for i in (1, 2, 3, 4)]) for k, r in per.items()], "k int, n1 bigint, n2 bigint, n3 bigint, n4 bigint")
        d = ng.modified_discounts(coc, fallback) if method == "modified" else ng.original_discount(coc)
        discounts = {r["k"]: (r["d1"], r["d2"], r["d3"]) for r in d.collect()}
        for k in range(1, order + 1):
            discounts.setdefault(k, (0.5, 1.0, 1.5))  # an order that no sentence is long enough for
    a, gone = F.col("a"), ~F.col("kept")
    size = lambda which: [F.sum(F.when(which, a).otherwise(0)), F.count_if(which & (a == 1)), F.count_if(which & (a == 2)), F.count_if(which & (a >= 3))]
    names = [f"{side}{i}" for side in ("b", "g") for i in range(4)]
    sums = [x.alias(n) for x, n in zip(size(F.lit(True)) + size(gone), names, strict=True)]
    s = counted.groupBy("k", "hist").agg(F.sum("c").alias("n"), F.count("*").alias("types"), *sums)
    denom, types = F.col("b0").cast("double"), F.col("types").cast("double")
    if discounts is None:
        gamma = (types + F.col("g0")) / (denom + types)
    else:
        of = [F.element_at(F.array(*[F.lit(discounts[k][i]) for k in range(1, order + 1)]), F.col("k")) for i in range(3)]
        weight = lambda side: reduce(Column.__add__, [of[i] * F.col(f"{side}{i + 1}") for i in range(3)])
        # What discounts take from all n-grams, and what pruned ones leave of themselves.
        gamma = (weight("b") + F.col("g0") - weight("g")) / denom
    stats = cut(s.select("k", "hist", "n", denom.alias("denom"), types.alias("types"), gamma.alias("gamma")))
    one = stats.where("k = 1").first()
    first = (one["denom"], one["types"], one["gamma"]) if one else (1.0, 0.0, 1.0)
    known = per[1] if 1 in per else {"types": 0, "total": 0}
    return Trained(order, counted, stats, discounts, known["types"] + 1, known["total"], first)


def scores(model: Trained | Model, sentences: DataFrame, keep: list[str]) -> DataFrame:
    """``keep, pos, w, oov, p, match``: probability of every event, and the longest order that has it as an entry.

    All orders of an event are looked up in one join on (k, hist, w) and one on (k, hist), hot ones by
    broadcast, and meet again in an aggregate of at most ``order`` rows an event. A history that was
    never seen weighs 1 and adds nothing. Unknown words are ``<unk>`` and match nothing.
    """
    e = ng.grams(sentences, model.order, keep)
    if isinstance(model, Model):
        return _by_match(model, e, keep)
    salt = F.xxhash64(*keep, "pos", "k")
    entries = model.counted.select("k", "hist", "w", "c", "a", "kept")
    often = model.total * HOT
    found = left_lookup(e, entries, ["k", "hist", "w"], entries.where(F.col("c") > often), salt)
    # Order 1 has one history, known to the driver; its rows look nothing up.
    denom, types, gamma = model.first
    looked = found.withColumn("_h", F.when(F.col("k") == 1, F.concat(F.lit("\0"), salt.cast("string"))).otherwise(F.col("hist")))
    table = model.stats.where("k > 1").withColumnRenamed("hist", "_h")
    found = left_lookup(looked, table, ["k", "_h"], table.where(F.col("n") > often), salt)
    at_one = F.col("k") == 1
    own = F.when(F.col("kept"), model.own(F.col("a"), F.when(at_one, F.lit(denom)).otherwise(F.col("denom")), F.when(at_one, F.lit(types)).otherwise(F.col("types"))))
    rows = found.select(*keep, "pos", "w", "k", own.alias("own"), F.when(at_one, F.lit(gamma)).otherwise(F.col("gamma")).alias("gamma"), F.col("c").isNotNull().alias("known"))
    of = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    wide = [of(k, c).alias(f"_{c}{k}") for k in range(1, model.order + 1) for c in ("own", "gamma")]
    g = rows.groupBy(*keep, "pos", "w").agg(*wide, of(1, "known").alias("_known"), F.max(F.when(F.col("own").isNotNull(), F.col("k"))).alias("_match"))
    p = F.coalesce(F.col("_own1"), F.lit(0.0)) + F.col("_gamma1") / model.size
    for k in range(2, model.order + 1):
        p = F.coalesce(F.col(f"_own{k}"), F.lit(0.0)) + F.coalesce(F.col(f"_gamma{k}"), F.lit(1.0)) * p
    oov = ~F.col("_known")
    return g.select(*keep, "pos", F.when(oov, F.lit(ng.UNK)).otherwise(F.col("w")).alias("w"), oov.alias("oov"), p.alias("p"), F.coalesce("_match", F.lit(1)).alias("match"))


def _by_match(model: Model, events: DataFrame, keep: list[str]) -> DataFrame:
    """The scores from entries and weights: the longest match, times the weights above it."""
    salt = F.xxhash64(*keep, "pos", "k")
    one = model.entries.where("k = 1")
    unknown = one.where(F.col("w") == ng.UNK).first()
    frequent = one.orderBy(F.desc("p"), "w").limit(int(1 / HOT))
    found = left_lookup(events, model.entries, ["k", "hist", "w"], frequent, salt)
    w0 = model.backoff.where("k = 1").first()
    looked = found.withColumn("_h", F.when(F.col("k") == 1, F.concat(F.lit("\0"), salt.cast("string"))).otherwise(F.col("hist")))
    table = model.backoff.where("k > 1").withColumnRenamed("hist", "_h")
    words = frequent.select(F.lit(2).alias("k"), F.col("w").alias("_h"))
    found = left_lookup(looked, table, ["k", "_h"], table.join(F.broadcast(words), ["k", "_h"]), salt)
    gamma = F.when(F.col("k") == 1, F.lit(w0["gamma"] if w0 else 1.0)).otherwise(F.coalesce("gamma", F.lit(1.0)))
    rows = found.select(*keep, "pos", "w", "k", "p", gamma.alias("gamma"))
    g = rows.groupBy(*keep, "pos", "w").agg(F.max(F.when(F.col("p").isNotNull(), F.struct("k", "p"))).alias("_m"), F.collect_list(F.struct("k", "gamma")).alias("_all"))
    oov = F.col("_m").isNull()
    match = F.coalesce(F.col("_m.k"), F.lit(1))
    weight = F.aggregate(F.filter("_all", lambda x: x["k"] > match), F.lit(1.0), lambda acc, x: acc * x["gamma"])
    p = F.coalesce(F.col("_m.p"), F.lit(unknown["p"] if unknown else 0.0))
    return g.select(*keep, "pos", F.when(oov, F.lit(ng.UNK)).otherwise(F.col("w")).alias("w"), oov.alias("oov"), (p * weight).alias("p"), match.alias("match"))


def summary(scored: DataFrame, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Events, out-of-vocabulary rate, cross-entropy, both perplexities and the mean matched order."""
    ln = F.log10("p")
    known = ~F.col("oov")
    n, m = F.count("*"), F.count_if(known)
    total = F.sum(ln)
    some = F.sum(F.when(known, ln))
    r = lambda x: F.round(x, digits)
    return scored.groupBy(*(by or [])).agg(
        n.alias("events"), F.count_if("oov").alias("oov_events"), r(-total / n / F.log10(F.lit(2.0))).alias("bits"),
        r(F.pow(F.lit(10.0), -total / n)).alias("ppl"), r(F.pow(F.lit(10.0), -some / m)).alias("ppl_known"), r(F.avg(F.when(known, F.col("match")))).alias("mean_match"),
    )


def matched_orders(scored: DataFrame) -> DataFrame:
    """``match, events``: how far back events were matched, out-of-vocabulary ones left out."""
    return scored.where(~F.col("oov")).groupBy("match").agg(F.count("*").alias("events"))


def entry_counts(model: Trained | Model) -> DataFrame:
    return model.entries.groupBy("k").agg(F.count("*").alias("entries"))


def mass(model: Trained | Model, histories: DataFrame) -> DataFrame:
    """``hist, mass``: sum of P(w | hist) over all words for a stated set of full histories (column hist, words joined by SEP); 1 for a proper model.

    Only the entries of a history and its suffixes differ from scaled lower orders, so the sum
    telescopes: what order k gives to its entries, plus gamma times what the lower order gives to all words
    less what it gives to those entries.
    """
    h = histories.select("hist").distinct().withColumn("_full", F.col("hist"))
    levels = []
    for k in range(model.order, 0, -1):
        e = model.entries.where(F.col("k") == k)
        own = h.join(e, "hist").select("_full", "w", "p", F.lit(k).alias("k"))
        g = h.join(model.backoff.where(F.col("k") == k).drop("k"), "hist", "left").select("_full", F.lit(k).alias("k"), F.coalesce("gamma", F.lit(1.0)).alias("gamma"))
        levels.append((own, g))
        h = h.select(ng.suffix(F.col("hist")).alias("hist"), "_full")
    rows, weights = levels[0]
    for own, g in levels[1:]:
        rows, weights = rows.unionByName(own), weights.unionByName(g)
    best = rows.groupBy("_full", "w").agg(F.max(F.struct("k", "p")).alias("m")).select("_full", "m.k", "m.p")

    per = best.groupBy("_full", "k").agg(F.sum("p").alias("s")).join(_products(weights), ["_full", "k"])
    return per.groupBy(F.col("_full").alias("hist")).agg(F.sum(F.col("s") * F.col("f")).alias("mass"))


def _products(weights: DataFrame) -> DataFrame:
    """``_full, k, f``: the product of the back-off weights of all orders above k."""
    upper = weights.select("_full", F.col("k").alias("kk"), "gamma")
    pairs = weights.select("_full", "k").join(upper, "_full").where("kk > k")
    f = pairs.groupBy("_full", "k").agg(F.product("gamma").alias("f"))
    return weights.select("_full", "k").join(f, ["_full", "k"], "left").select("_full", "k", F.coalesce("f", F.lit(1.0)).alias("f"))


def quantised(model: Trained | Model, bits: int = 8) -> Model:
    """The model with probabilities and back-off weights replaced by the means of 2^bits equal-sized bins per order."""
    bins = 1 << bits

    def by_bins(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
        cuts = df.groupBy("k").agg(F.percentile_approx(F.log10(value), F.array(*[F.lit(i / bins) for i in range(1, bins)]), 100_000).alias("_cuts"))
        b = df.join(F.broadcast(cuts), "k").withColumn("_b", F.size(F.filter("_cuts", lambda x: x <= F.log10(value))))
        means = b.groupBy("k", "_b").agg(F.pow(F.lit(10.0), F.avg(F.log10(value))).alias("_v"))
        return b.join(F.broadcast(means), ["k", "_b"]).select(*keys, F.col("_v").alias(value))

    return Model(model.order, cut(by_bins(model.entries, "p", ["k", "hist", "w"])), cut(by_bins(model.backoff.where("gamma > 0"), "gamma", ["k", "hist"])), model.words)
