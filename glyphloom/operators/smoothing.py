"""The trigram smoothing laboratory: five smoothers as expressions over one joined row per event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.joins import left_lookup
from glyphloom.operators import ngrams as ng
from glyphloom.operators.lm import HOT
from glyphloom.plans.materialise import cut


def event_statistics(train: DataFrame, events: DataFrame, keys: list[str], fallback: tuple[float, float, float] = (0.5, 1.0, 1.5)) -> DataFrame:
    """One row per event (``events``: keys, pos, k, hist, w for k up to 3) with all raw and adjusted counts of its n-grams and histories.

    Columns c1..c3, d2, d3, t2, t3 (raw counts, history totals, distinct followers), a1..a3 and their
    histories' totals z1..z3 and discounted masses g1..g3, the discounted counts e1..e3, and V, N, types, total_a, gamma_1.
    """
    counted = cut(ng.both_counts(train, 3))
    total = counted.where("k = 1").agg(F.sum("c").alias("N"), F.count("*").alias("types")).withColumn("V", F.col("types") + 1)  # one row
    often = (total.first()["N"] or 0) * HOT
    d = F.broadcast(ng.modified_discounts(ng.counts_of_counts(counted), fallback))  # three rows
    sums = counted.groupBy("k", "hist").agg(F.sum("c").alias("rd"), F.count("*").alias("rt"), F.sum("a").alias("z"), *[F.count_if(x).alias(f"b{i + 1}") for i, x in enumerate((F.col("a") == 1, F.col("a") == 2, F.col("a") >= 3))])
    stats = cut(sums.join(d, "k").select("k", "hist", "rd", "rt", "z", ((F.col("d1") * F.col("b1") + F.col("d2") * F.col("b2") + F.col("d3") * F.col("b3")) / F.col("z")).alias("g")))
    entries = counted.join(d, "k").select("k", "hist", "w", "c", F.greatest(F.col("a") - ng.discount(F.col("a")), F.lit(0.0)).alias("e"))
    salt = F.xxhash64(*keys, "pos", "k")
    row = left_lookup(events, entries, ["k", "hist", "w"], entries.where(F.col("c") > often), salt)
    row = left_lookup(row, stats, ["k", "hist"], stats.where((F.col("k") == 1) | (F.col("rd") > often)), salt)
    pick = lambda col, k, zero: F.coalesce(F.max(F.when(F.col("k") == k, F.col(col))), F.lit(zero))
    wide = []
    for k in (1, 2, 3):
        wide += [pick("c", k, 0).alias(f"c{k}"), pick("rd", k, 0).alias(f"d{k}"), pick("rt", k, 0).alias(f"t{k}"), pick("e", k, 0.0).alias(f"e{k}"), pick("z", k, 0).alias(f"z{k}"), pick("g", k, 0.0).alias(f"g{k}")]
    uni = stats.where("k = 1").select(F.col("z").alias("total_a"), F.col("g").alias("gamma_1"))  # one row
    out = row.groupBy(*keys, "pos", "w").agg(*wide, F.max("k").alias("context"))
    return out.join(F.broadcast(total)).join(F.broadcast(uni))


def p_mle() -> Column:
    d, c = F.when(F.col("context") == 3, F.col("d3")).otherwise(F.col("d2")), F.when(F.col("context") == 3, F.col("c3")).otherwise(F.col("c2"))
    return F.when(d > 0, c / d).otherwise(F.lit(0.0))


def p_addk(k: Column | float) -> Column:
    k = F.lit(k) if isinstance(k, int | float) else k
    d, c = F.when(F.col("context") == 3, F.col("d3")).otherwise(F.col("d2")), F.when(F.col("context") == 3, F.col("c3")).otherwise(F.col("c2"))
    return (c + k) / (d + k * F.col("V"))


def p_jm(l3: Column | float, l2: Column | float, l1: Column | float, l0: Column | float) -> Column:
    """Linear interpolation; the weights of orders whose history was never seen go to the others in proportion."""
    l3, l2, l1, l0 = (F.lit(x) if isinstance(x, int | float) else x for x in (l3, l2, l1, l0))
    has2, has3 = F.col("d2") > 0, (F.col("context") == 3) & (F.col("d3") > 0)
    top = l1 * F.col("c1") / F.col("N") + l0 / F.col("V") + F.when(has2, l2 * F.col("c2") / F.col("d2")).otherwise(0.0) + F.when(has3, l3 * F.col("c3") / F.col("d3")).otherwise(0.0)
    return top / (l1 + l0 + F.when(has2, l2).otherwise(0.0) + F.when(has3, l3).otherwise(0.0))


def p_witten_bell() -> Column:
    p1 = (F.col("c1") + F.col("types") / F.col("V")) / (F.col("N") + F.col("types"))
    p2 = F.when(F.col("d2") > 0, (F.col("c2") + F.col("t2") * p1) / (F.col("d2") + F.col("t2"))).otherwise(p1)
    return F.when(F.col("d3") > 0, (F.col("c3") + F.col("t3") * p2) / (F.col("d3") + F.col("t3"))).otherwise(p2)


def p_kneser_ney() -> Column:
    p1 = F.col("e1") / F.col("total_a") + F.col("gamma_1") / F.col("V")
    p2 = F.when(F.col("z2") > 0, F.col("e2") / F.col("z2") + F.col("g2") * p1).otherwise(p1)
    return F.when(F.col("z3") > 0, F.col("e3") / F.col("z3") + F.col("g3") * p2).otherwise(p2)


def perplexity(p: Column, digits: int = 4) -> list[Column]:
    """Events, events of probability zero, perplexity (infinite if there is any) and that over the others."""
    zero, n = F.count_if(p <= 0), F.count("*")
    total = F.sum(F.when(p > 0, F.log2(p)))
    over = F.round(F.pow(F.lit(2.0), -total / F.nullif(n - zero, F.lit(0))), digits)
    return [n.alias("events"), zero.alias("zero_events"), F.when(zero > 0, F.lit(float("inf"))).otherwise(F.round(F.pow(F.lit(2.0), -total / n), digits)).alias("ppl"), over.alias("ppl_nonzero")]
