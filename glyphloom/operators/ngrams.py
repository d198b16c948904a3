"""N-gram events, counts and the statistics that smoothing needs, as relations.

A sentence has one leading ``<s>``, which is context only, and a final ``</s>``, which is predicted.
N-grams never cross sentences. A history is its words joined by SEP; the empty string is the history of
order 1. NULL token lists count as empty ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOS, EOS, UNK, RARE = "<s>", "</s>", "<unk>", "<rare>"
SEP = "\u001f"


def padded(tokens: Column) -> Column:
    return F.concat(F.array(F.lit(BOS)), F.coalesce(tokens, F.array().cast("array<string>")), F.array(F.lit(EOS)))


def join_words(words: Column) -> Column:
    return F.array_join(words, SEP)


def suffix(history: Column) -> Column:
    """The history without its first word."""
    at = F.instr(history, SEP)
    return F.when(at > 0, F.substring(history, at + 1, F.char_length(history))).otherwise(F.lit(""))


def first_word(history: Column) -> Column:
    return F.substring_index(history, SEP, 1)


def positions(sentences: DataFrame, keep: list[str], tokens: str = "tokens") -> DataFrame:
    """``keep, pos, seq``: a row per predicted word; seq is the padded sentence and seq[pos + 1] the word (0-based)."""
    seq = sentences.select(*keep, padded(F.col(tokens)).alias("seq"))
    return seq.select(*keep, F.explode(F.sequence(F.lit(0), F.size("seq") - 2)).alias("pos"), "seq")


def grams(sentences: DataFrame, order: int, keep: list[str] | None = None, tokens: str = "tokens") -> DataFrame:
    """``keep, pos, k, hist, w`` for every event and every order it has a whole history for.

    Both explosions run in one generated loop that holds the sentence's words by reference; building the rows as one array per sentence took four times as long.
    """
    keep = keep or []
    p = positions(sentences, keep, tokens)
    ks = F.sequence(F.lit(1), F.least(F.lit(order), F.col("pos") + 2))
    e = p.select(*keep, "pos", F.explode(ks).alias("k"), "seq")
    return e.select(*keep, "pos", "k", join_words(F.slice("seq", F.col("pos") + 3 - F.col("k"), F.col("k") - 1)).alias("hist"), F.element_at("seq", F.col("pos") + 2).alias("w"))


def counts(sentences: DataFrame, order: int, tokens: str = "tokens") -> DataFrame:
    """``k, hist, w, c`` for k = 1..order, in one shuffle with map-side sums."""
    return grams(sentences, order, tokens=tokens).groupBy("k", "hist", "w").agg(F.count("*").alias("c"))


def both_counts(sentences: DataFrame, order: int, tokens: str = "tokens") -> DataFrame:
    """``k, hist, w, c, a``: raw and adjusted counts of every n-gram in two aggregates.

    Each counted n-gram adds its count to itself and one distinct left word to the n-gram without its first word.
    """
    c = counts(sentences, order, tokens)
    shorter = c.where((F.col("k") > 1)).select((F.col("k") - 1).alias("k"), suffix(F.col("hist")).alias("hist"), "w", F.lit(0).cast("bigint").alias("c"), F.lit(1).cast("bigint").alias("_left"))
    every = c.withColumn("_left", F.lit(0).cast("bigint")).unionByName(shorter).groupBy("k", "hist", "w").agg(F.sum("c").alias("c"), F.sum("_left").alias("_left"))
    raw = (F.col("k") == order) | ((F.col("k") > 1) & (first_word(F.col("hist")) == BOS))
    return every.select("k", "hist", "w", "c", F.when(raw, F.col("c")).otherwise(F.col("_left")).alias("a"))


def adjusted(c: DataFrame, order: int) -> DataFrame:
    """``k, hist, w, a``: raw counts at the highest order and after ``<s>``, else the number of distinct words to the left."""
    raw = c.where((F.col("k") == order) | ((F.col("k") > 1) & (first_word(F.col("hist")) == BOS))).select("k", "hist", "w", F.col("c").alias("a"))
    left = c.where(F.col("k") > 1).select((F.col("k") - 1).alias("k"), suffix(F.col("hist")).alias("hist"), "w")
    left = left.where((F.col("k") == 1) | (first_word(F.col("hist")) != BOS)).groupBy("k", "hist", "w").agg(F.count("*").alias("a"))
    return raw.unionByName(left)


def history_stats(a: DataFrame, count: str = "a") -> DataFrame:
    """``k, hist, denom, types, b1, b2, b3``: total, distinct followers, followers with counts 1, 2, 3 and more."""
    x = F.col(count)
    return a.groupBy("k", "hist").agg(F.sum(x).alias("denom"), F.count("*").alias("types"), F.count_if(x == 1).alias("b1"), F.count_if(x == 2).alias("b2"), F.count_if(x >= 3).alias("b3"))


def counts_of_counts(a: DataFrame, count: str = "a") -> DataFrame:
    return a.groupBy("k").agg(*[F.count_if(F.col(count) == i).alias(f"n{i}") for i in (1, 2, 3, 4)])


def modified_discounts(coc: DataFrame, fallback: tuple[float, float, float] | None = None) -> DataFrame:
    """``k, d1, d2, d3`` by the published formula. Where a count of counts is 0 or a discount leaves [0, k]: the fallback, or an error."""
    n = [F.col(f"n{i}").cast("double") for i in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    good = reduce(lambda a, b: a & b, [F.col(f"n{i}") > 0 for i in (1, 2, 3, 4)])
    guarded = [F.when(good, x) for x in d]
    fine = good & reduce(lambda a, b: a & b, [(x >= 0) & (x <= i + 1) for i, x in enumerate(guarded)])
    if fallback is None:
        other = [F.raise_error(F.concat(F.lit("no discounts for order "), F.col("k").cast("string"))).cast("double")] * 3
    else:
        other = [F.lit(float(x)) for x in fallback]
    return coc.select("k", *[F.when(fine, x).otherwise(o).alias(f"d{i + 1}") for i, (x, o) in enumerate(zip(guarded, other, strict=True))])


def original_discount(coc: DataFrame) -> DataFrame:
    """``k, d1, d2, d3`` all equal to n1 / (n1 + 2 n2)."""
    d = F.coalesce(F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0)), F.lit(0.5))
    return coc.select("k", d.alias("d1"), d.alias("d2"), d.alias("d3"))


def discount(count: Column) -> Column:
    return F.when(count >= 3, F.col("d3")).when(count == 2, F.col("d2")).when(count == 1, F.col("d1")).otherwise(F.lit(0.0))


def vocabulary(sentences: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``w, c`` of the words of the sentences, without boundary symbols."""
    return sentences.select(F.explode(tokens).alias("w")).groupBy("w").agg(F.count("*").alias("c"))


def restricted(sentences: DataFrame, words: DataFrame, other: str, key: str, tokens: str = "tokens") -> DataFrame:
    """``sentences`` with every token that ``words`` (column w) doesn't have replaced by ``other``; a shuffle join, so any size of vocabulary works. Rows with an equal ``key`` stay apart."""
    rest = [c for c in sentences.columns if c not in (key, tokens)]
    e = sentences.select(key, *rest, F.monotonically_increasing_id().alias("_row"), tokens).select(key, *rest, "_row", F.posexplode_outer(tokens).alias("_p", "_w"))
    known = words.select(F.col("w").alias("_w"), F.lit(True).alias("_in")).distinct()
    mapped = e.join(known, "_w", "left").withColumn("_w", F.when(F.col("_in"), F.col("_w")).when(F.col("_w").isNotNull(), F.lit(other)))
    whole = F.transform(F.array_sort(F.collect_list(F.when(F.col("_p").isNotNull(), F.struct("_p", "_w")))), lambda x: x["_w"])
    return mapped.groupBy("_row", key, *rest).agg(whole.alias(tokens)).drop("_row")
