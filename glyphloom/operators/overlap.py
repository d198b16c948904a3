"""How much of a text stands in the training sentences, and how much it repeats itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.operators import ngrams as ng

#: Texts of a block: larger groups are paired block by block, so that no task holds a whole group's pairs.
PAIRED = 100


def _spans(df: DataFrame, keep: list[str], tokens: str, longest: int, shortest: int = 1) -> DataFrame:
    """``keep, i, n, h``: every run of n words from place i, as a hash (two of 64 bits: equal hashes are equal runs)."""
    t = df.select(*keep, F.col(tokens).alias("_t")).where(F.size("_t") >= shortest)
    at = t.select(*keep, "_t", F.explode(F.sequence(F.lit(1), F.size("_t") - (shortest - 1))).alias("i"))
    n = at.select(*keep, "_t", "i", F.explode(F.sequence(F.lit(shortest), F.least(F.lit(longest), F.size("_t") - F.col("i") + 1))).alias("n"))
    run = F.slice("_t", F.col("i"), F.col("n"))
    return n.select(*keep, "i", "n", F.struct(F.xxhash64(run).alias("a"), F.xxhash64(F.lit(1), run).alias("b")).alias("h"))


def found_spans(queries: DataFrame, keep: list[str], train: DataFrame, *, longest: int = 12, tokens: str = "tokens") -> DataFrame:
    """``keep, i, n``: the runs of up to ``longest`` words that stand in a training sentence.

    The queries' runs are collected first and the training runs are reduced to those by a semi-join before
    they are made distinct, so what is kept is bounded by the queries and not by the training text.
    """
    wanted = _spans(queries, keep, tokens, longest)
    hashes = wanted.select("n", "h").distinct()
    there = _spans(train, [], "tokens", longest).join(hashes, ["n", "h"], "left_semi").distinct()
    return wanted.join(there, ["n", "h"], "left_semi").select(*keep, "i", "n")


def overlap_rate(queries: DataFrame, key: str, found: DataFrame, n: int, tokens: str = "tokens") -> DataFrame:
    """``key, rate``: share of a text's n-word runs that stand in training; NULL for texts under n words."""
    hits = found.where(F.col("n") == n).groupBy(key).agg(F.count("*").alias("_h"))
    total = F.size(tokens) - (n - 1)
    return queries.select(key, total.alias("_t")).join(hits, key, "left").select(key, F.when(F.col("_t") > 0, F.coalesce("_h", F.lit(0)) / F.col("_t")).alias("rate"))


def longest_copied(queries: DataFrame, key: str, found: DataFrame, start: str) -> DataFrame:
    """``key, span``: the longest run in training that ends after the first ``start`` words; 0 if there is none."""
    f = found.join(queries.select(key, start), key).where(F.col("i") + F.col("n") - 1 > F.col(start))
    best = f.groupBy(key).agg(F.max("n").alias("_n"))
    return queries.select(key).join(best, key, "left").select(key, F.coalesce("_n", F.lit(0)).alias("span"))


def source_sentences(queries: DataFrame, key: str, found: DataFrame, train: DataFrame, *, least: int = 4, tokens: str = "tokens") -> DataFrame:
    """``key, sent_id, words``: for the longest copied run of each text, the first training sentence that has it, and how far the copy reaches there in both directions."""
    longest = found.where(F.col("n") >= least).groupBy(key).agg(F.max(F.struct("n", (-F.col("i")).alias("i"))).alias("_m"))
    best = longest.select(key, F.col("_m.n").alias("n"), (-F.col("_m.i")).alias("i")).join(queries.select(key, F.col(tokens).alias("_q")), key)
    run = F.slice("_q", F.col("i"), F.col("n"))
    wanted = best.select(key, "_q", "i", "n", F.struct(F.xxhash64(run).alias("a"), F.xxhash64(F.lit(1), run).alias("b")).alias("h"))
    # Runs meet by hash first, in one pass over the training text; only the sentences that are chosen are fetched.
    lengths = [r["n"] for r in wanted.select("n").distinct().collect()]  # at most as many as the longest run has words
    if not lengths:
        return queries.select(key).limit(0).select(key, F.lit(0).cast("bigint").alias("sent_id"), F.lit(0).alias("words"))
    there = _spans(train, ["sent_id"], "tokens", max(lengths), min(lengths)).where(F.col("n").isin(lengths))
    there = there.join(wanted.select("n", "h").distinct(), ["n", "h"], "left_semi").groupBy("n", "h").agg(F.min(F.struct("sent_id", F.col("i").alias("j"))).alias("m"))
    chosen = wanted.join(there, ["n", "h"]).select(key, "_q", "i", "n", "m.sent_id", "m.j")
    texts = train.join(chosen.select("sent_id").distinct(), "sent_id", "left_semi").groupBy("sent_id").agg(F.min("tokens").alias("_s"))
    out = chosen.join(texts, "sent_id").select(key, "_q", "i", "n", F.struct("sent_id", "j", "_s").alias("m"))
    q, s, i, j, n = F.col("_q"), F.col("m._s"), F.col("i"), F.col("m.j"), F.col("n")

    def run_of_equal(count: Column, a: Column, b: Column, step: int) -> Column:
        """How many steps in a row the words at a + step x and b + step x are equal."""
        same = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda x: (count >= x) & (F.try_element_at(q, a + step * x) == F.try_element_at(s, b + step * x)))
        stop = F.array_position(F.concat(F.transform(same, lambda y: F.coalesce(y, F.lit(False))), F.array(F.lit(False))), F.lit(False))
        return stop - 1

    back = run_of_equal(F.least(i, j) - 1, i, j, -1)
    on = run_of_equal(F.least(F.size(q) - (i + n - 1), F.size(s) - (j + n - 1)), i + n - 1, j + n - 1, 1)
    return out.select(key, F.col("m.sent_id").alias("sent_id"), (n + back + on).cast("int").alias("words"))


def repetition(tokens: Column) -> dict[str, Column]:
    """Length, type-token ratio and shares of repeated two- and three-word runs; 0 where there are none."""
    n = F.size(F.coalesce(tokens, F.array().cast("array<string>")))

    def rate(k: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(tokens, i, F.lit(k)), ng.SEP))
        return F.when(n >= k, 1 - F.size(F.array_distinct(runs)) / (n - (k - 1))).otherwise(F.lit(0.0))

    return {"length": n, "type_token_ratio": F.when(n > 0, F.size(F.array_distinct(tokens)) / n).otherwise(F.lit(0.0)), "repeated_2gram_rate": rate(2), "repeated_3gram_rate": rate(3)}


def mean_jaccard(texts: DataFrame, key: str, within: str, tokens: str = "tokens") -> DataFrame:
    """``within, pairs, mean_jaccard``: mean likeness of the word sets of all pairs of texts in a group.

    All pairs are made, whatever the size of a group. A group is dealt into blocks of about PAIRED texts by hash, and every pair of
    blocks is a join key of its own; the result is a sum over them.
    """
    t = texts.select(within, F.col(key).alias("_id"), F.array_distinct(tokens).alias("_s")).where((F.size("_s") > 0) & F.col(key).isNotNull())
    sizes = t.groupBy(within).agg(F.ceil(F.count("*") / PAIRED).cast("int").alias("_n"), F.count("*").alias("_c")).where("_c > 1")
    dealt = t.join(sizes, within).withColumn("_own", F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int"))
    a = dealt.select(within, F.col("_id").alias("_ia"), F.col("_s").alias("_sa"), F.col("_own").alias("_a"), F.explode(F.sequence("_own", F.col("_n") - 1)).alias("_b"))
    b = dealt.select(within, F.col("_id").alias("_ib"), F.col("_s").alias("_sb"), F.explode(F.sequence(F.lit(0), "_own")).alias("_a"), F.col("_own").alias("_b"))
    likeness = F.size(F.array_intersect("_sa", "_sb")) / F.size(F.array_union("_sa", "_sb"))
    return a.join(b, [within, "_a", "_b"]).where("_a < _b OR _ia < _ib").groupBy(within).agg(F.count("*").alias("pairs"), F.avg(likeness).alias("mean_jaccard"))
