"""Long exact spans shared between records, by fixed-block anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.plans.materialise import cut

#: Anchors in more contexts than this are looked up by whole spans instead; both ways are exact.
HOT_CONTEXTS = 64


def _common(a: Column, b: Column, most: int, from_end: bool) -> Column:
    """Length of the common prefix (or suffix) of two strings of up to ``most`` characters."""
    side = (lambda x, k: F.right(x, k)) if from_end else (lambda x, k: F.left(x, k))
    same = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda k: (F.char_length(a) >= k) & (F.char_length(b) >= k) & (side(a, k) == side(b, k)))
    return F.size(same)


#: Characters of a piece of text; what is looked up in a text walks a piece or two, never the whole.
PIECE = 128
_CUT = "\uffff"


def _pieces(text: Column) -> Column:
    """The text in pieces of PIECE characters, by one replacement. (U+FFFF, which is no character, becomes U+FFFE first.)"""
    plain = F.replace(text, F.lit(_CUT), F.lit("\ufffe"))
    return F.split(F.regexp_replace(plain, f"((?s).{{{PIECE}}})", f"$1{_CUT}"), _CUT)


def _at(pieces: Column, start: Column, length: int) -> Column:
    """``length`` characters (at most PIECE) from the 0-based ``start``, cut at both ends of the text."""
    begin = F.greatest(start, F.lit(0)).cast("int")
    j = F.floor(begin / PIECE).cast("int")
    near = F.concat(F.coalesce(F.try_element_at(pieces, j + 1), F.lit("")), F.coalesce(F.try_element_at(pieces, j + 2), F.lit("")))
    return F.substring(near, begin % PIECE + 1, F.greatest(start + length - begin, F.lit(0)).cast("int"))


def _hashes(pieces: Column, width: int) -> Column:
    """64-bit hashes of all runs of ``width`` characters, in order."""
    whole = F.zip_with(pieces, F.slice(pieces, F.lit(2), F.size(pieces)), lambda a, b: F.concat(a, F.coalesce(F.left(b, F.lit(width - 1)), F.lit(""))))
    long = F.filter(whole, lambda x: F.char_length(x) >= width)
    return F.flatten(F.transform(long, lambda x: F.transform(F.sequence(F.lit(1), F.char_length(x) - (width - 1)), lambda i: F.xxhash64(F.substring(x, i, F.lit(width))))))


def shared_spans(probes: DataFrame, references: DataFrame, *, key: str, text: str, least: int = 30) -> DataFrame:
    """``key, start_pos, end_pos``: stretches of each probe covered by spans of ``least`` code points or more of another key's reference.

    A span of ``least`` characters holds a whole block of ``least // 2`` of the blocks that cut the
    reference, so the reference's non-overlapping blocks are indexed, every rolling window of a probe looks its block
    up, and a hit is extended to both sides. The look-up ships 64-bit hashes only; what stands around a
    block is fetched for the windows and blocks that met. Each block reaches far enough that the extensions of neighbouring hits meet; their union is the
    union of the maximal exact repeats. Equal contexts are merged before they are joined (with the least and the
    greatest key that has them), so a passage that a third of all records hold is joined once.
    Anchors with more than HOT_CONTEXTS contexts are compared by whole spans, which needs no extension.

    NULL keys and NULL or short texts share nothing; a key may have several rows, which aren't compared with
    one another; empty tables give an empty result; other columns are ignored. Work grows with the length of a text.
    """
    b = least // 2
    around = least - b
    texts = lambda d: d.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where("_k IS NOT NULL AND _t IS NOT NULL").where(F.char_length("_t") >= least)
    n = F.char_length("_t")
    refs = cut(texts(references).groupBy("_t").agg(F.min("_k").alias("_lo"), F.max("_k").alias("_hi")).select(_pieces(F.col("_t")).alias("_c"), n.alias("_n"), "_lo", "_hi"))
    each = texts(probes).select("_k", _pieces(F.col("_t")).alias("_c"))
    other = (F.col("_lo") != F.col("_k")) | (F.col("_hi") != F.col("_k"))
    places = F.sequence(F.lit(0), F.col("_n") - b, F.lit(b))
    blocks = refs.select("_lo", "_hi", F.explode(F.transform(places, lambda p: F.xxhash64(_at(F.col("_c"), p, b)))).alias("_h")).groupBy("_h").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    met = cut(each.select("_k", F.posexplode(_hashes(F.col("_c"), b)).alias("_p", "_h")).join(blocks, "_h").where(other).select("_k", "_p", "_h").distinct())
    hashes = met.select("_h").distinct()
    cuts = refs.select("_c", "_lo", "_hi", F.explode(places).alias("_p")).withColumn("_h", F.xxhash64(_at(F.col("_c"), F.col("_p"), b))).join(hashes, "_h", "left_semi")
    contexts = (
        cuts.select(_at(F.col("_c"), F.col("_p"), b).alias("_block"), _at(F.col("_c"), F.col("_p") - around, around).alias("_left"), _at(F.col("_c"), F.col("_p") + b, around).alias("_right"), "_lo", "_hi")
        .groupBy("_block", "_left", "_right")
        .agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    )
    contexts = cut(contexts)
    hot = contexts.groupBy("_block").agg(F.count("*").alias("_n")).withColumn("_hot", F.col("_n") > HOT_CONTEXTS).select("_block", "_hot")
    contexts = contexts.join(hot, "_block")
    # A key with several texts meets its hits in each of them; those that aren't there find no context.
    windows = cut(
        met.join(each, "_k").select("_k", "_p", _at(F.col("_c"), F.col("_p"), b).alias("_block"), _at(F.col("_c"), F.col("_p") - around, around).alias("_pl"), _at(F.col("_c"), F.col("_p") + b, around).alias("_pr")).distinct()
    )
    cold = windows.join(contexts.where(~F.col("_hot")), "_block").where(other)
    cold = cold.withColumn("_x", _common(F.col("_left"), F.col("_pl"), around, True)).withColumn("_y", _common(F.col("_right"), F.col("_pr"), around, False))
    found = cold.where(F.col("_x") + F.col("_y") + b >= least).select("_k", (F.col("_p") - F.col("_x")).alias("_s"), (F.col("_p") + b + F.col("_y")).alias("_e"))

    # Whole spans around the blocks of hot anchors: one key per place of the block in the span.
    def spans(left: Column, block: Column, right: Column) -> Column:
        whole = F.concat(left, block, right)
        starts = F.sequence(F.lit(0), F.char_length(left))
        return F.filter(F.transform(starts, lambda i: F.struct((F.char_length(left) - i).alias("back"), F.substring(whole, i + 1, F.lit(least)).alias("span"))), lambda s: F.char_length(s["span"]) == least)

    ref_spans = contexts.where("_hot").select("_block", F.inline(spans(F.col("_left"), F.col("_block"), F.col("_right"))), "_lo", "_hi").groupBy("_block", "back", "span").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    probe_spans = windows.join(hot.where("_hot"), "_block").select("_k", "_p", "_block", F.inline(spans(F.col("_pl"), F.col("_block"), F.col("_pr"))))
    warm = probe_spans.join(ref_spans, ["_block", "back", "span"]).where(other).select("_k", (F.col("_p") - F.col("back")).alias("_s"), (F.col("_p") - F.col("back") + least).alias("_e"))

    # The intervals of one record, at most one per start, are one window.
    ends = found.unionByName(warm).groupBy("_k", "_s").agg(F.max("_e").alias("_e"))
    w = Window.partitionBy("_k").orderBy("_s")
    fresh = F.coalesce(F.col("_s") > F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    numbered = ends.withColumn("_f", fresh.cast("int")).withColumn("_part", F.sum("_f").over(w))
    return numbered.groupBy("_k", "_part").agg(F.min("_s").cast("int").alias("start_pos"), F.max("_e").cast("int").alias("end_pos")).select(F.col("_k").alias(key), "start_pos", "end_pos")


def shared_share(probes: DataFrame, stretches: DataFrame, *, key: str, text: str) -> DataFrame:
    """``key, n_chars, shared_chars, shared_share``, one row per non-NULL key; empty and NULL texts have length and share 0."""
    size = probes.where(F.col(key).isNotNull()).groupBy(key).agg(F.coalesce(F.max(F.char_length(text)), F.lit(0)).alias("n_chars"))
    hit = stretches.groupBy(F.col(key).alias("_k")).agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("_c"))
    shared = F.coalesce(F.col("_c"), F.lit(0)).cast("bigint")
    return size.join(hit, F.col(key) == F.col("_k"), "left").select(key, "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(F.lit(0.0)).alias("shared_share"))
