"""Annotated paragraphs: ``id/m  [word/tag  word/tag]type ...`` to tokens, sentences and a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the annotation: end marks, closing marks, the extra mark after a tag.
END_MARKS, CLOSERS, EXTRA = ["。", "！", "？"], ["”", "’", "」", "』", "）", "】", "》"], "/%"
ID = r"^(\d{8})-(\d{2})-(\d{3})-(\d{3})"


def parse_token(token: Column) -> Column:
    """``word, tag, starts_entity, entity_type``: the last slash parts word and tag; of a doubled tag the first counts; no slash: no tag."""
    opened = token.startswith("[")
    body = F.when(opened, F.substring(token, 2, F.char_length(token))).otherwise(token)
    body = F.regexp_replace(body, "/%$", "")
    tagged = F.instr(body, "/") > 0
    word = F.regexp_extract(body, "^(.*)/([^/]*)$", 1)
    tag = F.regexp_extract(body, "^(.*)/([^/]*)$", 2)
    entity = F.regexp_extract(tag, r"\](\w+)$", 1)
    plain = F.regexp_replace(tag, r"\](\w+)$", "")
    doubled = F.instr(word, "/") > 0
    return F.struct(
        F.when(~tagged, body).when(doubled, F.substring_index(word, "/", 1)).otherwise(word).alias("word"),
        F.when(~tagged, F.lit(None)).when(doubled, F.regexp_extract(word, "^[^/]*/(.*)$", 1)).otherwise(plain).alias("tag"),
        opened.alias("starts_entity"),
        F.when(tagged & (entity != ""), entity).alias("entity_type"),
    )


def parsed(lines: DataFrame, value: str = "value", *, strict: bool = True) -> DataFrame:
    """``lines`` with ``date, page, article, paragraph`` and ``parsed``: its tokens in order, those without a word left out.

    NULL and blank lines are dropped. A line without an id raises an error, as nothing tells which article it belongs to; if not
    ``strict`` it has NULLs there and all its pieces are tokens.
    """
    v = F.trim(F.col(value))
    rows = lines.where(F.coalesce(v, F.lit("")) != "")
    pieces = F.filter(F.split(v, r"(?U)\s+"), lambda x: x != "")
    ok = v.rlike(ID)
    none = F.raise_error(F.concat(F.lit("no id in the line: "), F.left(v, F.lit(40)))) if strict else F.lit(None).cast("string")
    part = lambda i: F.when(ok, F.regexp_extract(v, ID, i)).otherwise(none)
    out = rows.select("*", *[part(i + 1).alias(n) for i, n in enumerate(("date", "page", "article", "paragraph"))], F.transform(F.slice(pieces, F.when(ok, 2).otherwise(1), F.size(pieces)), parse_token).alias("_all"))
    return out.withColumn("parsed", F.filter("_all", lambda t: t["word"] != "")).withColumn("empty_words", F.size("_all") - F.size("parsed")).drop("_all")


def segmented(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, sent_no, tokens, tags`` from ``keys, parsed``: cut after a run of end marks and the closing marks right behind it.

    What follows the last end mark is a sentence of its own. One paragraph is one window, so it has to fit a task.
    """
    t = tokens.select(*keys, F.posexplode("parsed").alias("pos", "t")).select(*keys, "pos", "t.word", "t.tag")
    w = Window.partitionBy(*keys).orderBy("pos")
    mark = F.coalesce(F.col("tag") == "w", F.lit(False))
    end, closer = mark & F.col("word").isin(END_MARKS), mark & F.col("word").isin(CLOSERS)
    t = t.withColumn("_kind", F.when(end, 2).when(closer, 1).otherwise(0))
    # A closer belongs to the end mark if only closers stand between: the number of the last token of another kind tells.
    last_other = F.max(F.when(F.col("_kind") != 1, F.struct("pos", "_kind"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("_in", (F.col("_kind") == 2) | ((F.col("_kind") == 1) & F.coalesce(last_other["_kind"] == 2, F.lit(False))))
    before = F.lag("_in").over(w)
    # After a closer a new end mark begins another sentence, as it would after a word.
    starts = F.coalesce(before, F.lit(False)) & (~F.col("_in") | ((F.col("_kind") == 2) & (F.lag("_kind").over(w) == 1)))
    t = t.withColumn("sent_no", (F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("int"))
    g = t.groupBy(*keys, "sent_no").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "tag"))).alias("_t"))
    return g.select(*keys, "sent_no", F.transform("_t", lambda x: x["word"]).alias("tokens"), F.transform("_t", lambda x: x["tag"]).alias("tags"))


def profile(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row on the shape of the annotation: lines, ids, tokens, tags, entities, slashes, widths, end marks."""
    v = F.coalesce(F.col(value), F.lit(""))
    raw = lines.agg(F.count("*").alias("lines"), F.count_if(F.trim(v) == "").alias("blank_lines"))
    p = parsed(lines, value)
    per = p.agg(
        F.countDistinct("date").alias("dates"), F.countDistinct("date", "page", "article").alias("articles"), F.sum(F.size("parsed")).alias("tokens"), F.sum("empty_words").alias("empty_words"),
        F.sum(F.size(F.filter("parsed", lambda t: t["tag"].isNull()))).alias("untagged"), F.sum(F.size(F.filter("parsed", lambda t: t["starts_entity"]))).alias("entity_starts"),
        F.sum(F.size(F.filter("parsed", lambda t: t["entity_type"].isNotNull()))).alias("entity_ends"), F.sum(F.size(F.filter("parsed", lambda t: t["word"].rlike("[0-9A-Za-z]")))).alias("half_width"),
        F.sum(F.size(F.filter("parsed", lambda t: t["word"].rlike("[０-９Ａ-Ｚａ-ｚ]")))).alias("full_width"), F.sum(F.size(F.filter("parsed", lambda t: t["word"].isin(END_MARKS)))).alias("end_marks"),
        F.max(F.size("parsed")).cast("bigint").alias("longest_line"),
    )
    return raw.join(per)


def full_profile(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row with what ``profile`` doesn't tell: ids missing, first and last date, pages, extra marks, tags raw and plain, slashes in words, nested and unclosed entities, lines of several sentences, entity types and the 25 most frequent tags.

    An entity is open from its first word to the word that names its type; one that opens inside another is nested, one that the line doesn't close is unclosed.
    """
    rows = lines.where(F.trim(F.coalesce(F.col(value), F.lit(""))) != "")
    v = F.trim(F.col(value))
    pieces = F.filter(F.split(v, r"(?U)\s+"), lambda x: x != "")
    ok = v.rlike(ID)
    page = F.regexp_extract(v, ID, 2)
    raw = F.transform(F.slice(pieces, F.when(ok, 2).otherwise(1), F.size(pieces)), lambda t: F.struct(t.alias("text"), parse_token(t).alias("t")))
    p = rows.select(ok.alias("ok"), F.regexp_extract(v, ID, 1).alias("date"), page.alias("page"), raw.alias("_t"))
    tagged = p.withColumn("_t", F.filter("_t", lambda x: x["t"]["tag"].isNotNull())).withColumn("_extra", F.size(F.filter(F.transform("_t", lambda x: x["text"]), lambda x: x.endswith(EXTRA))))
    start = F.struct(F.lit(False).alias("open"), F.lit(0).alias("nested"))

    def walk(state: Column, x: Column) -> Column:
        t = x["t"]
        return F.struct(
            F.when(t["entity_type"].isNotNull(), F.lit(False)).otherwise(t["starts_entity"] | state["open"]).alias("open"),
            (state["nested"] + F.when(t["starts_entity"] & state["open"], 1).otherwise(0)).alias("nested"),
        )

    slashes = lambda x: F.char_length(F.regexp_replace(F.regexp_replace(F.regexp_replace(x["text"], r"^\[+", ""), "/%$", ""), "[^/]", ""))
    ends = lambda x: (x["t"]["tag"] == "w") & x["t"]["word"].isin(END_MARKS)
    lined = tagged.withColumn("_s", F.aggregate("_t", start, walk))
    per = lined.agg(
        F.count_if(~F.col("ok")).alias("no_id"), F.min(F.when(F.col("ok"), F.col("date"))).alias("first_date"), F.max(F.when(F.col("ok"), F.col("date"))).alias("last_date"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("page")))), " ").alias("pages"), F.sum("_extra").cast("bigint").alias("extra_marks"),
        F.sum(F.size(F.filter("_t", lambda x: slashes(x) > 1))).cast("bigint").alias("slash_in_word"), F.sum("_s.nested").cast("bigint").alias("nested"), F.count_if("_s.open").alias("unclosed"),
        F.count_if(F.size(F.filter("_t", ends)) > 1).alias("multi_end_lines"),
    )
    tokens = tagged.select(F.explode("_t").alias("x")).select(F.substring_index("x.text", "/", -1).alias("raw"), F.col("x.t.tag").alias("tag"), F.col("x.t.entity_type").alias("type"))
    kinds = tokens.agg(F.countDistinct("raw").alias("raw_tags"), F.countDistinct("tag").alias("plain_tags"))
    listed = lambda d: d.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "c"))), lambda x: F.concat(x["c"], F.lit(":"), (-x["m"]).cast("string"))), " "))
    types = listed(tokens.where("type IS NOT NULL").groupBy(F.col("type").alias("c")).agg(F.count("*").alias("n"))).toDF("entity_types")
    top = listed(tokens.groupBy(F.col("tag").alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c").limit(25)).toDF("top_tags")
    return per.join(kinds).join(types).join(top)


def plain_dialect(token: Column) -> Column:
    """A token of another dialect as ``word, tag``: readings in braces and a final ``!`` are dropped, all tags of punctuation become ``w``."""
    body = F.regexp_replace(F.regexp_replace(token, r"\{[^{}]*\}", ""), "!$", "")
    t = parse_token(body)
    return F.struct(t["word"].alias("word"), F.when(t["tag"].startswith("w"), F.lit("w")).otherwise(t["tag"]).alias("tag"))


def tag_counts(p: DataFrame, limit: int = 25) -> DataFrame:
    """The most frequent tags; ties in the order of the tags."""
    return p.select(F.explode("parsed").alias("t")).where("t.tag IS NOT NULL").groupBy(F.col("t.tag").alias("tag")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(limit)
