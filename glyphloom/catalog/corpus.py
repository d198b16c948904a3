"""Preparing the corpus: annotation, sentences, vocabularies, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.catalog import Query
from glyphloom.catalog.lm import CORPUS_SQL, corpus
from glyphloom.functions.keys import seeded
from glyphloom.operators import annotated, components, sampling
from glyphloom.operators import ngrams as ng
from glyphloom.sources.tables import table


def _paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_first").where("para_id IS NOT NULL").select("para_id", "value").distinct()


def tagged_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Every token of the annotated paragraphs: word, tag, entity marks."""
    p = annotated.parsed(_paragraphs(spark, folder))
    return p.select("para_id", F.posexplode("parsed").alias("pos", "t")).select("para_id", "pos", "t.word", "t.tag", "t.starts_entity", "t.entity_type")


def sentence_segments(spark: SparkSession, folder: str) -> DataFrame:
    s = annotated.segmented(annotated.parsed(_paragraphs(spark, folder)), ["para_id"])
    return s.select("para_id", "sent_no", F.array_join("tokens", " ").alias("words"), F.array_join(F.zip_with("tokens", "tags", lambda w, t: F.when(t.isNull(), w).otherwise(F.concat(w, F.lit("/"), t))), " ").alias("tagged"))


def format_profile(spark: SparkSession, folder: str) -> DataFrame:
    return annotated.profile(table(spark, folder, "raw_first"))


def top_tags(spark: SparkSession, folder: str) -> DataFrame:
    return annotated.tag_counts(annotated.parsed(_paragraphs(spark, folder)))


def clean_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences, articles, tokens, both vocabularies and sentences without an end mark."""
    s = annotated.segmented(annotated.parsed(_paragraphs(spark, folder)), ["para_id"])
    w = s.select("para_id", F.explode(F.arrays_zip("tokens", "tags")).alias("t"))
    tokens = w.agg(F.count("*").alias("tokens"), F.countDistinct("t.tokens").alias("words"), F.countDistinct("t.tokens", "t.tags").alias("tagged_words"))
    open_ = ~F.exists("tokens", lambda x: x.isin(annotated.END_MARKS))
    return s.agg(F.count("*").alias("sentences"), F.countDistinct(F.substring("para_id", 1, 15)).alias("articles"), F.count_if(open_).alias("no_end_mark")).join(tokens)


_P = r"""pp AS (SELECT DISTINCT para_id, value FROM raw_first WHERE para_id IS NOT NULL AND trim(coalesce(value, '')) <> ''),
pt AS (SELECT para_id, list_filter(string_split_regex(trim(value), '\s+'), lambda x: x <> '')[2:] AS tk FROM pp),
tk0 AS (SELECT para_id, unnest(tk) AS tok, generate_subscripts(tk, 1) AS i FROM pt),
tk1 AS (SELECT para_id, i, starts_with(tok, '[') AS starts_entity, regexp_replace(CASE WHEN starts_with(tok, '[') THEN tok[2:] ELSE tok END, '/%$', '') AS body FROM tk0),
tk2 AS (SELECT para_id, i, starts_entity, body, contains(body, '/') AS tagged, regexp_extract(body, '^(.*)/([^/]*)$', 1) AS w0, regexp_extract(body, '^(.*)/([^/]*)$', 2) AS t0 FROM tk1),
tk3 AS (SELECT para_id, i, starts_entity, CASE WHEN NOT tagged THEN body WHEN contains(w0, '/') THEN split_part(w0, '/', 1) ELSE w0 END AS word,
  CASE WHEN NOT tagged THEN NULL WHEN contains(w0, '/') THEN regexp_extract(w0, '^[^/]*/(.*)$', 1) ELSE regexp_replace(t0, '\](\w+)$', '') END AS tag,
  CASE WHEN tagged AND regexp_extract(t0, '\](\w+)$', 1) <> '' THEN regexp_extract(t0, '\](\w+)$', 1) END AS entity_type FROM tk2),
tok AS (SELECT para_id, (row_number() OVER (PARTITION BY para_id ORDER BY i) - 1)::INT AS pos, word, tag, starts_entity, entity_type FROM tk3 WHERE word <> ''),
kd AS (SELECT *, CASE WHEN tag = 'w' AND word IN ('。', '！', '？') THEN 2 WHEN tag = 'w' AND word IN ('”', '’', '」', '』', '）', '】', '》') THEN 1 ELSE 0 END AS kind FROM tok),
ki AS (SELECT *, kind = 2 OR (kind = 1 AND coalesce((max(CASE WHEN kind <> 1 THEN pos * 10 + kind END) OVER (PARTITION BY para_id ORDER BY pos)) % 10 = 2, false)) AS inn FROM kd),
ks AS (SELECT *, coalesce(lag(inn) OVER w, false) AND (NOT inn OR (kind = 2 AND lag(kind) OVER w = 1)) AS st FROM ki WINDOW w AS (PARTITION BY para_id ORDER BY pos)),
sg AS (SELECT *, (sum(st::INT) OVER (PARTITION BY para_id ORDER BY pos) + 1)::INT AS sent_no FROM ks)"""


def _sentences(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder)


def type_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens, types, words seen once and their share, per split."""
    c = _sentences(spark, folder).select("split", F.explode("tokens").alias("w")).groupBy("split", "w").agg(F.count("*").alias("c"))
    return c.groupBy("split").agg(F.sum("c").alias("tokens"), F.count("*").alias("types"), F.count_if(F.col("c") == 1).alias("once")).withColumn("once_share", F.round(F.col("once") / F.col("types"), 8))


def vocab_min2(spark: SparkSession, folder: str) -> DataFrame:
    return ng.vocabulary(corpus(spark, folder, "train")).where("c >= 2")


def vocab_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return ng.vocabulary(corpus(spark, folder, "train")).orderBy(F.desc("c"), "w").limit(1000)


def vocab_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """The most frequent words that make up 80 % of the training text."""
    return sampling.coverage(ng.vocabulary(corpus(spark, folder, "train")), 0.8)


def core_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Words that training, dev and test text all have."""
    parts = [corpus(spark, folder, s).select(F.explode("tokens").alias("w")) for s in ("train", "dev", "test")]
    return parts[0].intersect(parts[1]).intersect(parts[2])


def rare_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences with words seen once in training replaced by a placeholder."""
    train = corpus(spark, folder, "train")
    mapped = ng.restricted(_sentences(spark, folder).select("sent_id", "tokens"), ng.vocabulary(train).where("c >= 2"), ng.RARE, "sent_id")
    return mapped.select("sent_id", F.array_join("tokens", " ").alias("words"))


def oov_by_split(spark: SparkSession, folder: str) -> DataFrame:
    known = ng.vocabulary(corpus(spark, folder, "train")).select("w", F.lit(True).alias("known"))
    t = corpus(spark, folder, "dev", "test").select("split", F.explode("tokens").alias("w")).join(known, "w", "left")
    return t.groupBy("split").agg(F.count("*").alias("tokens"), F.count_if(F.col("known").isNull()).alias("oov")).withColumn("oov_rate", F.round(F.col("oov") / F.col("tokens"), 8))


def char_tokens(spark: SparkSession, folder: str) -> DataFrame:
    c = corpus(spark, folder, "train").select(F.explode(F.flatten(F.transform("tokens", lambda t: F.split(t, "")))).alias("ch"))
    return c.groupBy("ch").agg(F.count("*").alias("c"))


def month_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences and words of the articles up to June, by the month in the article's id."""
    s = _sentences(spark, folder).withColumn("month", F.substring("article_id", 1, 6)).where("month <= '198006'")
    return s.groupBy("month").agg(F.count("*").alias("sentences"), F.sum(F.size("tokens")).alias("words"))


def nested_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Training articles in a seeded order until they have 5,000 words."""
    return sampling.nested_articles(corpus(spark, folder, "train"), 5000, 20260929)


def position_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.sampled(ng.positions(corpus(spark, folder, "test"), ["sent_id"]).select("sent_id", "pos"), 200, 20260930, ["sent_id", "pos"])


def article_components(spark: SparkSession, folder: str) -> DataFrame:
    """Articles joined by a shared sentence of at least ten words: the least article of each one's component."""
    s = table(spark, folder, "sentences").where(F.size("tokens") >= 10)
    links = s.select(F.col("article_id").alias("node"), F.sha2(F.array_join("tokens", ng.SEP), 256).alias("key"))
    members, _ = components.groups(table(spark, folder, "sentences").select(F.col("article_id").alias("node")), links)
    return members.select(F.col("node").alias("article_id"), F.col("root").alias("group_id"))


def group_census(spark: SparkSession, folder: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = article_components(spark, folder).groupBy("group_id").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("groups"))


def article_split(spark: SparkSession, folder: str) -> DataFrame:
    """80/10/10 by hash of the group, so a group stays whole: counts of articles and sentences per new split."""
    g = article_components(spark, folder)
    h = seeded(20260929, F.col("group_id")) % 10
    placed = g.withColumn("new_split", F.when(h < 8, "train").when(h == 8, "dev").otherwise("test"))
    s = table(spark, folder, "sentences").select("article_id", "sent_id")
    return placed.join(s, "article_id").groupBy("new_split").agg(F.countDistinct("article_id").alias("articles"), F.count("*").alias("sentences"))


def long_sentence_leak(spark: SparkSession, folder: str) -> DataFrame:
    """Test sentences of at least ten words that stand verbatim in training."""
    test = corpus(spark, folder, "test").where(F.size("tokens") >= 10)
    train = corpus(spark, folder, "train").where(F.size("tokens") >= 10).select("tokens")
    return test.join(train, "tokens", "left_semi").select("sent_id")


def tag_ambiguity(spark: SparkSession, folder: str) -> DataFrame:
    """Each word's most frequent tag and how many it has, over tagged sentences."""
    t = table(spark, folder, "sentences").where("tags IS NOT NULL").select(F.explode(F.arrays_zip("tokens", "tags")).alias("t")).select("t.tokens", "t.tags")
    c = t.groupBy(F.col("tokens").alias("w"), F.col("tags").alias("tag")).agg(F.count("*").alias("c"))
    return c.groupBy("w").agg(F.max_by("tag", F.struct("c", "tag")).alias("top_tag"), F.count("*").alias("tags"), F.sum("c").alias("c"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (tagged_parse, sentence_segments, format_profile, top_tags, clean_stats, type_stats, vocab_min2, vocab_top_k, vocab_coverage, core_vocabulary, rare_mapping, oov_by_split, char_tokens, month_filter, nested_sample, position_sample, article_components, group_census, article_split, long_sentence_leak, tag_ambiguity)}
_T = f"WITH {CORPUS_SQL}, tw AS (SELECT split, sent_id, article_id, unnest(tokens) AS w FROM sen), vc AS (SELECT w, count(*) AS c FROM tw WHERE split = 'train' GROUP BY w)"
_COMP = """WITH RECURSIVE k AS (SELECT DISTINCT article_id, array_to_string(tokens, chr(31)) AS t FROM sentences WHERE len(tokens) >= 10),
e AS (SELECT DISTINCT a.article_id AS a, b.article_id AS b FROM k a JOIN k b USING (t)),
r(a, b) AS (SELECT DISTINCT article_id, article_id FROM sentences UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
gr AS (SELECT a AS article_id, min(b) AS group_id FROM r GROUP BY a)"""
SQL = {
    "tagged_parse": f"WITH {_P} SELECT * FROM tok",
    "sentence_segments": f"WITH {_P} SELECT para_id, sent_no, string_agg(word, ' ' ORDER BY pos) AS words, string_agg(CASE WHEN tag IS NULL THEN word ELSE word || '/' || tag END, ' ' ORDER BY pos) AS tagged FROM sg GROUP BY para_id, sent_no",
    "top_tags": f"WITH {_P} SELECT tag, count(*) AS n FROM tok WHERE tag IS NOT NULL GROUP BY tag ORDER BY n DESC, tag LIMIT 25",
    "clean_stats": f"WITH {_P}, se AS (SELECT para_id, sent_no, max((word IN ('。', '！', '？'))::INT) AS e FROM sg GROUP BY para_id, sent_no) SELECT (SELECT count(*) FROM se) AS sentences, (SELECT count(DISTINCT para_id[1:15]) FROM se) AS articles, (SELECT count(*) FROM se WHERE e = 0) AS no_end_mark, count(*) AS tokens, count(DISTINCT word) AS words, count(DISTINCT (word, tag)) FILTER (tag IS NOT NULL) AS tagged_words FROM tok",
    "type_stats": _T + " SELECT split, sum(c)::BIGINT AS tokens, count(*) AS types, count(*) FILTER (c = 1) AS once, round(count(*) FILTER (c = 1) / count(*), 8) AS once_share FROM (SELECT split, w, count(*) AS c FROM tw GROUP BY split, w) GROUP BY split",
    "vocab_min2": _T + " SELECT * FROM vc WHERE c >= 2",
    "vocab_top_k": _T + " SELECT * FROM vc ORDER BY c DESC, w LIMIT 1000",
    "vocab_coverage": _T + ", rk AS (SELECT w, c, sum(c) OVER (ORDER BY c DESC, w) - c AS before, sum(c) OVER () AS total FROM vc) SELECT w, c FROM rk WHERE before < 0.8::DOUBLE * total",
    "core_vocabulary": _T + " SELECT w FROM tw WHERE split = 'train' INTERSECT SELECT w FROM tw WHERE split = 'dev' INTERSECT SELECT w FROM tw WHERE split = 'test'",
    "rare_mapping": _T + " SELECT sent_id, string_agg(CASE WHEN vc.c >= 2 THEN x.t ELSE '<rare>' END, ' ' ORDER BY i) AS words FROM (SELECT sent_id, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS i FROM sen) x LEFT JOIN vc ON x.t = vc.w GROUP BY sent_id",
    "oov_by_split": _T + " SELECT split, count(*) AS tokens, count(*) FILTER (vc.w IS NULL) AS oov, round(count(*) FILTER (vc.w IS NULL) / count(*), 8) AS oov_rate FROM tw LEFT JOIN vc USING (w) WHERE split <> 'train' GROUP BY split",
    "char_tokens": _T + " SELECT ch, count(*) AS c FROM (SELECT unnest(string_split(w, '')) AS ch FROM tw WHERE split = 'train') GROUP BY ch",
    "month_filter": f"WITH {CORPUS_SQL} SELECT article_id[1:6] AS month, count(*) AS sentences, sum(len(tokens))::BIGINT AS words FROM sen WHERE article_id[1:6] <= '198006' GROUP BY 1",
    "nested_sample": f"WITH {CORPUS_SQL}, sz AS (SELECT article_id, sum(len(tokens))::BIGINT AS words, ('0x' || md5('20260929:' || article_id)[1:12])::BIGINT AS h FROM sen WHERE split = 'train' GROUP BY article_id) SELECT article_id, words FROM (SELECT *, coalesce(sum(words) OVER (ORDER BY h, article_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sz) WHERE before < 5000",
    "position_sample": f"WITH {CORPUS_SQL}, ps AS (SELECT sent_id, unnest(range(0, len(tokens) + 1))::INT AS pos FROM sen WHERE split = 'test') SELECT sent_id, pos FROM ps ORDER BY ('0x' || md5('20260930:' || sent_id || ':' || pos)[1:12])::BIGINT, sent_id, pos LIMIT 200",
    "article_components": _COMP + " SELECT * FROM gr",
    "group_census": _COMP + " SELECT size, count(*) AS groups FROM (SELECT group_id, count(*) AS size FROM gr GROUP BY group_id) GROUP BY size",
    "article_split": _COMP + ", pl AS (SELECT *, ('0x' || md5('20260929:' || group_id)[1:12])::BIGINT % 10 AS h FROM gr) SELECT CASE WHEN h < 8 THEN 'train' WHEN h = 8 THEN 'dev' ELSE 'test' END AS new_split, count(DISTINCT article_id) AS articles, count(*) AS sentences FROM pl JOIN sentences USING (article_id) GROUP BY 1",
    "long_sentence_leak": f"WITH {CORPUS_SQL} SELECT sent_id FROM sen WHERE split = 'test' AND len(tokens) >= 10 AND tokens IN (SELECT tokens FROM sen WHERE split = 'train')",
    "tag_ambiguity": "WITH t AS (SELECT unnest(tokens) AS w, unnest(tags) AS tag FROM sentences WHERE tags IS NOT NULL), c AS (SELECT w, tag, count(*) AS c FROM t GROUP BY w, tag), r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY c DESC, tag DESC) AS r FROM c) SELECT w, max(CASE WHEN r = 1 THEN tag END) AS top_tag, count(*) AS tags, sum(c)::BIGINT AS c FROM r GROUP BY w",
}
SQL["format_profile"] = f"""WITH {_P.replace("SELECT DISTINCT para_id, value FROM raw_first WHERE para_id IS NOT NULL AND", "SELECT row_number() OVER () AS para_id, value FROM raw_first WHERE")}
SELECT (SELECT count(*) FROM raw_first) AS lines, (SELECT count(*) FROM raw_first WHERE trim(coalesce(value, '')) = '') AS blank_lines,
(SELECT count(DISTINCT trim(value)[1:8]) FROM pp) AS dates, (SELECT count(DISTINCT trim(value)[1:15]) FROM pp) AS articles, count(*) AS tokens, (SELECT count(*) FROM tk3 WHERE word = '') AS empty_words,
count(*) FILTER (tag IS NULL) AS untagged, count(*) FILTER (starts_entity) AS entity_starts, count(*) FILTER (entity_type IS NOT NULL) AS entity_ends,
count(*) FILTER (regexp_matches(word, '[0-9A-Za-z]')) AS half_width, count(*) FILTER (regexp_matches(word, '[０-９Ａ-Ｚａ-ｚ]')) AS full_width, count(*) FILTER (word IN ('。', '！', '？')) AS end_marks,
(SELECT max(n) FROM (SELECT count(*) AS n FROM tok GROUP BY para_id)) AS longest_line FROM tok"""
