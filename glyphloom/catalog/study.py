"""Splits by group, census of the annotation, models beside one another, and studies of generated text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphloom.catalog import Query
from glyphloom.catalog.corpus import _COMP, _P, article_components
from glyphloom.catalog.lm import CORPUS_SQL, SUMMARY_SQL, _FREQ, _scored, _train, corpus, event_rows, model_sql
from glyphloom.catalog.lm import _event_sql as event_sql
from glyphloom.catalog.text import _curve_sql, _poisson_sql, learning_curve, pair_discrimination
from glyphloom.catalog.text import SQL as TEXT_SQL
from glyphloom.operators import annotated, components, evaluation, lm, sampling, smoothing, splitting
from glyphloom.operators import ngrams as ng
from glyphloom.plans.materialise import cut
from glyphloom.sources.tables import table

SHARES = {"train": 0.8, "dev": 0.1, "test": 0.1}


def article_split_greedy(spark: SparkSession, folder: str) -> DataFrame:
    """Articles into splits by whole groups: the largest groups first, each to the split that lacks most articles."""
    g = article_components(spark, folder)
    placed = splitting.greedy_split(g.groupBy(F.col("group_id").alias("root")).agg(F.count("*").alias("size")), proportions=SHARES)
    return g.join(placed, g["group_id"] == placed["root"]).select("article_id", "split")


def split_projection(spark: SparkSession, folder: str) -> DataFrame:
    """The given split carried over to the annotated paragraphs of the same articles: paragraphs and articles per split."""
    split = table(spark, folder, "articles").where("split IS NOT NULL").groupBy("article_id").agg(F.max("split").alias("split"))
    rows = table(spark, folder, "raw_first").where("para_id IS NOT NULL").select("para_id", F.substring("para_id", 1, 15).alias("article_id")).distinct()
    parts = [splitting.projected(rows, split, s).agg(F.lit(s).alias("split"), F.count("*").alias("paragraphs"), F.countDistinct("article_id").alias("articles")) for s in SHARES]
    return reduce(DataFrame.unionByName, parts)


def format_profile_full(spark: SparkSession, folder: str) -> DataFrame:
    return annotated.full_profile(table(spark, folder, "raw_first"))


def rendering_words(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs that both systems have: how many have the same words, the same words and tags, and differ in either."""
    def words(name: str) -> DataFrame:
        rows = table(spark, folder, name).where("para_id IS NOT NULL AND trim(coalesce(value, '')) <> ''").groupBy("para_id").agg(F.max("value").alias("value"))
        p = annotated.parsed(rows)
        return p.select("para_id", F.transform("parsed", lambda t: t["word"]).alias("w"), F.transform("parsed", lambda t: F.coalesce(t["tag"], F.lit(""))).alias("t"))

    a, b = words("raw_first"), words("raw_second").withColumnsRenamed({"w": "w2", "t": "t2"})
    j = a.join(b, "para_id")
    same, tags = F.col("w") == F.col("w2"), F.col("t") == F.col("t2")
    return j.agg(F.count("*").alias("shared"), F.count_if(same).alias("same_words"), F.count_if(same & tags).alias("same_both"), F.count_if(~same).alias("other_words"), F.count_if(same & ~tags).alias("other_tags"))


def dialect_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Words and tags in the common dialect: readings, trailing marks and kinds of punctuation dropped; counts per tag."""
    rows = table(spark, folder, "raw_second").where("para_id IS NOT NULL AND trim(coalesce(value, '')) <> ''").select("para_id", "value").distinct()
    pieces = F.filter(F.split(F.trim("value"), r"(?U)\s+"), lambda x: x != "")
    t = rows.select(F.explode(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), annotated.plain_dialect)).alias("t")).where("t.word <> '' AND t.tag IS NOT NULL")
    return t.groupBy("t.tag").agg(F.count("*").alias("n"), F.countDistinct("t.word").alias("words"))


def annotation_census(spark: SparkSession, folder: str) -> DataFrame:
    """Per file: lines, blank ones, and tokens with an extra mark, an entity, a doubled tag, no tag."""
    v = F.trim(F.coalesce("value", F.lit("")))
    pieces = F.filter(F.split(v, r"(?U)\s+"), lambda x: x != "")
    p = table(spark, folder, "raw_first").select("file", (v == "").alias("blank"), F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda x: F.struct(x.alias("x"), annotated.parse_token(x).alias("t"))).alias("p"))
    n = lambda f: F.coalesce(F.sum(F.when(~F.col("blank"), F.size(F.filter("p", f)))), F.lit(0)).cast("bigint")
    return p.groupBy("file").agg(
        F.count("*").alias("lines"), F.count_if("blank").alias("blank_lines"), n(lambda x: x["x"].endswith("/%")).alias("extra"), n(lambda x: x["t"]["starts_entity"]).alias("entities"),
        n(lambda x: x["t"]["tag"].contains("/")).alias("doubled"), n(lambda x: x["t"]["tag"].isNull()).alias("untagged"),
    )


def span_cover(spark: SparkSession, folder: str) -> DataFrame:
    """For each test sentence of six and more words: which words spell the six characters from the middle of it, as first and last place."""
    t = corpus(spark, folder, "test").where(F.size("tokens") >= 6).select("sent_id", "tokens", F.array_join("tokens", "").alias("text"))
    t = t.withColumn("wanted", F.expr("substring(text, cast(char_length(text) / 2 as int) + 1, 6)")).withColumn("at", F.instr("text", F.col("wanted")) - 1)
    ends = F.transform(F.sequence(F.lit(1), F.size("tokens")), lambda i: F.aggregate(F.slice("tokens", F.lit(1), i), F.lit(0), lambda a, x: a + F.char_length(x)))
    t = t.withColumn("ends", ends)
    first = F.size(F.filter("ends", lambda e: e <= F.col("at"))) + 1
    last = F.size(F.filter("ends", lambda e: e < F.col("at") + F.char_length("wanted"))) + 1
    return t.select("sent_id", "wanted", first.cast("int").alias("first"), F.least(last, F.size("tokens")).cast("int").alias("last"))


def grid_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The generation grid's cells without a cut by mass, with the texts of the shown seeds."""
    g = table(spark, folder, "generations").where("top_p = 1.0").groupBy("gen_id").agg(F.max_by(F.struct("model_order", "temperature", "top_k", "seed"), "finished_at").alias("r")).select("r.*")
    return g.groupBy("model_order", "temperature", "top_k").agg(F.count("*").alias("texts"), F.countDistinct("seed").alias("seeds"))


def smoother_disagreements(spark: SparkSession, folder: str) -> DataFrame:
    """Both ends of the ranking of events by how far Kneser-Ney and Witten-Bell differ, of those whose history was seen ten times."""
    e = event_rows(spark, folder).where("context = 3 AND d3 >= 10")
    x = e.select("sent_id", "pos", F.round(F.log10(smoothing.p_kneser_ney() / smoothing.p_witten_bell()), 8).alias("ratio"))
    ends = [x.orderBy(c, "sent_id", "pos").limit(10).withColumn("end", F.lit(n)) for n, c in (("kn", F.desc("ratio")), ("wb", F.asc("ratio")))]
    return ends[0].unionByName(ends[1])


def first_unseen(spark: SparkSession, folder: str) -> DataFrame:
    """The first twenty test events, in order, whose bigram is known and whose trigram isn't."""
    e = event_rows(spark, folder).where("context = 3 AND c2 > 0 AND c3 = 0 AND d3 > 0").select("sent_id", "pos", "w", F.col("c2").alias("bigram"))
    return e.orderBy("sent_id", "pos").limit(20)


def pruned_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries per order with and without pruning, and how many it removes."""
    m = lm.train(_train(spark, folder), 3, prune=[0, 0, 1])
    return m.counted.groupBy("k").agg(F.count("*").alias("entries"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("removed"))


def pruned_effect(spark: SparkSession, folder: str) -> DataFrame:
    """Mean matched order with and without pruning, and each training-count bucket's share of the loss that pruning adds."""
    train, test = _train(spark, folder), corpus(spark, folder, "test")
    full = lm.train(train, 3)
    a = lm.scores(full, test, ["sent_id"]).select("sent_id", "pos", "oov", F.log10("p").alias("pa"), F.col("match").alias("ma"))
    b = lm.scores(lm.train(train, 3, prune=[0, 0, 1]), test, ["sent_id"]).select("sent_id", "pos", F.log10("p").alias("pb"), F.col("match").alias("mb"))
    e = ng.grams(test, 3, ["sent_id"]).where("k = 3").join(full.counted.where("k = 3"), ["k", "hist", "w"], "left").select("sent_id", "pos", F.coalesce("c", F.lit(0)).alias("c"))
    c = F.col("c")
    bucket = F.when(F.col("oov"), "oov").when(c.isNull(), "short").when(c == 0, "0").when(c == 1, "1").when(c <= 4, "2-4").otherwise("5+")
    rows = cut(a.join(b, ["sent_id", "pos"]).join(e, ["sent_id", "pos"], "left").withColumn("bucket", bucket))
    g = rows.groupBy("bucket").agg(F.count("*").alias("events"), F.round(F.avg("ma"), 6).alias("order_full"), F.round(F.avg("mb"), 6).alias("order_pruned"), F.sum(F.col("pa") - F.col("pb")).alias("loss"))
    total = rows.agg(F.sum(F.col("pa") - F.col("pb")).alias("all"))  # one row
    return g.join(total).select("bucket", "events", "order_full", "order_pruned", (F.round(F.col("loss") / F.col("all"), 6) + 0.0).alias("loss_share"))


def added_corpora(spark: SparkSession, folder: str) -> DataFrame:
    """A trigram model of the first training month, and of that with all later months laid behind it, on the same test text."""
    train, test = cut(_train(spark, folder)), cut(corpus(spark, folder, "test"))
    month = F.substring("article_id", 1, 6)
    first = train.agg(F.min(month).alias("m")).first()["m"]
    one, later = train.where(month == F.lit(first)), train.where(month != F.lit(first))
    parts = []
    for name, own in (("first", one), ("all", one.unionByName(later))):
        s = lm.summary(lm.scores(lm.train(own, 3), test, ["sent_id"]))
        parts.append(s.select(F.lit(name).alias("corpus"), "events", "oov_events", "ppl"))
    return parts[0].unionByName(parts[1])


def marginal_gain(spark: SparkSession, folder: str) -> DataFrame:
    """What each step of the learning curve gains: perplexity points per 1,000 further words."""
    w = Window.orderBy("words")  # one row per stated sample
    c = cut(learning_curve(spark, folder))
    d = c.select("target", "words", "ppl", (F.col("words") - F.lag("words").over(w)).alias("dw"), (F.lag("ppl").over(w) - F.col("ppl")).alias("dp"))
    return d.where("dw IS NOT NULL").select("target", F.round(F.col("dp") / F.col("dw") * 1000, 6).alias("gain"))


def oov_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """What a word outside the vocabulary costs: the word trigram model's bits for it beside the bits of a character 5-gram model for its characters.

    Character events carry the place of their word, so the two meet by sentence and word.
    """
    train, test = cut(_train(spark, folder)), cut(corpus(spark, folder, "test"))
    chars = lambda d: d.withColumn("tokens", F.flatten(F.transform("tokens", lambda t: F.split(t, ""))))
    word = lm.scores(lm.train(train, 3), test, ["sent_id"]).where("oov").select("sent_id", "pos", (-F.log2("p")).alias("word_bits"))
    char = lm.scores(lm.train(chars(train), 5), chars(test), ["sent_id"]).select("sent_id", F.col("pos").alias("cp"), (-F.log2("p")).alias("bits"))
    of = test.select("sent_id", F.flatten(F.transform("tokens", lambda t, i: F.transform(F.split(t, ""), lambda _: i))).alias("_w")).select("sent_id", F.posexplode("_w").alias("cp", "pos"))
    spelt = char.join(of, ["sent_id", "cp"]).join(word.select("sent_id", "pos"), ["sent_id", "pos"], "left_semi").groupBy("sent_id", "pos").agg(F.sum("bits").alias("char_bits"))
    j = word.join(spelt, ["sent_id", "pos"], "left")
    return j.agg(F.count("*").alias("words"), F.round(F.avg("word_bits"), 6).alias("word_bits"), F.round(F.avg("char_bits"), 6).alias("char_bits"))


def prefix_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Per prompt: texts, mean and standard deviation of their lengths, share that ended, and distinct first words."""
    g = table(spark, folder, "generations").groupBy("gen_id").agg(F.max_by(F.struct("prompt", "tokens", "hit_eos"), "finished_at").alias("r"))
    g = g.select(F.array_join("r.prompt", " ").alias("prompt"), F.size("r.tokens").alias("n"), F.col("r.hit_eos").cast("double").alias("e"), F.try_element_at("r.tokens", F.lit(1)).alias("first"))
    return g.groupBy("prompt").agg(F.count("*").alias("texts"), F.round(F.avg("n"), 6).alias("mean_length"), F.round(F.stddev_pop("n"), 6).alias("sd_length"), F.round(F.avg("e"), 6).alias("ended"), F.countDistinct("first").alias("first_words"))


def paired_bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    """The mean difference of two models' decisions on the same sentence pairs, with a bootstrap interval."""
    b = evaluation.paired_bootstrap(cut(pair_discrimination(spark, folder)), "sent_id", "kn", "sb")
    return b.select("pairs", *[F.round(c, 6).alias(c) for c in ("difference", "low", "high")])


def core_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    """Closed vocabularies by rank and by coverage: how much of the training text they cover, and perplexity over the words that all of them have, as each model sees them."""
    train, test = cut(_train(spark, folder)), cut(corpus(spark, folder, "test"))
    freq = cut(ng.vocabulary(train))
    kinds = {"top_300": cut(freq.orderBy(F.desc("c"), "w").limit(300)), "cover_80": cut(sampling.coverage(freq, 0.8)), "min_2": freq.where("c >= 2")}
    core = reduce(lambda a, b: a.join(b.select("w"), "w", "left_semi"), [x.select("w") for x in kinds.values()]).withColumn("core", F.lit(True))
    core = cut(core)
    total = freq.agg(F.sum("c").alias("all"))
    out = []
    for name, words in kinds.items():
        a, b = (cut(ng.restricted(d.select("sent_id", "tokens"), words.select("w"), ng.RARE, "sent_id")) for d in (train, test))
        s = lm.scores(lm.train(a, 3), b, ["sent_id"]).join(core, "w", "left")
        part = words.agg(F.sum("c").alias("c"), F.count("*").alias("size")).join(total).select("size", F.round(F.col("c") / F.col("all"), 6).alias("covered"))
        ppl = s.agg(F.round(F.pow(F.lit(10.0), -F.avg(F.log10("p"))), 4).alias("ppl"), F.count("core").alias("core_events"), F.round(F.pow(F.lit(10.0), -F.avg(F.when(F.col("core"), F.log10("p")))), 4).alias("core_ppl"))
        out.append(part.join(ppl).select(F.lit(name).alias("vocabulary"), "size", "covered", "ppl", "core_events", "core_ppl"))
    return reduce(DataFrame.unionByName, out)


def nested_positions(spark: SparkSession, folder: str) -> DataFrame:
    """A sample of test positions, and which of them a smaller sample has, drawn in the same order: the smaller lies inside the larger."""
    p = ng.positions(corpus(spark, folder, "test"), ["sent_id"]).select("sent_id", "pos")
    big = cut(sampling.sampled(p, 300, 20260930, ["sent_id", "pos"]))
    small = sampling.sampled(big, 100, 20260930, ["sent_id", "pos"]).withColumn("_s", F.lit(True))
    return big.join(small, ["sent_id", "pos"], "left").select("sent_id", "pos", F.coalesce("_s", F.lit(False)).alias("ranked"))


def tagged_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The prompts of the generations with each word's most frequent tag in the training text; words that it never tags have none."""
    t = corpus(spark, folder, "train").where("tags IS NOT NULL").select(F.explode(F.arrays_zip("tokens", "tags")).alias("t")).groupBy(F.col("t.tokens").alias("w"), F.col("t.tags").alias("tag")).agg(F.count("*").alias("c"))
    best = t.groupBy("w").agg(F.max_by("tag", F.struct("c", "tag")).alias("tag"))
    p = table(spark, folder, "generations").select("prompt").distinct().select(F.array_join("prompt", " ").alias("prompt"), F.posexplode("prompt").alias("i", "w"))
    word = F.when(F.col("tag").isNull(), F.col("w")).otherwise(F.concat("w", F.lit("/"), "tag"))
    g = p.join(best, "w", "left").groupBy("prompt").agg(F.array_sort(F.collect_list(F.struct("i", word.alias("x")))).alias("x"))
    return g.select("prompt", F.array_join(F.transform("x", lambda x: x["x"]), " ").alias("tagged"))


def wanted_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often the 5-grams of the test text stand in training: only they are counted, as the training text is reduced to them before the aggregate."""
    wanted = ng.grams(corpus(spark, folder, "test"), 5).where("k = 5").select("hist", "w").distinct()
    c = ng.grams(_train(spark, folder), 5).where("k = 5").join(wanted, ["hist", "w"], "left_semi").groupBy("hist", "w").agg(F.count("*").alias("c"))
    return c.groupBy("c").agg(F.count("*").alias("grams"))


def prepared_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The whole preparation in a row: annotated lines, sentences, articles joined by shared long sentences, greedy split, vocabulary of words seen twice in training; sizes and unknown words per split."""
    rows = table(spark, folder, "raw_first").where("para_id IS NOT NULL").select("para_id", "value").distinct()
    s = annotated.segmented(annotated.parsed(rows), ["para_id"]).select(F.substring("para_id", 1, 15).alias("article_id"), "tokens")
    s = cut(s)
    links = s.where(F.size("tokens") >= 10).select(F.col("article_id").alias("node"), F.sha2(F.array_join("tokens", ng.SEP), 256).alias("key"))
    members, sizes = components.groups(s.select(F.col("article_id").alias("node")), links)
    placed = splitting.greedy_split(sizes, proportions=SHARES)
    of = cut(members.join(placed, "root").select(F.col("node").alias("article_id"), "split"))
    x = s.join(of, "article_id")
    known = ng.vocabulary(x.where("split = 'train'")).where("c >= 2").select("w", F.lit(True).alias("known"))
    words = x.select("split", F.explode("tokens").alias("w")).join(known, "w", "left").groupBy("split").agg(F.count("*").alias("tokens"), F.count_if(F.col("known").isNull()).alias("unknown"))
    return x.groupBy("split").agg(F.countDistinct("article_id").alias("articles"), F.count("*").alias("sentences")).join(words, "split")


QUERIES: dict[str, Query] = {f.__name__: f for f in (article_split_greedy, split_projection, format_profile_full, rendering_words, dialect_tokens, annotation_census, span_cover, grid_cells, smoother_disagreements, first_unseen, pruned_entries, pruned_effect, added_corpora, marginal_gain, oov_spelling, prefix_statistics, paired_bootstrap_ci, core_perplexity, nested_positions, tagged_prompts, wanted_counts, prepared_corpus)}
MODELS = {"kn_order_6": (6, "modified", None), "kn_original_5": (5, "original", None), "wb_5": (5, "witten_bell", None)}
for _name, (_order, _method, _prune) in MODELS.items():
    QUERIES[_name] = lambda spark, folder, a=(_order, _method, _prune): lm.summary(_scored(spark, folder, *a))

_H = "('0x' || md5('20260929:' || group_id)[1:12])::BIGINT"
_TOKENS = r"list_filter(string_split_regex(trim(coalesce(value, '')), '\s+'), lambda x: x <> '')"
_WORDS = _P.replace("SELECT DISTINCT para_id, value FROM raw_first WHERE para_id IS NOT NULL AND trim(coalesce(value, '')) <> ''", "SELECT para_id, max(value) AS value FROM {t} WHERE para_id IS NOT NULL AND trim(coalesce(value, '')) <> '' GROUP BY para_id")
_SIDE = lambda t: f"SELECT para_id, list(word ORDER BY pos) AS w, list(coalesce(tag, '') ORDER BY pos) AS t FROM (WITH {_WORDS.replace('{t}', t)} SELECT * FROM tok) GROUP BY para_id"
_ALL = f"""l0 AS (SELECT row_number() OVER () AS l, file, trim(coalesce(value, '')) AS v FROM raw_first), l1 AS (SELECT *, regexp_matches(v, '^\\d{{8}}-\\d{{2}}-\\d{{3}}-\\d{{3}}') AS ok FROM l0),
l2 AS (SELECT l, file, unnest(tk) AS x, generate_subscripts(tk, 1) AS i FROM (SELECT l, file, {_TOKENS.replace("coalesce(value, '')", "v")}[CASE WHEN ok THEN 2 ELSE 1 END:] AS tk FROM l1 WHERE v <> '')),
l3 AS (SELECT *, starts_with(x, '[') AS st, regexp_replace(CASE WHEN starts_with(x, '[') THEN x[2:] ELSE x END, '/%$', '') AS body FROM l2),
l4 AS (SELECT *, contains(body, '/') AS tagged, regexp_extract(body, '^(.*)/([^/]*)$', 1) AS w0, regexp_extract(body, '^(.*)/([^/]*)$', 2) AS t0 FROM l3),
l5 AS (SELECT *, CASE WHEN NOT tagged THEN body WHEN contains(w0, '/') THEN split_part(w0, '/', 1) ELSE w0 END AS word, CASE WHEN NOT tagged THEN NULL WHEN contains(w0, '/') THEN regexp_extract(w0, '^[^/]*/(.*)$', 1) ELSE regexp_replace(t0, '\\](\\w+)$', '') END AS tag,
 CASE WHEN tagged AND regexp_extract(t0, '\\](\\w+)$', 1) <> '' THEN regexp_extract(t0, '\\](\\w+)$', 1) END AS type FROM l4)"""
_NN = """SELECT sent_id, article_id, list(CASE WHEN k.w IS NULL THEN '<rare>' ELSE y.t END ORDER BY i) AS tokens FROM (SELECT sent_id, article_id, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS i FROM sen WHERE split = '{s}') y LEFT JOIN ({words}) k ON y.t = k.w GROUP BY ALL"""
_KINDS = {
    "top_300": f"SELECT w, n FROM ({_FREQ}) ORDER BY n DESC, w LIMIT 300",
    "cover_80": f"SELECT w, n FROM (SELECT w, n, sum(n) OVER (ORDER BY n DESC, w) - n AS before, sum(n) OVER () AS total FROM ({_FREQ})) WHERE before < 0.8::DOUBLE * total",
    "min_2": f"SELECT w, n FROM ({_FREQ}) WHERE n >= 2",
}
_CORE = " INTERSECT ".join(f"(SELECT w FROM ({w}))" for w in _KINDS.values())
_CHARS = "SELECT sent_id, article_id, string_split(array_to_string(tokens, ''), '') AS tokens FROM sen WHERE split = "
_GAP = "log10(p_kn / p_wb)"
SQL = {
    **{n: f"WITH {model_sql(o, m, p)} SELECT {SUMMARY_SQL} FROM sc" for n, (o, m, p) in MODELS.items()},
    "article_split_greedy": _COMP + f""", sz AS (SELECT group_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {_H}, group_id) AS i FROM gr GROUP BY group_id), nn AS (SELECT sum(n)::BIGINT AS total FROM sz),
wk(i, a, b, c, split) AS (SELECT 0::BIGINT, 8 * total, total, total, '' FROM nn UNION ALL SELECT i, a - CASE WHEN s = 'train' THEN 10 * n ELSE 0 END, b - CASE WHEN s = 'dev' THEN 10 * n ELSE 0 END, c - CASE WHEN s = 'test' THEN 10 * n ELSE 0 END, s FROM (SELECT sz.i, n, a, b, c, CASE WHEN a >= b AND a >= c THEN 'train' WHEN b >= c THEN 'dev' ELSE 'test' END AS s FROM wk JOIN sz ON sz.i = wk.i + 1))
SELECT gr.article_id, wk.split FROM gr JOIN sz USING (group_id) JOIN wk USING (i)""",
    "split_projection": "WITH sp AS (SELECT article_id, max(split) AS split FROM articles WHERE split IS NOT NULL GROUP BY article_id), p AS (SELECT DISTINCT para_id, para_id[1:15] AS article_id FROM raw_first WHERE para_id IS NOT NULL) SELECT v.split, count(p.para_id) AS paragraphs, count(DISTINCT p.article_id) AS articles FROM (VALUES ('train'), ('dev'), ('test')) v(split) LEFT JOIN sp ON sp.split = v.split LEFT JOIN p ON p.article_id = sp.article_id GROUP BY v.split",
    "format_profile_full": f"""WITH {_ALL}, tg AS (SELECT *, CASE WHEN type IS NOT NULL THEN 0 WHEN st THEN 1 END AS ev FROM l5 WHERE tag IS NOT NULL),
nb AS (SELECT *, last_value(ev IGNORE NULLS) OVER (PARTITION BY l ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM tg), fin AS (SELECT l, arg_max(ev, i) FILTER (ev IS NOT NULL) AS e, count(*) FILTER (tag = 'w' AND word IN ('。', '！', '？')) AS m FROM tg GROUP BY l)
SELECT (SELECT count(*) FROM l1 WHERE v <> '' AND NOT ok) AS no_id, (SELECT min(v[1:8]) FROM l1 WHERE ok) AS first_date, (SELECT max(v[1:8]) FROM l1 WHERE ok) AS last_date, (SELECT string_agg(p, ' ' ORDER BY p) FROM (SELECT DISTINCT v[10:11] AS p FROM l1 WHERE ok)) AS pages,
(SELECT count(*) FROM tg WHERE ends_with(x, '/%')) AS extra_marks, (SELECT count(*) FROM tg WHERE length(regexp_replace(regexp_replace(regexp_replace(x, '^\\[+', ''), '/%$', ''), '[^/]', '', 'g')) > 1) AS slash_in_word, (SELECT count(*) FROM nb WHERE st AND was = 1) AS nested,
(SELECT count(*) FROM fin WHERE e = 1) AS unclosed, (SELECT count(*) FROM fin WHERE m > 1) AS multi_end_lines, (SELECT count(DISTINCT regexp_extract(x, '([^/]*)$', 1)) FROM tg) AS raw_tags, (SELECT count(DISTINCT tag) FROM tg) AS plain_tags,
(SELECT string_agg(type || ':' || n, ' ' ORDER BY n DESC, type) FROM (SELECT type, count(*) AS n FROM tg WHERE type IS NOT NULL GROUP BY type)) AS entity_types, (SELECT string_agg(tag || ':' || n, ' ' ORDER BY n DESC, tag) FROM (SELECT tag, count(*) AS n FROM tg GROUP BY tag ORDER BY n DESC, tag LIMIT 25)) AS top_tags""",
    "rendering_words": f"SELECT count(*) AS shared, count(*) FILTER (a.w = b.w) AS same_words, count(*) FILTER (a.w = b.w AND a.t = b.t) AS same_both, count(*) FILTER (a.w <> b.w) AS other_words, count(*) FILTER (a.w = b.w AND a.t <> b.t) AS other_tags FROM ({_SIDE('raw_first')}) a JOIN ({_SIDE('raw_second')}) b USING (para_id)",
    "dialect_tokens": f"""WITH p AS (SELECT DISTINCT para_id, value FROM raw_second WHERE para_id IS NOT NULL AND trim(coalesce(value, '')) <> ''), t AS (SELECT regexp_replace(regexp_replace(x, '\\{{[^{{}}]*\\}}', '', 'g'), '!$', '') AS x FROM (SELECT unnest({_TOKENS}[2:]) AS x FROM p)),
b AS (SELECT regexp_replace(CASE WHEN starts_with(x, '[') THEN x[2:] ELSE x END, '/%$', '') AS body FROM t), c AS (SELECT regexp_extract(body, '^(.*)/([^/]*)$', 1) AS w0, regexp_extract(body, '^(.*)/([^/]*)$', 2) AS t0 FROM b WHERE contains(body, '/')),
d AS (SELECT CASE WHEN contains(w0, '/') THEN split_part(w0, '/', 1) ELSE w0 END AS word, CASE WHEN contains(w0, '/') THEN regexp_extract(w0, '^[^/]*/(.*)$', 1) ELSE regexp_replace(t0, '\\](\\w+)$', '') END AS tag FROM c)
SELECT CASE WHEN starts_with(tag, 'w') THEN 'w' ELSE tag END AS tag, count(*) AS n, count(DISTINCT word) AS words FROM d WHERE word <> '' GROUP BY 1""",
    "annotation_census": f"""WITH s AS (SELECT file, trim(coalesce(value, '')) = '' AS blank, {_TOKENS}[2:] AS tk FROM raw_first), x AS (SELECT file, unnest(tk) AS x FROM s WHERE NOT blank), y AS (SELECT *, regexp_replace(CASE WHEN starts_with(x, '[') THEN x[2:] ELSE x END, '/%$', '') AS body FROM x),
z AS (SELECT file, count(*) FILTER (ends_with(x, '/%')) AS extra, count(*) FILTER (starts_with(x, '[')) AS entities, count(*) FILTER (contains(regexp_extract(regexp_extract(body, '^(.*)/([^/]*)$', 1), '^[^/]*/(.*)$', 1), '/')) AS doubled, count(*) FILTER (NOT contains(body, '/')) AS untagged FROM y GROUP BY file)
SELECT s.file, count(*) AS lines, count(*) FILTER (blank) AS blank_lines, coalesce(any_value(extra), 0) AS extra, coalesce(any_value(entities), 0) AS entities, coalesce(any_value(doubled), 0) AS doubled, coalesce(any_value(untagged), 0) AS untagged FROM s LEFT JOIN z ON z.file IS NOT DISTINCT FROM s.file GROUP BY s.file""",
    "span_cover": f"""WITH {CORPUS_SQL}, t AS (SELECT sent_id, tokens, array_to_string(tokens, '') AS text FROM sen WHERE split = 'test' AND len(tokens) >= 6), u AS (SELECT *, substr(text, length(text) // 2 + 1, 6) AS wanted FROM t), v AS (SELECT *, instr(text, wanted) - 1 AS beg, list_transform(range(1, len(tokens) + 1), lambda i: length(array_to_string(tokens[1:i], ''))) AS ends FROM u)
SELECT sent_id, wanted, (len(list_filter(ends, lambda e: e <= beg)) + 1)::INT AS first, least(len(list_filter(ends, lambda e: e < beg + length(wanted))) + 1, len(tokens))::INT AS last FROM v""",
    "grid_cells": "SELECT model_order, temperature, top_k, count(*) AS texts, count(DISTINCT seed) AS seeds FROM (SELECT *, row_number() OVER (PARTITION BY gen_id ORDER BY finished_at DESC) AS r FROM generations WHERE top_p = 1.0) WHERE r = 1 GROUP BY ALL",
    "smoother_disagreements": f"WITH {event_sql('test')}, rt AS (SELECT sent_id, pos::INT AS pos, round({_GAP}, 8) AS ratio FROM z WHERE context = 3 AND d3 >= 10) SELECT * FROM (SELECT *, 'kn' AS \"end\" FROM rt ORDER BY ratio DESC, sent_id, pos LIMIT 10) UNION ALL SELECT * FROM (SELECT *, 'wb' FROM rt ORDER BY ratio, sent_id, pos LIMIT 10)",
    "first_unseen": f"WITH {event_sql('test')} SELECT sent_id, pos::INT AS pos, w, c2::BIGINT AS bigram FROM z WHERE context = 3 AND c2 > 0 AND c3 = 0 AND d3 > 0 ORDER BY sent_id, pos LIMIT 20",
    "pruned_entries": f"WITH {model_sql(3, prune=[0, 0, 1])} SELECT k::INT AS k, count(*) AS entries, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS removed FROM s1 GROUP BY k",
    "pruned_effect": f"""WITH pa AS (WITH {model_sql(3)} SELECT sc.sent_id, sc.pos, sc.oov, log10(sc.p) AS p, sc.match, e.sent_id IS NOT NULL AS long, coalesce(e.c, 0) AS c FROM sc LEFT JOIN (SELECT ev.sent_id, ev.pos, c.c FROM ev LEFT JOIN c ON c.k = 3 AND c.hist = ev.hist AND c.w = ev.w WHERE ev.k = 3) e ON e.sent_id = sc.sent_id AND e.pos = sc.pos),
pb AS (WITH {model_sql(3, prune=[0, 0, 1])} SELECT sent_id, pos, log10(p) AS p, match FROM sc), j AS (SELECT pa.*, pb.p AS q, pb.match AS m2 FROM pa JOIN pb USING (sent_id, pos))
SELECT CASE WHEN oov THEN 'oov' WHEN NOT long THEN 'short' WHEN c = 0 THEN '0' WHEN c = 1 THEN '1' WHEN c <= 4 THEN '2-4' ELSE '5+' END AS bucket, count(*) AS events, round(avg(match), 6) AS order_full, round(avg(m2), 6) AS order_pruned, round(sum(p - q) / (SELECT sum(p - q) FROM j), 6) + 0.0 AS loss_share FROM j GROUP BY 1""",
    "added_corpora": " UNION ALL ".join(f"SELECT * FROM (WITH {model_sql(3, train=f'SELECT sent_id, tokens FROM sen WHERE split = {chr(39)}train{chr(39)} {w}')} SELECT '{n}' AS corpus, count(*) AS events, count(*) FILTER (oov) AS oov_events, round(pow(10.0, -sum(log10(p)) / count(*)), 4) AS ppl FROM sc)" for n, w in (("first", "AND article_id[1:6] = (SELECT min(article_id[1:6]) FROM sen WHERE split = 'train')"), ("all", ""))),
    "marginal_gain": f"WITH cu AS ({_curve_sql()}), d AS (SELECT target, words - lag(words) OVER (ORDER BY words) AS dw, lag(ppl) OVER (ORDER BY words) - ppl AS dp FROM cu) SELECT target, round(dp / dw * 1000, 6) AS gain FROM d WHERE dw IS NOT NULL",
    "oov_spelling": f"""WITH wo AS (WITH {model_sql(3)} SELECT sent_id, pos, -log2(p) AS b FROM sc WHERE oov), ch AS (WITH {model_sql(5, train=_CHARS + "'train'", test=_CHARS + "'test'")} SELECT sent_id, pos AS cp, -log2(p) AS b FROM sc),
{CORPUS_SQL}, wp AS (SELECT sent_id, i - 1 AS pos, unnest(range(e - length(t), e)) AS cp FROM (SELECT sent_id, t, i, length(array_to_string(tokens[1:i], '')) AS e FROM (SELECT sent_id, tokens, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS i FROM sen WHERE split = 'test'))),
sp2 AS (SELECT wp.sent_id, wp.pos, sum(ch.b) AS b FROM wp JOIN ch USING (sent_id, cp) GROUP BY wp.sent_id, wp.pos)
SELECT count(*) AS words, round(avg(wo.b), 6) AS word_bits, round(avg(sp2.b), 6) AS char_bits FROM wo LEFT JOIN sp2 USING (sent_id, pos)""",
    "prefix_statistics": "WITH g AS (SELECT array_to_string(prompt, ' ') AS prompt, len(tokens) AS n, hit_eos::INT AS e, tokens[1] AS f FROM (SELECT *, row_number() OVER (PARTITION BY gen_id ORDER BY finished_at DESC) AS r FROM generations) WHERE r = 1) SELECT prompt, count(*) AS texts, round(avg(n), 6) AS mean_length, round(stddev_pop(n), 6) AS sd_length, round(avg(e), 6) AS ended, count(DISTINCT f) AS first_words FROM g GROUP BY prompt",
    "paired_bootstrap_ci": f"""WITH pd AS ({TEXT_SQL['pair_discrimination']}), re AS (SELECT rep, sum(t * (kn - sb)) / nullif(sum(t), 0) AS x FROM (SELECT *, {_poisson_sql('sent_id')} AS t FROM pd, (SELECT unnest(range(1, 1001)) AS rep)) GROUP BY rep)
SELECT (SELECT count(*) FROM pd) AS pairs, (SELECT round(avg(kn - sb), 6) FROM pd) AS difference, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM re""",
    "core_perplexity": " UNION ALL ".join(f"SELECT * FROM (WITH {model_sql(3, train=_NN.format(s='train', words=w), test=_NN.format(s='test', words=w))}, co AS ({_CORE}), kd AS ({w}) SELECT '{n}' AS vocabulary, (SELECT count(*) FROM kd) AS size, (SELECT round(sum(n) / (SELECT sum(n) FROM ({_FREQ})), 6) FROM kd) AS covered, round(pow(10.0, -avg(log10(p))), 4) AS ppl, count(*) FILTER (w IN (SELECT w FROM co)) AS core_events, round(pow(10.0, -avg(log10(p)) FILTER (w IN (SELECT w FROM co))), 4) AS core_ppl FROM sc)" for n, w in _KINDS.items()),
    "tagged_prompts": f"""WITH {CORPUS_SQL}, t AS (SELECT unnest(tokens) AS w, unnest(tags) AS tag FROM sen WHERE split = 'train' AND tags IS NOT NULL), c AS (SELECT w, tag, count(*) AS n FROM t GROUP BY w, tag), b AS (SELECT w, tag FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY n DESC, tag DESC) AS r FROM c) WHERE r = 1),
p AS (SELECT array_to_string(prompt, ' ') AS prompt, unnest(prompt) AS w, generate_subscripts(prompt, 1) AS i FROM (SELECT DISTINCT prompt FROM generations)) SELECT prompt, string_agg(CASE WHEN tag IS NULL THEN p.w ELSE p.w || '/' || tag END, ' ' ORDER BY i) AS tagged FROM p LEFT JOIN b ON p.w = b.w GROUP BY prompt""",
    "wanted_counts": f"WITH {model_sql(5)} SELECT n AS c, count(*) AS grams FROM (SELECT c.c AS n FROM c WHERE k = 5 AND EXISTS (SELECT 1 FROM ev WHERE ev.k = 5 AND ev.hist = c.hist AND ev.w = c.w)) GROUP BY n",
    "prepared_corpus": f"""WITH RECURSIVE {_P}, sx AS (SELECT para_id[1:15] AS article_id, list(word ORDER BY pos) AS tokens FROM sg GROUP BY para_id, sent_no), kx AS (SELECT DISTINCT article_id, array_to_string(tokens, chr(31)) AS t FROM sx WHERE len(tokens) >= 10), ex AS (SELECT DISTINCT a.article_id AS a, b.article_id AS b FROM kx a JOIN kx b USING (t)),
rx(a, b) AS (SELECT DISTINCT article_id, article_id FROM sx UNION SELECT rx.a, ex.b FROM rx JOIN ex ON rx.b = ex.a), gr AS (SELECT a AS article_id, min(b) AS group_id FROM rx GROUP BY a), sz AS (SELECT group_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {_H}, group_id) AS i FROM gr GROUP BY group_id), nn AS (SELECT sum(n)::BIGINT AS total FROM sz),
wk(i, a, b, c, split) AS (SELECT 0::BIGINT, 8 * total, total, total, '' FROM nn UNION ALL SELECT i, a - CASE WHEN s = 'train' THEN 10 * n ELSE 0 END, b - CASE WHEN s = 'dev' THEN 10 * n ELSE 0 END, c - CASE WHEN s = 'test' THEN 10 * n ELSE 0 END, s FROM (SELECT sz.i, n, a, b, c, CASE WHEN a >= b AND a >= c THEN 'train' WHEN b >= c THEN 'dev' ELSE 'test' END AS s FROM wk JOIN sz ON sz.i = wk.i + 1)),
x AS (SELECT sx.*, wk.split FROM sx JOIN gr USING (article_id) JOIN sz USING (group_id) JOIN wk USING (i)), ww AS (SELECT split, unnest(tokens) AS w FROM x), vo AS (SELECT w FROM ww WHERE split = 'train' GROUP BY w HAVING count(*) >= 2)
SELECT a.*, tokens, unknown FROM (SELECT split, count(DISTINCT article_id) AS articles, count(*) AS sentences FROM x GROUP BY split) a JOIN (SELECT split, count(*) AS tokens, count(*) FILTER (w NOT IN (SELECT w FROM vo)) AS unknown FROM ww GROUP BY split) USING (split)""",
    "nested_positions": f"WITH {CORPUS_SQL}, ps AS (SELECT sent_id, unnest(range(0, len(tokens) + 1))::INT AS pos FROM sen WHERE split = 'test') SELECT sent_id, pos, r <= 100 AS ranked FROM (SELECT *, row_number() OVER (ORDER BY ('0x' || md5('20260930:' || sent_id || ':' || pos)[1:12])::BIGINT, sent_id, pos) AS r FROM ps) WHERE r <= 300",
}
