"""Stupid Backoff, the document cache, overlap with training, generation and decoding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.catalog import Query
from glyphloom.catalog.lm import corpus, counts_sql, event_rows, model_sql
from glyphloom.functions.keys import seeded
from glyphloom.operators import backoff, decoding, document_cache, evaluation, lm, overlap, sampling, smoothing, tuning
from glyphloom.operators import ngrams as ng
from glyphloom.plans.materialise import cut
from glyphloom.sources.tables import table

ALPHAS = (0.2, 0.4, 0.6, 0.8)


def _profiles(spark: SparkSession, folder: str, split: str) -> DataFrame:
    return backoff.profiles(backoff.train(corpus(spark, folder, "train"), 3), corpus(spark, folder, split), ["sent_id"])


def sb_scores(spark: SparkSession, folder: str) -> DataFrame:
    p = _profiles(spark, folder, "test")
    return p.select("sent_id", "pos", "level", F.round(backoff.score(0.4), 10).alias("score"), F.round(backoff.normalised(0.4), 10).alias("p"))


def sb_alpha_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Dev perplexity of normalised Stupid Backoff under each factor, unknown words left out."""
    p = cut(_profiles(spark, folder, "dev").where("value > 0"))
    grid = F.explode(F.array(*[F.lit(a) for a in ALPHAS])).alias("alpha")
    return p.select("*", grid).groupBy("alpha").agg(F.count("*").alias("events"), F.round(F.pow(F.lit(10.0), -F.avg(F.log10(backoff.normalised(F.col("alpha"))))), 4).alias("ppl"))


def sb_alpha_tuned(spark: SparkSession, folder: str) -> DataFrame:
    """The best common factor of a grid that grows upwards, then two rounds of coordinate descent over a factor per order; dev perplexities."""
    p = cut(_profiles(spark, folder, "dev").where("value > 0"))
    one, found = tuning.growing_grid(p, [0.1, 0.2, 0.4, 0.8], backoff.normalised, factor=1.5, bound=10.0)
    per, ppl = tuning.coordinate_descent(p, [one, one], [0.5, 0.75, 1.25, 1.5, 2.0], backoff.normalised_by_order)
    return spark.createDataFrame([("common", [one, one], found[one]), ("by_order", per, ppl)], "kind string, alphas array<double>, ppl double").withColumn("ppl", F.round("ppl", 4))


def addk_tuned(spark: SparkSession, folder: str) -> DataFrame:
    """Add-k with k from a grid that goes on downwards while its least value is best: dev and test perplexity."""
    dev, test = cut(event_rows(spark, folder, "dev")), event_rows(spark, folder, "test")
    k, found = tuning.growing_grid(dev, [1.0, 0.1, 0.01], smoothing.p_addk, factor=0.5, bound=1e-6)
    own = tuning.perplexities(test, [k], smoothing.p_addk)[0]
    return spark.createDataFrame([(k, found[k], own)], "k_add double, dev_ppl double, test_ppl double")


def sb_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Unnormalised log10 score of whole test sentences; minus infinity with an unknown word."""
    p = _profiles(spark, folder, "test").withColumn("s", backoff.score(0.4))
    bad = F.max((F.col("s") <= 0).cast("int")) > 0
    return p.groupBy("sent_id").agg(F.when(bad, F.lit(float("-inf"))).otherwise(F.round(F.sum(F.when(F.col("s") > 0, F.log10("s"))), 6)).alias("log10_score"))


def _sb_sql(split: str, test: str = "") -> str:
    test = test or f"SELECT sent_id, tokens FROM sen WHERE split = '{split}'"
    return f"""WITH {counts_sql(3)},
tt AS (SELECT k, hist, sum(c)::DOUBLE AS total FROM c GROUP BY k, hist), se AS (SELECT c.k, c.hist, w, c / total AS s FROM c JOIN tt ON c.k = tt.k AND c.hist = tt.hist),
cv AS (SELECT u.k, u.hist, sum(l.s) AS covered FROM se u JOIN se l ON u.k > 1 AND l.k = u.k - 1 AND l.w = u.w AND l.hist = CASE WHEN contains(u.hist, chr(31)) THEN substr(u.hist, instr(u.hist, chr(31)) + 1) ELSE '' END GROUP BY u.k, u.hist UNION ALL SELECT 1, '', NULL),
wd AS (SELECT DISTINCT unnest(tokens) AS w FROM tr UNION SELECT '</s>'),
tm AS (SELECT x.sent_id, list(coalesce(wd.w, '<unk>') ORDER BY i) AS tokens FROM (SELECT sent_id, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS i FROM ({test})) x LEFT JOIN wd ON x.t = wd.w GROUP BY ALL),
ep AS (SELECT sent_id, list_concat(['<s>'], tokens, ['</s>']) AS q, unnest(range(0, len(tokens) + 1)) AS pos FROM tm),
ev AS (SELECT sent_id, pos, k, array_to_string(q[pos + 3 - k : pos + 1], chr(31)) AS hist, q[pos + 2] AS w FROM ep, range(1, 4) t(k) WHERE k <= pos + 2),
ej AS (SELECT ev.sent_id, ev.pos, ev.w, ev.k, se.s, cv.hist IS NOT NULL AS seen, coalesce(cv.covered, 0) AS covered FROM ev LEFT JOIN se ON ev.k = se.k AND ev.hist = se.hist AND ev.w = se.w LEFT JOIN cv ON ev.k = cv.k AND ev.hist = cv.hist),
ek AS (SELECT *, CASE WHEN seen THEN 1 - CASE WHEN lead(seen) OVER (PARTITION BY sent_id, pos ORDER BY k) THEN lead(covered) OVER (PARTITION BY sent_id, pos ORDER BY k) ELSE 0 END ELSE 0 END AS mass, max(k) OVER (PARTITION BY sent_id, pos) AS n, coalesce(max(CASE WHEN s IS NOT NULL THEN k END) OVER (PARTITION BY sent_id, pos), 1) AS level FROM ej),
pr AS (SELECT sent_id, pos, w, any_value(n) AS n, any_value(level) AS level, coalesce(max(CASE WHEN k = level THEN s END), 0) AS value, list(mass ORDER BY k) AS mass FROM ek GROUP BY sent_id, pos, w)"""


_SC = "value * pow({a}, n - level)"
_NP = "(value * pow({a}, n - level)) / list_sum(list_transform(mass, lambda m, i: m * pow({a}, n - i)))"
SQL: dict[str, str] = {
    "sb_scores": _sb_sql("test") + f" SELECT sent_id, pos::INT AS pos, level::INT AS level, round({_SC.format(a='0.4::DOUBLE')}, 10) AS score, round({_NP.format(a='0.4::DOUBLE')}, 10) AS p FROM pr",
    "sb_alpha_grid": _sb_sql("dev") + f" SELECT alpha, count(*) AS events, round(pow(10.0, -avg(log10({_NP.format(a='alpha')}))), 4) AS ppl FROM pr, (SELECT unnest([0.2, 0.4, 0.6, 0.8]::DOUBLE[]) AS alpha) WHERE value > 0 GROUP BY alpha",
    "sb_sentences": _sb_sql("test") + f", s2 AS (SELECT sent_id, {_SC.format(a='0.4::DOUBLE')} AS s FROM pr) SELECT sent_id, CASE WHEN min(s) <= 0 THEN '-Infinity'::DOUBLE ELSE round(sum(log10(CASE WHEN s > 0 THEN s END)), 6) END AS log10_score FROM s2 GROUP BY sent_id",
}


def pair_discrimination(spark: SparkSession, folder: str) -> DataFrame:
    """Each known test sentence of 8 to 40 words beside a copy with two neighbouring words swapped: which one each model prefers."""
    train, test = cut(corpus(spark, folder, "train")), corpus(spark, folder, "test").where(F.size("tokens").between(8, 40))
    places = F.filter(F.sequence(F.lit(1), F.size("tokens") - 1), lambda i: F.element_at("tokens", i) != F.element_at("tokens", i + 1))
    t = test.withColumn("_pl", places).where(F.size("_pl") > 0)
    t = t.withColumn("_i", F.element_at("_pl", (seeded(20260930, F.col("sent_id")) % F.size("_pl") + 1).cast("int")))
    swapped = F.concat(F.slice("tokens", F.lit(1), F.col("_i") - 1), F.array(F.element_at("tokens", F.col("_i") + 1), F.element_at("tokens", F.col("_i"))), F.slice("tokens", F.col("_i") + 2, F.size("tokens")))
    pairs = cut(t.select("sent_id", "tokens", swapped.alias("swapped")))
    kn, sb = lm.train(train, 3), backoff.train(train, 3)

    def total(column: str, name: str) -> DataFrame:
        own = pairs.select("sent_id", F.col(column).alias("tokens"))
        a = lm.scores(kn, own, ["sent_id"]).groupBy("sent_id").agg(F.sum(F.log10("p")).alias(f"kn_{name}"), F.max("oov").alias(f"oov_{name}"))
        p = backoff.profiles(sb, own, ["sent_id"]).groupBy("sent_id").agg(F.sum(F.log10(F.greatest(backoff.score(0.4), F.lit(1e-300)))).alias(f"sb_{name}"))
        return a.join(p, "sent_id")

    both = total("tokens", "true").join(total("swapped", "swap"), "sent_id").where("NOT oov_true")
    judged = lambda m: F.when(F.abs(F.col(f"{m}_true") - F.col(f"{m}_swap")) < 1e-9, 0.5).when(F.col(f"{m}_true") > F.col(f"{m}_swap"), 1.0).otherwise(0.0)
    return both.select("sent_id", judged("kn").alias("kn"), judged("sb").alias("sb"))


def rank_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Expected hits and reciprocal rank of the true word among all words, over the whole test split."""
    r = evaluation.ranks(lm.train(corpus(spark, folder, "train"), 3), cut(corpus(spark, folder, "test")), "sent_id")
    m = evaluation.rank_metrics(F.col("greater"), F.col("equal"), ~F.col("oov"))
    x = r.select(*[c.alias(n) for n, c in m.items()])
    return x.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("hit_1", "hit_5", "hit_10")], F.round(F.avg("rr"), 6).alias("mrr"), F.median("rank").alias("median_rank"))


def _cached(spark: SparkSession, folder: str, split: str, decay: float | None) -> DataFrame:
    s = lm.scores(lm.train(corpus(spark, folder, "train"), 3), corpus(spark, folder, split), ["sent_id", "article_id", "sent_no"])
    return document_cache.cached(s, "article_id", ["sent_no", "sent_id", "pos"], decay)


def cache_plain(spark: SparkSession, folder: str) -> DataFrame:
    c = _cached(spark, folder, "test", None)
    return c.select("sent_id", "pos", F.round("pc", 10).alias("pc"), "has", "seen", F.round(document_cache.mixed(F.col("p"), 0.15), 10).alias("mixed"))


def cache_decay(spark: SparkSession, folder: str) -> DataFrame:
    return _cached(spark, folder, "test", 0.98).select("sent_id", "pos", F.round("pc", 8).alias("pc"), "has", "seen")


def cache_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Dev perplexity of the mixture over cache weights and decays."""
    out = []
    for decay in (None, 0.98):
        c = cut(_cached(spark, folder, "dev", decay))
        grid = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.05, 0.1, 0.15, 0.2, 0.3)])).alias("lam")
        g = c.select("*", grid).groupBy("lam").agg(F.round(F.pow(F.lit(10.0), -F.avg(F.log10(document_cache.mixed(F.col("p"), F.col("lam"))))), 4).alias("ppl"))
        out.append(g.select(F.lit(decay).cast("double").alias("decay"), "lam", "ppl"))
    return reduce(DataFrame.unionByName, out)


def cache_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Where the cache helps: events by whether it holds anything and the word, and unknown ones."""
    c = _cached(spark, folder, "test", None)
    part = F.when(F.col("oov"), "oov").when(~F.col("has"), "empty").when(F.col("seen"), "seen").otherwise("unseen")
    ppl = lambda p: F.round(F.pow(F.lit(10.0), -F.avg(F.log10(p))), 4)
    return c.groupBy(part.alias("part")).agg(F.count("*").alias("events"), ppl(F.col("p")).alias("ppl"), ppl(document_cache.mixed(F.col("p"), 0.15)).alias("ppl_mixed"))


def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    """Change of perplexity by the cache, with a bootstrap interval over articles."""
    c = _cached(spark, folder, "test", None).groupBy("article_id").agg((-F.sum(F.log10("p"))).alias("a"), (-F.sum(F.log10(document_cache.mixed(F.col("p"), 0.15)))).alias("b"), F.count("*").alias("n"))
    b = evaluation.bootstrap(cut(c), "article_id", "a", "b", "n")
    return b.select("groups", *[F.round(x, 6).alias(x) for x in ("change", "low", "high")])


def _cache_sql(split: str, decay: float | None) -> str:
    base = f"""WITH {model_sql(3, test=f"SELECT sent_id, article_id, tokens FROM sen WHERE split = '{split}'")}, no AS (SELECT sent_id, sent_no FROM sen),
ce AS (SELECT sc.*, row_number() OVER (PARTITION BY sc.article_id ORDER BY sent_no, sc.sent_id, pos) AS i FROM sc JOIN no USING (sent_id)),"""
    if decay is None:
        sums = """cs AS (SELECT *, coalesce(sum(CASE WHEN oov THEN 0 ELSE 1 END) OVER (PARTITION BY article_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS tot, CASE WHEN oov THEN 0 ELSE coalesce(sum(CASE WHEN oov THEN 0 ELSE 1 END) OVER (PARTITION BY article_id, w ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END::DOUBLE AS own FROM ce)"""
    else:
        sums = f"cs AS (SELECT a.sent_id, a.article_id, a.pos, a.w, a.oov, a.p, coalesce(sum(CASE WHEN NOT b.oov THEN pow({decay}::DOUBLE, a.i - b.i) END), 0) AS tot, CASE WHEN a.oov THEN 0 ELSE coalesce(sum(CASE WHEN NOT b.oov AND b.w = a.w THEN pow({decay}::DOUBLE, a.i - b.i) END), 0) END AS own FROM ce a LEFT JOIN ce b ON a.article_id = b.article_id AND b.i < a.i GROUP BY a.sent_id, a.article_id, a.pos, a.w, a.oov, a.p)"
    return base + sums + ", cc AS (SELECT *, CASE WHEN tot > 0 THEN own / tot ELSE 0 END AS pc, tot > 0 AS has, own > 0 AS seen FROM cs)"


_MIX = "CASE WHEN has THEN (1 - {x}) * p + {x} * pc ELSE p END"
SQL |= {
    "cache_plain": _cache_sql("test", None) + f" SELECT sent_id, pos::INT AS pos, round(pc, 10) AS pc, has, seen, round({_MIX.format(x='0.15::DOUBLE')}, 10) AS mixed FROM cc",
    "cache_decay": _cache_sql("test", 0.98) + " SELECT sent_id, pos::INT AS pos, round(pc, 8) AS pc, has, seen FROM cc",
    "cache_parts": _cache_sql("test", None) + f" SELECT CASE WHEN oov THEN 'oov' WHEN NOT has THEN 'empty' WHEN seen THEN 'seen' ELSE 'unseen' END AS part, count(*) AS events, round(pow(10.0, -avg(log10(p))), 4) AS ppl, round(pow(10.0, -avg(log10({_MIX.format(x='0.15::DOUBLE')}))), 4) AS ppl_mixed FROM cc GROUP BY 1",
    "cache_grid": " UNION ALL ".join(f"SELECT * FROM ({_cache_sql('dev', d)} SELECT {'NULL' if d is None else d}::DOUBLE AS decay, lam, round(pow(10.0, -avg(log10({_MIX.format(x='lam')}))), 4) AS ppl FROM cc, (SELECT unnest([0.0, 0.05, 0.1, 0.15, 0.2, 0.3]::DOUBLE[]) AS lam) GROUP BY lam)" for d in (None, 0.98)),
}


def learning_curve(spark: SparkSession, folder: str) -> DataFrame:
    """Nested training samples of growing size: words, types and test perplexity of a trigram model."""
    train, test = cut(corpus(spark, folder, "train")), cut(corpus(spark, folder, "test"))
    out = []
    for target in (2000, 4000, 8000, 16000):
        own = cut(train.join(sampling.nested_articles(train, target, 20260929).select("article_id"), "article_id", "left_semi"))
        size = own.select(F.explode("tokens").alias("w")).agg(F.count("*").alias("words"), F.countDistinct("w").alias("types"))
        out.append(lm.summary(lm.scores(lm.train(own, 3), test, ["sent_id"])).select(F.lit(target).alias("target"), "ppl").join(size))
    return reduce(DataFrame.unionByName, out)


def learning_curve_whole(spark: SparkSession, folder: str) -> DataFrame:
    """The learning curve over a 16th, an eighth, a quarter and half of the training words and the whole training set."""
    train, test = cut(corpus(spark, folder, "train")), cut(corpus(spark, folder, "test"))
    total = train.agg(F.sum(F.size("tokens"))).first()[0] or 0
    out = []
    for part in (16, 8, 4, 2, 1):
        target = -(-total // part)
        own = train if part == 1 else cut(train.join(sampling.nested_articles(train, target, 20260929).select("article_id"), "article_id", "left_semi"))
        size = own.select(F.explode("tokens").alias("w")).agg(F.count("*").alias("words"), F.countDistinct("w").alias("types"))
        out.append(lm.summary(lm.scores(lm.train(own, 3), test, ["sent_id"])).select(F.lit(target).cast("bigint").alias("target"), "ppl").join(size))
    return reduce(DataFrame.unionByName, out)


def growth_laws(spark: SparkSession, folder: str) -> DataFrame:
    """Heaps' law of types over words, and the power law of perplexity, extrapolated to twice the words."""
    return _growth(cut(learning_curve(spark, folder)))


def growth_laws_whole(spark: SparkSession, folder: str) -> DataFrame:
    """The growth laws of learning_curve_whole, extrapolated to twice the training set."""
    return _growth(cut(learning_curve_whole(spark, folder)))


def _growth(c: DataFrame) -> DataFrame:
    heaps, ppl = evaluation.power_law(c, "words", "types"), evaluation.power_law(c, "words", "ppl").withColumnsRenamed({"factor": "f2", "exponent": "e2"})
    n = c.agg((2 * F.max("words")).alias("words"))
    r = lambda x: F.round(x, 4)
    return heaps.join(ppl).join(n).select("words", r("factor").alias("heaps_factor"), r("exponent").alias("heaps_exponent"), r(F.col("f2") * F.pow("words", F.col("e2"))).alias("ppl_expected"))


def _curve_sql(targets: tuple[str, ...] = ("2000", "4000", "8000", "16000")) -> str:
    parts = []
    for t in targets:
        own = f"SELECT s.sent_id, s.tokens FROM sen s WHERE split = 'train' AND article_id IN (SELECT article_id FROM (SELECT article_id, coalesce(sum(words) OVER (ORDER BY h, article_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT article_id, sum(len(tokens)) AS words, ('0x' || md5('20260929:' || article_id)[1:12])::BIGINT AS h FROM sen WHERE split = 'train' GROUP BY article_id)) WHERE before < {t})"
        parts.append(f"SELECT * FROM (WITH {model_sql(3, train=own)} SELECT {t} AS target, (SELECT round(pow(10.0, -sum(log10(p)) / count(*)), 4) FROM sc) AS ppl, count(*) AS words, count(DISTINCT w) AS types FROM (SELECT unnest(tokens) AS w FROM tr))")
    return " UNION ALL ".join(parts)


_WHOLE = _curve_sql(tuple(f"(SELECT ceil(sum(len(tokens)) / {part})::BIGINT FROM sen WHERE split = 'train')" for part in (16, 8, 4, 2, 1)))
_LAWS = "SELECT 2 * max(words) AS words, round(exp(regr_intercept(ln(types), ln(words))), 4) AS heaps_factor, round(regr_slope(ln(types), ln(words)), 4) AS heaps_exponent, round(exp(regr_intercept(ln(ppl), ln(words))) * pow(2 * max(words), regr_slope(ln(ppl), ln(words))), 4) AS ppl_expected FROM cu"
SQL["learning_curve_whole"] = _WHOLE
SQL["growth_laws_whole"] = f"WITH cu AS ({_WHOLE}) {_LAWS}"
SQL["learning_curve"] = _curve_sql()
SQL["growth_laws"] = f"WITH cu AS ({_curve_sql()}) {_LAWS}"


def _generations(spark: SparkSession, folder: str) -> DataFrame:
    """The latest delivery of each generation, with the prompt's last four words before its own."""
    g = table(spark, folder, "generations")
    g = g.groupBy("gen_id").agg(F.max_by(F.struct("prompt", "tokens", "temperature", "model_order", "hit_eos", "seed", "top_k"), "finished_at").alias("r")).select("gen_id", "r.*")
    last = F.slice("prompt", F.greatest(F.size("prompt") - 3, F.lit(1)), F.lit(4))
    return g.select("gen_id", "temperature", "model_order", "hit_eos", "seed", "top_k", F.col("tokens").alias("own"), F.concat(last, "tokens").alias("tokens"), F.size(last).alias("start"))


def _found(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    g = cut(_generations(spark, folder))
    return g, cut(overlap.found_spans(g, ["gen_id"], table(spark, folder, "sentences"), longest=12))


def overlap_5gram(spark: SparkSession, folder: str) -> DataFrame:
    g, f = _found(spark, folder)
    return overlap.overlap_rate(g, "gen_id", f, 5).withColumn("rate", F.round("rate", 8))


def longest_copied_span(spark: SparkSession, folder: str) -> DataFrame:
    g, f = _found(spark, folder)
    return overlap.longest_copied(g, "gen_id", f, "start")


def copy_histogram(spark: SparkSession, folder: str) -> DataFrame:
    s = longest_copied_span(spark, folder)
    b = F.when(F.col("span") <= 3, "0-3").when(F.col("span") <= 6, "4-6").when(F.col("span") <= 9, "7-9").otherwise("10+")
    return s.groupBy(b.alias("bucket")).agg(F.count("*").alias("texts"))


def longest_copies(spark: SparkSession, folder: str) -> DataFrame:
    return longest_copied_span(spark, folder).orderBy(F.desc("span"), "gen_id").limit(6)


def copies_by_setting(spark: SparkSession, folder: str) -> DataFrame:
    """Mean copied span, 5-gram overlap and rate of long copies per model order and temperature."""
    g, f = _found(spark, folder)
    x = g.join(overlap.longest_copied(g, "gen_id", f, "start"), "gen_id").join(overlap.overlap_rate(g, "gen_id", f, 5), "gen_id")
    return x.groupBy("model_order", "temperature").agg(F.count("*").alias("texts"), F.round(F.avg("span"), 6).alias("mean_span"), F.round(F.avg("rate"), 6).alias("mean_overlap"), F.round(F.avg((F.col("span") >= 10).cast("double")), 6).alias("long_copies"), F.round(F.avg(F.col("hit_eos").cast("double")), 6).alias("ended"))


def source_sentence(spark: SparkSession, folder: str) -> DataFrame:
    """For each generation with a copied run of at least four words, the first sentence that has its longest one, and the reach of the copy."""
    g, f = _found(spark, folder)
    return overlap.source_sentences(g, "gen_id", f, table(spark, folder, "sentences"))


def repetition_stats(spark: SparkSession, folder: str) -> DataFrame:
    g = _generations(spark, folder)
    return g.select("gen_id", *[c.cast("bigint").alias(n) if n == "length" else F.round(c, 8).alias(n) for n, c in overlap.repetition(F.col("own")).items()])


def repetition_census(spark: SparkSession, folder: str) -> DataFrame:
    """How many generations repeat three-word runs, per model order; reported rates that are missing or stale are counted."""
    g = _generations(spark, folder).select("gen_id", "model_order", F.round(overlap.repetition(F.col("own"))["repeated_3gram_rate"], 3).alias("rate"))
    said = table(spark, folder, "generations").groupBy("gen_id").agg(F.max_by("repeated_3gram_rate", "finished_at").alias("said"))
    x = g.join(said, "gen_id")
    missing = F.col("said").isNull() | F.isnan("said")
    return x.groupBy("model_order").agg(F.count("*").alias("texts"), F.count_if(F.col("rate") > 0).alias("repeating"), F.count_if(missing).alias("missing"), F.count_if(~missing & (F.abs(F.col("said") - F.col("rate")) > 0.0015)).alias("stale"))


def pairwise_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Mean likeness of the word sets of generations from one prompt."""
    g = table(spark, folder, "generations").groupBy("gen_id").agg(F.max_by(F.struct("prompt", "tokens"), "finished_at").alias("r"))
    g = g.select("gen_id", F.array_join("r.prompt", " ").alias("prompt"), F.col("r.tokens").alias("tokens"))
    return overlap.mean_jaccard(g, "gen_id", "prompt").withColumn("mean_jaccard", F.round("mean_jaccard", 8))


_G = """gl AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY gen_id ORDER BY finished_at DESC) AS r FROM generations) WHERE r = 1),
gt AS (SELECT gen_id, model_order, temperature, hit_eos, tokens AS own, list_concat(prompt[greatest(len(prompt) - 3, 1):], tokens) AS tokens, least(len(prompt), 4) AS start FROM gl),
gs AS (SELECT gen_id, start, i, n, array_to_string(tokens[i : i + n - 1], chr(31)) AS t FROM (SELECT gen_id, start, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM gt), range(1, 13) x(n) WHERE i + n - 1 <= len(tokens)),
ts AS (SELECT DISTINCT array_to_string(tokens[i : i + n - 1], chr(31)) AS t, n FROM (SELECT tokens, unnest(range(1, len(tokens) + 1)) AS i FROM sentences), range(1, 13) x(n) WHERE i + n - 1 <= len(tokens)),
gf AS (SELECT gs.* FROM gs WHERE EXISTS (SELECT 1 FROM ts WHERE ts.t = gs.t AND ts.n = gs.n)),
gp AS (SELECT gt.gen_id, coalesce(max(gf.n) FILTER (gf.i + gf.n - 1 > gt.start), 0)::INT AS span, CASE WHEN len(any_value(gt.tokens)) >= 5 THEN count(*) FILTER (gf.n = 5) / (len(any_value(gt.tokens)) - 4) END AS rate FROM gt LEFT JOIN gf USING (gen_id) GROUP BY gt.gen_id)"""
_REP = lambda k: f"CASE WHEN len(tokens) >= {k} THEN 1 - len(list_distinct(list_transform(range(1, len(tokens) - {k - 2}), lambda i: array_to_string(tokens[i : i + {k - 1}], chr(31))))) / (len(tokens) - {k - 1}) ELSE 0 END"
SQL |= {
    "overlap_5gram": f"WITH {_G} SELECT gen_id, round(rate, 8) AS rate FROM gp",
    "longest_copied_span": f"WITH {_G} SELECT gen_id, span FROM gp",
    "copy_histogram": f"WITH {_G} SELECT CASE WHEN span <= 3 THEN '0-3' WHEN span <= 6 THEN '4-6' WHEN span <= 9 THEN '7-9' ELSE '10+' END AS bucket, count(*) AS texts FROM gp GROUP BY 1",
    "longest_copies": f"WITH {_G} SELECT gen_id, span FROM gp ORDER BY span DESC, gen_id LIMIT 6",
    "copies_by_setting": f"WITH {_G} SELECT model_order, temperature, count(*) AS texts, round(avg(span), 6) AS mean_span, round(avg(rate), 6) AS mean_overlap, round(avg((span >= 10)::INT), 6) AS long_copies, round(avg(hit_eos::INT), 6) AS ended FROM gt JOIN gp USING (gen_id) GROUP BY model_order, temperature",
    "repetition_stats": f"WITH {_G} SELECT gen_id, len(tokens) AS length, round(CASE WHEN len(tokens) > 0 THEN len(list_distinct(tokens)) / len(tokens) ELSE 0 END, 8) AS type_token_ratio, round({_REP(2)}, 8) AS repeated_2gram_rate, round({_REP(3)}, 8) AS repeated_3gram_rate FROM (SELECT gen_id, tokens FROM gl)",
    "repetition_census": f"WITH {_G}, x AS (SELECT gen_id, model_order, round({_REP(3)}, 3) AS rate, repeated_3gram_rate AS said FROM gl) SELECT model_order, count(*) AS texts, count(*) FILTER (rate > 0) AS repeating, count(*) FILTER (said IS NULL OR isnan(said)) AS missing, count(*) FILTER (said IS NOT NULL AND NOT isnan(said) AND abs(said - rate) > 0.0015) AS stale FROM x GROUP BY model_order",
    "pairwise_jaccard": f"WITH {_G}, p AS (SELECT gen_id, array_to_string(prompt, ' ') AS prompt, list_distinct(tokens) AS s FROM gl WHERE len(tokens) > 0) SELECT a.prompt, count(*) AS pairs, round(avg(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))), 8) AS mean_jaccard FROM p a JOIN p b ON a.prompt = b.prompt AND a.gen_id < b.gen_id GROUP BY a.prompt",
}


PROMPT = ["近日"]


def _runs(spark: SparkSession, settings: list[tuple[str, float, int, float]], seeds: list[int]) -> DataFrame:
    rows = [(PROMPT, p, v, k, t, s) for p, v, k, t in settings for s in seeds]
    return spark.createDataFrame(rows, "prompt array<string>, policy string, value double, top_k int, top_p double, seed int")


def _decoded(spark: SparkSession, folder: str, settings: list[tuple[str, float, int, float]], seeds: list[int], order: int = 3, copying: bool = False) -> DataFrame:
    train = cut(corpus(spark, folder, "train"))
    known = decoding.training_runs(train) if copying else None
    return decoding.generated(_runs(spark, settings, seeds), lm.train(train, order), known=known)


def _listed(g: DataFrame) -> DataFrame:
    logs = F.aggregate("steps", F.lit(0.0), lambda a, x: a + F.log10(x["p"]))
    return g.select("policy", "value", "top_k", "top_p", "seed", F.array_join("tokens", " ").alias("words"), F.size("tokens").alias("length"), "hit_eos", F.round(logs, 6).alias("log10_p"))


def greedy_decode(spark: SparkSession, folder: str) -> DataFrame:
    return _listed(_decoded(spark, folder, [("greedy", 1.0, 0, 1.0)], [11]))


def sample_decode(spark: SparkSession, folder: str) -> DataFrame:
    return _listed(_decoded(spark, folder, [("fixed", t, k, p) for t in (0.7, 1.0, 1.3) for k, p in ((0, 1.0), (50, 1.0), (0, 0.9))], [11, 22, 33]))


def beam_decode(spark: SparkSession, folder: str) -> DataFrame:
    return _listed(_decoded(spark, folder, [("beam", w, 0, a) for w in (1.0, 5.0) for a in (0.0, 1.0)], [11]))


def adaptive_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return _listed(_decoded(spark, folder, [("entropy", b, 0, 1.0) for b in (2.0, 4.0)], [11, 22], order=5))


def anticopy_decode(spark: SparkSession, folder: str) -> DataFrame:
    return _listed(_decoded(spark, folder, [("anticopy", r, 0, 1.0) for r in (4.0, 6.0)], [11, 22], order=5, copying=True))


def generation_trace(spark: SparkSession, folder: str) -> DataFrame:
    """Every step of sampled texts: word, probability, entropy before the choice, words that stood to choose, the likeliest one's probability and the matched order."""
    g = _decoded(spark, folder, [("fixed", 0.7, 50, 1.0), ("fixed", 1.0, 0, 0.9)], [11, 22], order=5)
    s = g.select("value", "seed", F.posexplode("steps").alias("step", "s"))
    r = lambda c: F.round(f"s.{c}", 6).alias(c)
    return s.select("value", "seed", "step", "s.word", r("p"), r("q"), r("entropy"), "s.kept", r("top"), "s.match")


def generation_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Texts generated under several policies, then held against training: self-perplexity (also its geometric mean), means over steps, copied spans and repetition per policy."""
    g = _decoded(spark, folder, [("greedy", 1.0, 0, 1.0), ("fixed", 0.7, 50, 1.0), ("fixed", 1.0, 0, 0.9), ("entropy", 3.0, 0, 1.0)], [11, 22, 33])
    g = cut(g.withColumn("id", F.xxhash64("policy", "value", "seed")).withColumn("own", F.col("tokens")).withColumn("tokens", F.concat("prompt", "tokens")).withColumn("start", F.size("prompt")))
    f = cut(overlap.found_spans(g, ["id"], corpus(spark, folder, "train"), longest=12))
    mean = lambda c: F.aggregate(F.transform("steps", lambda x: x[c].cast("double")), F.lit(0.0), lambda a, x: a + x) / F.size("steps")
    self_ppl = F.pow(F.lit(10.0), -F.aggregate("steps", F.lit(0.0), lambda a, x: a + F.log10(x["p"])) / F.size("steps"))
    rep = overlap.repetition(F.col("own"))["repeated_3gram_rate"]
    t = g.select("id", "policy", "value", "hit_eos", self_ppl.alias("ppl"), mean("entropy").alias("entropy"), mean("match").alias("match"), mean("top").alias("top"), rep.alias("rep"))
    x = t.join(overlap.longest_copied(g, "id", f, "start"), "id").join(overlap.overlap_rate(g, "id", f, 5), "id")
    a = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return x.groupBy("policy", "value").agg(
        F.count("*").alias("texts"), F.round(F.exp(F.avg(F.ln("ppl"))), 4).alias("geometric_ppl"), a("ppl", "mean_ppl"), a("entropy", "mean_entropy"), a("match", "mean_match"), a("top", "mean_top"), a("rep", "mean_repeated"),
        a("span", "mean_span"), F.round(F.avg(F.nanvl("rate", F.lit(None).cast("double"))), 6).alias("mean_overlap"), F.round(F.avg(F.col("hit_eos").cast("double")), 6).alias("ended"),
    )


def temperature_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Entropy of the next word after one context at several temperatures, and how many words make up nine tenths."""
    d = cut(decoding.distribution_of(lm.train(corpus(spark, folder, "train"), 3), ["近日"]))
    out = []
    for t in (0.5, 0.7, 1.0, 1.3):
        q = decoding.reshaped(d, t, 0, 1.0)
        out.append(q.agg((-F.sum(F.col("q") * F.log2("q"))).alias("h")).select(F.lit(t).alias("temperature"), F.round("h", 6).alias("bits"), F.round(F.pow(F.lit(2.0), "h"), 4).alias("effective")).join(decoding.reshaped(d, t, 0, 0.9).agg(F.count("*").alias("nine_tenths"))))
    return reduce(DataFrame.unionByName, out)


def topk_topp_transform(spark: SparkSession, folder: str) -> DataFrame:
    d = decoding.distribution_of(lm.train(corpus(spark, folder, "train"), 3), ["近日"])
    return decoding.reshaped(cut(d), 0.7, 50, 0.9).withColumn("q", F.round("q", 8))


QUERIES: dict[str, Query] = {f.__name__: f for f in (sb_scores, sb_alpha_grid, sb_alpha_tuned, addk_tuned, sb_sentences, pair_discrimination, rank_metrics, cache_plain, cache_decay, cache_grid, cache_parts, bootstrap_ci, learning_curve, growth_laws, learning_curve_whole, growth_laws_whole, overlap_5gram, longest_copied_span, copy_histogram, longest_copies, copies_by_setting, source_sentence, repetition_stats, repetition_census, pairwise_jaccard, greedy_decode, sample_decode, beam_decode, adaptive_entropy, anticopy_decode, generation_trace, generation_quality, temperature_entropy, topk_topp_transform)}


_TEST_ALL = "SELECT sent_id, article_id, tokens FROM sen WHERE split = 'test'"
#: Each known test sentence of 8 to 40 words, and its copy with two neighbours swapped under the negative id.
_PLACES = "list_filter(range(1, len(tokens)), lambda i: tokens[i] <> tokens[i + 1])"
_SWAPPED = f"""SELECT CASE WHEN s THEN -sent_id - 1 ELSE sent_id END AS sent_id, article_id, CASE WHEN s THEN list_concat(tokens[:i - 1], [tokens[i + 1], tokens[i]], tokens[i + 2:]) ELSE tokens END AS tokens
FROM (SELECT sent_id, article_id, tokens, {_PLACES}[(('0x' || md5('20260930:' || sent_id)[1:12])::BIGINT % len({_PLACES}) + 1)::INT]::INT AS i FROM sen WHERE split = 'test' AND len(tokens) BETWEEN 8 AND 40 AND len({_PLACES}) > 0), (SELECT unnest([false, true]) AS s)"""
_JUDGE = "CASE WHEN abs({m}t - {m}s) < 1e-9::DOUBLE THEN 0.5::DOUBLE WHEN {m}t > {m}s THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_DIST = f"""{model_sql(3)}, hs AS (SELECT * FROM (VALUES (1, ''), (2, '近日'), (3, '<s>' || chr(31) || '近日')) v(k, hist)),
hg AS (SELECT hs.k, coalesce(gamma, 1.0) AS gamma FROM hs LEFT JOIN bo ON bo.k = hs.k AND bo.hist = hs.hist),
ds AS (SELECT w, arg_max(p, en.k) * coalesce((SELECT product(gamma) FROM hg WHERE hg.k > max(en.k)), 1.0) AS p FROM en JOIN hs ON en.k = hs.k AND en.hist = hs.hist WHERE w <> '<unk>' GROUP BY w)"""


def _reshaped_sql(temperature: float, top_k: int, top_p: float) -> str:
    limit = f"WHERE r <= {top_k}" if top_k else ""
    return f"""(SELECT w, q / sum(q) OVER () AS q FROM (SELECT w, q, coalesce(sum(q) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT w, r, x / sum(x) OVER () AS q FROM (SELECT w, r, pow(p, 1 / {temperature}::DOUBLE) AS x FROM (SELECT w, p, row_number() OVER (ORDER BY p DESC, w) AS r FROM ds) {limit}))) WHERE before < {top_p})"""


_DRAWS = "(SELECT unnest(range(1, 1001)) AS rep)"
_U = "((('0x' || md5('20260930:' || {key} || ':' || rep)[1:12])::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE)"


def _poisson_sql(key: str) -> str:
    u, total, term, parts = _U.format(key=key), 0.0, 0.36787944117144233, []
    for k in range(1, 8):
        total += term
        parts.append(f"({u} > {total!r}::DOUBLE)::INT")
        term /= k
    return " + ".join(parts)


def _walk_sql() -> str:
    """The likeliest word again and again, by recursion."""
    step = """SELECT gr.n, gr.c1, gr.words, gr.lp, en.w, max(struct_pack(k := en.k, s := en.p * CASE en.k WHEN 3 THEN 1.0 WHEN 2 THEN coalesce(b3.gamma, 1.0) ELSE coalesce(b2.gamma, 1.0) * coalesce(b3.gamma, 1.0) END)).s AS s
FROM gr LEFT JOIN bo b2 ON b2.k = 2 AND b2.hist = gr.c1 LEFT JOIN bo b3 ON b3.k = 3 AND b3.hist = gr.c2 || chr(31) || gr.c1 JOIN en ON en.w <> '<unk>' AND en.hist = CASE en.k WHEN 1 THEN '' WHEN 2 THEN gr.c1 ELSE gr.c2 || chr(31) || gr.c1 END
WHERE gr.n < 40 AND gr.c1 <> '</s>' GROUP BY ALL"""
    return f"""WITH RECURSIVE {model_sql(3)}, gr(n, c2, c1, words, lp) AS (SELECT 0, '<s>', '近日', []::VARCHAR[], 0.0::DOUBLE UNION ALL
SELECT n + 1, c1, w, CASE WHEN w = '</s>' THEN words ELSE list_append(words, w) END, lp + log10(s) FROM (SELECT *, row_number() OVER (ORDER BY s DESC, w) AS r FROM ({step})) WHERE r = 1)
SELECT 'greedy' AS policy, 1.0::DOUBLE AS value, 0 AS top_k, 1.0::DOUBLE AS top_p, 11 AS seed, array_to_string(words, ' ') AS words, len(words)::INT AS length, c1 = '</s>' AS hit_eos, round(lp, 6) AS log10_p FROM gr ORDER BY n DESC LIMIT 1"""


SQL |= {
    "greedy_decode": _walk_sql(),
    "topk_topp_transform": f"WITH {_DIST} SELECT w, round(q, 8) AS q FROM {_reshaped_sql(0.7, 50, 0.9)}",
    "temperature_entropy": f"WITH {_DIST} " + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS temperature, round(h, 6) AS bits, round(pow(2.0, h), 4) AS effective, (SELECT count(*) FROM {_reshaped_sql(t, 0, 0.9)}) AS nine_tenths FROM (SELECT -sum(q * log2(q)) AS h FROM {_reshaped_sql(t, 0, 1.5)})" for t in (0.5, 0.7, 1.0, 1.3)),
    "pair_discrimination": f"""SELECT sent_id, {_JUDGE.format(m='k')} AS kn, {_JUDGE.format(m='b')} AS sb
FROM (SELECT CASE WHEN sent_id < 0 THEN -sent_id - 1 ELSE sent_id END AS sent_id, max(CASE WHEN sent_id >= 0 THEN v END) AS kt, max(CASE WHEN sent_id < 0 THEN v END) AS ks, bool_or(o AND sent_id >= 0) AS o FROM (WITH {model_sql(3, test=_SWAPPED)} SELECT sent_id, sum(log10(p)) AS v, bool_or(oov) AS o FROM sc GROUP BY sent_id) GROUP BY 1) kn
JOIN (SELECT CASE WHEN sent_id < 0 THEN -sent_id - 1 ELSE sent_id END AS sent_id, max(CASE WHEN sent_id >= 0 THEN v END) AS bt, max(CASE WHEN sent_id < 0 THEN v END) AS bs FROM ({_sb_sql('test', _SWAPPED)} SELECT sent_id, sum(log10(greatest({_SC.format(a='0.4::DOUBLE')}, 1e-300::DOUBLE))) AS v FROM pr GROUP BY sent_id) GROUP BY 1) sb USING (sent_id) WHERE NOT o""",
    "bootstrap_ci": _cache_sql("test", None) + f""", ga AS (SELECT article_id, -sum(log10(p)) AS a, -sum(log10({_MIX.format(x='0.15::DOUBLE')})) AS b, count(*) AS n FROM cc GROUP BY article_id),
re AS (SELECT rep, pow(10.0, sum(t * (b - a)) / nullif(sum(t * n), 0)) - 1 AS x FROM (SELECT *, {_poisson_sql('article_id')} AS t FROM ga, {_DRAWS}) GROUP BY rep)
SELECT (SELECT count(*) FROM ga) AS groups, (SELECT round(pow(10.0, (sum(b) - sum(a)) / sum(n)) - 1, 6) FROM ga) AS change, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM re""",
    "rank_metrics": f"""WITH {model_sql(3, test=_TEST_ALL)}, ctx AS (SELECT sent_id, pos, any_value(w) AS w, max(CASE WHEN k = 2 THEN hist END) AS h2, max(CASE WHEN k = 3 THEN hist END) AS h3 FROM ev GROUP BY sent_id, pos),
cd AS (SELECT DISTINCT h2, h3 FROM ctx), cg AS (SELECT cd.*, coalesce(b2.gamma, 1.0) AS g2, coalesce(b3.gamma, 1.0) AS g3 FROM cd LEFT JOIN bo b2 ON b2.k = 2 AND b2.hist = h2 LEFT JOIN bo b3 ON b3.k = 3 AND b3.hist = h3),
al AS (SELECT cg.h2, cg.h3, u.w, coalesce(e3.p, g3 * coalesce(e2.p, g2 * u.p)) AS p FROM cg JOIN en u ON u.k = 1 AND u.w <> '<unk>' LEFT JOIN en e2 ON e2.k = 2 AND e2.hist = h2 AND e2.w = u.w LEFT JOIN en e3 ON e3.k = 3 AND e3.hist = h3 AND e3.w = u.w),
tru AS (SELECT ctx.sent_id, ctx.pos, ctx.h2, ctx.h3, ctx.w, al.p FROM ctx LEFT JOIN al ON al.w = ctx.w AND al.h2 = ctx.h2 AND al.h3 IS NOT DISTINCT FROM ctx.h3),
gq AS (SELECT tru.sent_id, tru.pos, any_value(tru.p) AS p, count(*) FILTER (al.p > tru.p * (1 + 1e-12::DOUBLE))::DOUBLE AS g, count(*) FILTER (abs(al.p - tru.p) <= tru.p * 1e-12::DOUBLE)::DOUBLE - 1 AS e FROM tru JOIN al ON al.h2 = tru.h2 AND al.h3 IS NOT DISTINCT FROM tru.h3 GROUP BY tru.sent_id, tru.pos),
hm AS (SELECT i, sum(1.0::DOUBLE / i) OVER (ORDER BY i) AS h FROM range(1, 2000000) t(i)),
m AS (SELECT p IS NOT NULL AS k, g, e, CASE WHEN p IS NULL THEN 0 ELSE (hb.h - coalesce(ha.h, 0)) / (e + 1) END AS rr FROM gq LEFT JOIN hm ha ON ha.i = g::BIGINT LEFT JOIN hm hb ON hb.i = (g + e + 1)::BIGINT)
SELECT count(*) AS n, """ + ", ".join(f"round(avg(CASE WHEN k THEN least(greatest(({x} - g) / (e + 1), 0), 1) ELSE 0 END), 6) AS hit_{x}" for x in (1, 5, 10)) + ", round(avg(rr), 6) AS mrr, median(CASE WHEN k THEN g + 1 + e / 2 END) AS median_rank FROM m",
    "source_sentence": f"""WITH {_G}, bt AS (SELECT gen_id, n, i, t FROM (SELECT *, row_number() OVER (PARTITION BY gen_id ORDER BY n DESC, i) AS r FROM gf WHERE n >= 4) WHERE r = 1),
so AS (SELECT sent_id, tokens AS s, j, n, array_to_string(tokens[j : j + n - 1], chr(31)) AS t FROM (SELECT sent_id, tokens, unnest(range(1, len(tokens) + 1)) AS j FROM sentences), range(4, 13) x(n) WHERE j + n - 1 <= len(tokens)),
fs AS (SELECT * FROM (SELECT bt.gen_id, bt.i, bt.n, gt.tokens AS q, sent_id, j, s, row_number() OVER (PARTITION BY bt.gen_id ORDER BY sent_id, j) AS r FROM bt JOIN gt USING (gen_id) JOIN so USING (t, n)) WHERE r = 1)
SELECT gen_id, sent_id, (n + coalesce(list_position(list_transform(range(1, 1000), lambda x: coalesce(i - x >= 1 AND j - x >= 1 AND q[greatest(i - x, 1)] = s[greatest(j - x, 1)], false)), false), 1) - 1
+ coalesce(list_position(list_transform(range(1, 1000), lambda x: coalesce(i + n - 1 + x <= len(q) AND j + n - 1 + x <= len(s) AND q[i + n - 1 + x] = s[j + n - 1 + x], false)), false), 1) - 1)::INT AS words FROM fs""",
}
