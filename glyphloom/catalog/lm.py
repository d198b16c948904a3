"""Counts, smoothing and back-off models over the annotated sentences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.catalog import Query
from glyphloom.operators import lm, smoothing
from glyphloom.operators import ngrams as ng
from glyphloom.plans.materialise import cut
from glyphloom.sources.tables import table


def corpus(spark: SparkSession, folder: str, *splits: str) -> DataFrame:
    """Sentences with the split of their article; articles without one are left out."""
    of = table(spark, folder, "articles").where("split IS NOT NULL").groupBy(F.col("article_id").alias("_a")).agg(F.max("split").alias("split"))
    s = table(spark, folder, "sentences").select("sent_id", "article_id", "sent_no", "source", "tokens", "tags")
    s = s.join(of, F.col("article_id") == F.col("_a")).drop("_a")
    return s.where(F.col("split").isin(*splits)) if splits else s


CORPUS_SQL = """sp AS (SELECT article_id, max(split) AS split FROM articles WHERE split IS NOT NULL GROUP BY article_id),
sen AS (SELECT s.sent_id, s.article_id, s.sent_no, s.source, s.tokens, s.tags, sp.split FROM sentences s JOIN sp USING (article_id))"""


def counts_sql(order: int, train: str = "SELECT sent_id, tokens FROM sen WHERE split = 'train'") -> str:
    return f"""{CORPUS_SQL}, tr AS ({train}),
tq AS (SELECT list_concat(['<s>'], tokens, ['</s>']) AS q FROM tr),
tp AS (SELECT q, unnest(range(0, len(q) - 1)) AS pos FROM tq),
g AS (SELECT k, array_to_string(q[pos + 3 - k : pos + 1], chr(31)) AS hist, q[pos + 2] AS w FROM tp, range(1, {order + 1}) t(k) WHERE k <= pos + 2),
c AS (SELECT k, hist, w, count(*) AS c FROM g GROUP BY ALL),
a AS (SELECT k, hist, w, c AS a FROM c WHERE k = {order} OR (k > 1 AND split_part(hist, chr(31), 1) = '<s>')
  UNION ALL SELECT k - 1, CASE WHEN contains(hist, chr(31)) THEN substr(hist, instr(hist, chr(31)) + 1) ELSE '' END, w, count(*) FROM c WHERE k > 1 GROUP BY ALL),
coc AS (SELECT k, count(*) FILTER (a = 1) AS n1, count(*) FILTER (a = 2) AS n2, count(*) FILTER (a = 3) AS n3, count(*) FILTER (a = 4) AS n4 FROM a GROUP BY k),
dd AS (SELECT k, n1 / (n1 + 2 * n2) AS y, n1, n2, n3, n4 FROM coc),
de AS (SELECT k, 1 - 2 * y * n2 / n1 AS d1, 2 - 3 * y * n3 / n2 AS d2, 3 - 4 * y * n4 / n3 AS d3, n1 > 0 AND n2 > 0 AND n3 > 0 AND n4 > 0 AS g FROM dd),
dm AS (SELECT k, CASE WHEN g AND d1 BETWEEN 0 AND 1 AND d2 BETWEEN 0 AND 2 AND d3 BETWEEN 0 AND 3 THEN d1 ELSE 0.5 END AS d1, CASE WHEN g AND d1 BETWEEN 0 AND 1 AND d2 BETWEEN 0 AND 2 AND d3 BETWEEN 0 AND 3 THEN d2 ELSE 1.0 END AS d2, CASE WHEN g AND d1 BETWEEN 0 AND 1 AND d2 BETWEEN 0 AND 2 AND d3 BETWEEN 0 AND 3 THEN d3 ELSE 1.5 END AS d3 FROM de)"""


def model_sql(order: int, method: str = "modified", prune: list[int] | None = None, train: str = "SELECT sent_id, tokens FROM sen WHERE split = 'train'", test: str = "SELECT sent_id, article_id, tokens FROM sen WHERE split = 'test'") -> str:
    """CTEs up to ``sc``: sent_id, article_id, pos, w, oov, p, match of every test event."""
    counted = "SELECT k, hist, w, c AS a FROM c" if method == "witten_bell" else "SELECT * FROM a"
    d = "SELECT k, n1 / (n1 + 2 * n2) AS d1, n1 / (n1 + 2 * n2) AS d2, n1 / (n1 + 2 * n2) AS d3 FROM coc" if method == "original" else "SELECT * FROM dm"
    gamma = "types / (denom + types)" if method == "witten_bell" else "(d1 * b1 + d2 * b2 + d3 * b3) / denom"
    own = "a / (denom + types)" if method == "witten_bell" else "greatest(a - CASE WHEN a >= 3 THEN d3 WHEN a = 2 THEN d2 WHEN a = 1 THEN d1 ELSE 0 END, 0) / denom"
    limit = "0" if not prune else "CASE " + " ".join(f"WHEN s.k = {i + 1} THEN {t}" for i, t in enumerate(prune)) + f" ELSE {prune[-1]} END"
    sql = f"""{counts_sql(order, train)},
am AS ({counted}), d AS ({d}),
h AS (SELECT k, hist, sum(a)::DOUBLE AS denom, count(*) AS types, count(*) FILTER (a = 1) AS b1, count(*) FILTER (a = 2) AS b2, count(*) FILTER (a >= 3) AS b3 FROM am GROUP BY k, hist),
h0 AS (SELECT h.k, hist, denom, types, {gamma} AS gamma FROM h JOIN d ON h.k = d.k),
s0 AS (SELECT am.k, am.hist, am.w, {own} AS own FROM am JOIN h0 ON am.k = h0.k AND am.hist = h0.hist JOIN d ON d.k = am.k),
s1 AS (SELECT s.*, c.c > {limit} AS kept FROM s0 s JOIN c ON s.k = c.k AND s.hist = c.hist AND s.w = c.w),
bo AS (SELECT h0.k, h0.hist, gamma + coalesce(l.lost, 0) AS gamma FROM h0 LEFT JOIN (SELECT k, hist, sum(own) AS lost FROM s1 WHERE NOT kept GROUP BY k, hist) l ON h0.k = l.k AND h0.hist = l.hist),
wd AS (SELECT DISTINCT unnest(tokens) AS w FROM tr UNION SELECT '</s>'),
p1 AS (SELECT 1 AS k, '' AS hist, w, own + (SELECT gamma FROM bo WHERE k = 1) / ((SELECT count(*) FROM wd) + 1) AS p FROM (SELECT w, own FROM s1 WHERE k = 1 AND kept UNION ALL SELECT '<unk>', 0.0))"""
    for k in range(2, order + 1):
        sql += f""",
p{k} AS (SELECT s.k, s.hist, s.w, s.own + b.gamma * l.p AS p FROM s1 s JOIN bo b ON b.k = {k} AND b.hist = s.hist JOIN p{k - 1} l ON l.w = s.w AND l.hist = CASE WHEN contains(s.hist, chr(31)) THEN substr(s.hist, instr(s.hist, chr(31)) + 1) ELSE '' END WHERE s.k = {k} AND s.kept)"""
    every = " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(1, order + 1))
    return f"""{sql},
en AS ({every}),
te AS ({test}),
tm AS (SELECT x.sent_id, x.article_id, list(coalesce(wd.w, '<unk>') ORDER BY i) AS tokens FROM (SELECT sent_id, article_id, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS i FROM te) x LEFT JOIN wd ON x.t = wd.w GROUP BY ALL),
eq AS (SELECT sent_id, article_id, list_concat(['<s>'], tokens, ['</s>']) AS q FROM tm),
ep AS (SELECT sent_id, article_id, q, unnest(range(0, len(q) - 1)) AS pos FROM eq),
ev AS (SELECT sent_id, article_id, pos, k, array_to_string(q[pos + 3 - k : pos + 1], chr(31)) AS hist, q[pos + 2] AS w FROM ep, range(1, {order + 1}) t(k) WHERE k <= pos + 2),
ej AS (SELECT ev.*, en.p, coalesce(bo.gamma, 1.0) AS gamma, max(CASE WHEN en.p IS NOT NULL THEN ev.k END) OVER (PARTITION BY ev.sent_id, ev.pos) AS match FROM ev LEFT JOIN en ON ev.k = en.k AND ev.hist = en.hist AND ev.w = en.w LEFT JOIN bo ON ev.k = bo.k AND ev.hist = bo.hist),
sc AS (SELECT sent_id, article_id, pos, w, w = '<unk>' AS oov, max(CASE WHEN k = match THEN p END) * coalesce(product(CASE WHEN k > match THEN gamma END), 1.0) AS p, any_value(match) AS match FROM ej GROUP BY sent_id, article_id, pos, w)"""


SUMMARY_SQL = "count(*) AS events, count(*) FILTER (oov) AS oov_events, round(-sum(log10(p)) / count(*) / log10(2.0), 4) AS bits, round(pow(10.0, -sum(log10(p)) / count(*)), 4) AS ppl, round(pow(10.0, -sum(log10(p)) FILTER (NOT oov) / count(*) FILTER (NOT oov)), 4) AS ppl_known, round(avg(match) FILTER (NOT oov), 4) AS mean_match"

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("hist", F.replace("hist", F.lit(ng.SEP), F.lit(" ")))


def _train(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder, "train")


def ngram_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(ng.counts(_train(spark, folder), 3))


def ngram_entry_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ng.counts(_train(spark, folder), 5).groupBy("k").agg(F.count("*").alias("entries"), F.sum("c").alias("tokens"))


def continuation_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(ng.adjusted(ng.counts(_train(spark, folder), 3), 3))


def history_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(ng.history_stats(ng.counts(_train(spark, folder), 3), "c"))


def count_of_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ng.counts_of_counts(ng.adjusted(ng.counts(_train(spark, folder), 3), 3))


def kn_discounts(spark: SparkSession, folder: str) -> DataFrame:
    d = ng.modified_discounts(ng.counts_of_counts(ng.adjusted(ng.counts(_train(spark, folder), 3), 3)), (0.5, 1.0, 1.5))
    return d.select("k", *[F.round(c, 8).alias(c) for c in ("d1", "d2", "d3")])


_C3 = f"WITH {counts_sql(3)} "
SQL |= {
    "ngram_counts": _C3 + "SELECT k, replace(hist, chr(31), ' ') AS hist, w, c FROM c",
    "ngram_entry_counts": f"WITH {counts_sql(5)} SELECT k, count(*) AS entries, sum(c)::BIGINT AS tokens FROM c GROUP BY k",
    "continuation_counts": _C3 + "SELECT k, replace(hist, chr(31), ' ') AS hist, w, a FROM a",
    "history_stats": _C3 + "SELECT k, replace(hist, chr(31), ' ') AS hist, sum(c)::BIGINT AS denom, count(*) AS types, count(*) FILTER (c = 1) AS b1, count(*) FILTER (c = 2) AS b2, count(*) FILTER (c >= 3) AS b3 FROM c GROUP BY k, hist",
    "count_of_counts": _C3 + "SELECT * FROM coc",
    "kn_discounts": _C3 + "SELECT k, round(d1, 8) AS d1, round(d2, 8) AS d2, round(d3, 8) AS d3 FROM dm",
}


def continuation_diversity(spark: SparkSession, folder: str) -> DataFrame:
    """Words seen at least 20 times: count, distinct left words, their ratio and the most frequent left word."""
    b = ng.counts(_train(spark, folder), 2).where("k = 2")
    out = b.groupBy("w").agg(F.sum("c").alias("count"), F.count("*").alias("left_types"), F.max_by("hist", F.struct("c", "hist")).alias("top_left"))
    return out.where((F.col("count") >= 20) & (F.col("w") != ng.EOS)).withColumn("ratio", F.round(F.col("left_types") / F.col("count"), 8))


SQL["continuation_diversity"] = _C3 + """, b AS (SELECT w, hist, c, row_number() OVER (PARTITION BY w ORDER BY c DESC, hist DESC) AS r FROM c WHERE k = 2)
SELECT w, sum(c)::BIGINT AS count, count(*) AS left_types, max(CASE WHEN r = 1 THEN hist END) AS top_left, round(count(*) / sum(c), 8) AS ratio FROM b WHERE w <> '</s>' GROUP BY w HAVING sum(c) >= 20"""


def event_rows(spark: SparkSession, folder: str, split: str = "test") -> DataFrame:
    train, test = _train(spark, folder), corpus(spark, folder, split)
    return smoothing.event_statistics(train, ng.grams(test, 3, ["sent_id"]), ["sent_id"])


def smooth_events(spark: SparkSession, folder: str) -> DataFrame:
    """The probability of every test event under five smoothers."""
    e = event_rows(spark, folder)
    p = {"p_mle": smoothing.p_mle(), "p_addk": smoothing.p_addk(0.01), "p_jm": smoothing.p_jm(0.5, 0.3, 0.19, 0.01), "p_wb": smoothing.p_witten_bell(), "p_kn": smoothing.p_kneser_ney()}
    return e.select("sent_id", "pos", *[F.round(x, 10).alias(n) for n, x in p.items()])


def ppl_by_smoother(spark: SparkSession, folder: str) -> DataFrame:
    e = cut(event_rows(spark, folder))
    p = {"mle": smoothing.p_mle(), "add_1": smoothing.p_addk(1.0), "add_k": smoothing.p_addk(0.01), "jm": smoothing.p_jm(0.5, 0.3, 0.19, 0.01), "wb": smoothing.p_witten_bell(), "kn": smoothing.p_kneser_ney()}
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("smoother"), x.alias("p")) for n, x in p.items()])).alias("_s")
    return e.select(parts).select("_s.*").groupBy("smoother").agg(*smoothing.perplexity(F.col("p")))


def addk_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Dev perplexity of add-k over a grid of k, each row of which joins every event: the grid is a stated handful."""
    e = event_rows(spark, folder, "dev")
    grid = F.explode(F.array(*[F.lit(k) for k in (1.0, 0.5, 0.1, 0.05, 0.01, 0.005, 0.001)])).alias("k_add")
    return e.select("*", grid).select("k_add", smoothing.p_addk(F.col("k_add")).alias("p")).groupBy("k_add").agg(*smoothing.perplexity(F.col("p"))).select("k_add", "ppl")


def jm_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Dev perplexity over interpolation weights in steps of a tenth (weight of the uniform part 0.01)."""
    e = event_rows(spark, folder, "dev")
    weights = [(a / 10, b / 10, round(0.99 - a / 10 - b / 10, 2)) for a in range(0, 10) for b in range(0, 10) if 0.99 - a / 10 - b / 10 >= 0.04]
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("l3"), F.lit(b).alias("l2"), F.lit(c).alias("l1")) for a, b, c in weights])).alias("l")
    p = smoothing.p_jm(F.col("l.l3"), F.col("l.l2"), F.col("l.l1"), 0.01)
    return e.select("*", grid).select("l", p.alias("p")).groupBy("l.l3", "l.l2", "l.l1").agg(*smoothing.perplexity(F.col("p"))).select("l3", "l2", "l1", "ppl")


def zero_prob_events(spark: SparkSession, folder: str) -> DataFrame:
    """Test trigrams with a frequent history (20 and more) and a seen bigram that never occur in training, with all smoothers."""
    e = event_rows(spark, folder).where("context = 3 AND d3 >= 20 AND c2 > 0 AND c3 = 0")
    return e.select("sent_id", "pos", "w", F.col("d3").alias("history"), F.col("c2").alias("bigram"), F.round(smoothing.p_witten_bell(), 10).alias("p_wb"), F.round(smoothing.p_kneser_ney(), 10).alias("p_kn"))


def _event_sql(split: str) -> str:
    return model_sql(3, test=f"SELECT sent_id, article_id, tokens FROM sen WHERE split = '{split}'") + """,
rh AS (SELECT k, hist, sum(c)::DOUBLE AS rd, count(*) AS rt FROM c GROUP BY k, hist),
cu AS (SELECT a.k, a.hist, a.w, greatest(a.a - CASE WHEN a.a >= 3 THEN d3 WHEN a.a = 2 THEN d2 WHEN a.a = 1 THEN d1 ELSE 0 END, 0) AS e FROM a JOIN dm ON a.k = dm.k),
st AS (SELECT ev.sent_id, ev.pos, ev.w, max(ev.k) AS context, """ + ", ".join(
        f"coalesce(max(CASE WHEN ev.k = {k} THEN {col} END), 0) AS {n}{k}" for k in (1, 2, 3) for n, col in (("c", "c.c"), ("d", "rd"), ("t", "rt"), ("e", "e"), ("z", "denom"), ("g", "gamma"))
    ) + """ FROM ev LEFT JOIN c ON ev.k = c.k AND ev.hist = c.hist AND ev.w = c.w LEFT JOIN cu ON ev.k = cu.k AND ev.hist = cu.hist AND ev.w = cu.w LEFT JOIN rh ON ev.k = rh.k AND ev.hist = rh.hist LEFT JOIN h0 ON ev.k = h0.k AND ev.hist = h0.hist GROUP BY ev.sent_id, ev.pos, ev.w),
nn AS (SELECT sum(c)::DOUBLE AS n, count(*) AS t1x, count(*) + 1 AS v FROM c WHERE k = 1),
x AS (SELECT *, CASE WHEN context = 3 THEN d3 ELSE d2 END AS dh, CASE WHEN context = 3 THEN c3 ELSE c2 END AS ch, (c1 + t1x / v) / (n + t1x) AS wb1, e1 / (SELECT denom FROM h0 WHERE k = 1) + (SELECT gamma FROM h0 WHERE k = 1) / v AS kn1 FROM st, nn),
y AS (SELECT *, CASE WHEN d2 > 0 THEN (c2 + t2 * wb1) / (d2 + t2) ELSE wb1 END AS wb2, CASE WHEN z2 > 0 THEN e2 / z2 + g2 * kn1 ELSE kn1 END AS kn2 FROM x),
z AS (SELECT *, CASE WHEN dh > 0 THEN ch / dh ELSE 0 END AS p_mle, CASE WHEN d3 > 0 THEN (c3 + t3 * wb2) / (d3 + t3) ELSE wb2 END AS p_wb, CASE WHEN z3 > 0 THEN e3 / z3 + g3 * kn2 ELSE kn2 END AS p_kn FROM y)"""


def _jm_sql(l3: str, l2: str, l1: str, l0: str) -> str:
    return f"(({l1} * c1 / n + {l0} / v + CASE WHEN d2 > 0 THEN {l2} * c2 / d2 ELSE 0 END + CASE WHEN context = 3 AND d3 > 0 THEN {l3} * c3 / d3 ELSE 0 END) / ({l1} + {l0} + CASE WHEN d2 > 0 THEN {l2} ELSE 0 END + CASE WHEN context = 3 AND d3 > 0 THEN {l3} ELSE 0 END))"


_PPL = "count(*) AS events, count(*) FILTER (p <= 0) AS zero_events, CASE WHEN count(*) FILTER (p <= 0) > 0 THEN 'Infinity'::DOUBLE ELSE round(pow(2.0, -sum(log2(p)) FILTER (p > 0) / count(*)), 4) END AS ppl, round(pow(2.0, -sum(log2(p)) FILTER (p > 0) / nullif(count(*) FILTER (p > 0), 0)), 4) AS ppl_nonzero"
_JM = _jm_sql("0.5::DOUBLE", "0.3::DOUBLE", "0.19::DOUBLE", "0.01::DOUBLE")
SQL |= {
    "smooth_events": f"WITH {_event_sql('test')} SELECT sent_id, pos::INT AS pos, round(p_mle, 10) AS p_mle, round((ch + 0.01::DOUBLE) / (dh + 0.01::DOUBLE * v), 10) AS p_addk, round({_JM}, 10) AS p_jm, round(p_wb, 10) AS p_wb, round(p_kn, 10) AS p_kn FROM z",
    "ppl_by_smoother": f"WITH {_event_sql('test')}, q2 AS (SELECT 'mle' AS smoother, p_mle AS p FROM z UNION ALL SELECT 'add_1', (ch + 1.0::DOUBLE) / (dh + 1.0::DOUBLE * v) FROM z UNION ALL SELECT 'add_k', (ch + 0.01::DOUBLE) / (dh + 0.01::DOUBLE * v) FROM z UNION ALL SELECT 'jm', {_JM} FROM z UNION ALL SELECT 'wb', p_wb FROM z UNION ALL SELECT 'kn', p_kn FROM z) SELECT smoother, {_PPL} FROM q2 GROUP BY smoother",
    "addk_grid": f"WITH {_event_sql('dev')}, q2 AS (SELECT k_add, (ch + k_add) / (dh + k_add * v) AS p FROM z, (SELECT unnest([1.0, 0.5, 0.1, 0.05, 0.01, 0.005, 0.001]::DOUBLE[]) AS k_add)) SELECT k_add, ppl FROM (SELECT k_add, {_PPL} FROM q2 GROUP BY k_add)",
    "jm_grid": f"WITH {_event_sql('dev')}, gr AS (SELECT a / 10 AS l3, b / 10 AS l2, round(0.99::DOUBLE - a / 10 - b / 10, 2) AS l1 FROM range(0, 10) x(a), range(0, 10) y(b) WHERE 0.99::DOUBLE - a / 10 - b / 10 >= 0.04), q2 AS (SELECT l3, l2, l1, {_jm_sql('l3', 'l2', 'l1', '0.01::DOUBLE')} AS p FROM z, gr) SELECT l3, l2, l1, ppl FROM (SELECT l3, l2, l1, {_PPL} FROM q2 GROUP BY l3, l2, l1)",
    "zero_prob_events": f"WITH {_event_sql('test')} SELECT sent_id, pos::INT AS pos, w, d3::BIGINT AS history, c2::BIGINT AS bigram, round(p_wb, 10) AS p_wb, round(p_kn, 10) AS p_kn FROM z WHERE context = 3 AND d3 >= 20 AND c2 > 0 AND c3 = 0",
}


def _scored(spark: SparkSession, folder: str, order: int, method: str = "modified", prune: list[int] | None = None, split: str = "test") -> DataFrame:
    return lm.scores(lm.train(_train(spark, folder), order, method=method, prune=prune), corpus(spark, folder, split), ["sent_id"])


MODELS = {"kn_order_2": (2, "modified", None), "kn_order_3": (3, "modified", None), "kn_order_4": (4, "modified", None), "kn_order_5": (5, "modified", None), "kn_pruned_3": (3, "modified", [0, 0, 1]), "kn_pruned_5": (5, "modified", [0, 0, 1, 1, 1]), "kn_original_3": (3, "original", None), "wb_3": (3, "witten_bell", None)}
for _name, (_order, _method, _prune) in MODELS.items():
    QUERIES[_name] = lambda spark, folder, a=(_order, _method, _prune): lm.summary(_scored(spark, folder, *a))
    SQL[_name] = f"WITH {model_sql(_order, _method, _prune)} SELECT {SUMMARY_SQL} FROM sc"


def lm_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The trigram model itself: every entry with its probability and the back-off weight of the history it makes."""
    m = lm.train(_train(spark, folder), 3)
    return _shown(m.entries.withColumn("p", F.round("p", 10)))


def matched_orders(spark: SparkSession, folder: str) -> DataFrame:
    return lm.matched_orders(_scored(spark, folder, 5))


def match_bucket_means(spark: SparkSession, folder: str) -> DataFrame:
    """Mean log10 probability per order by how far the 5-gram model matches: the same events under several models."""
    train, test = _train(spark, folder), corpus(spark, folder, "test")
    full = lm.scores(lm.train(train, 5), test, ["sent_id"]).where(~F.col("oov")).select("sent_id", "pos", F.col("match").alias("bucket"), F.col("p").alias("p5"))
    for k in (2, 3):
        own = lm.scores(lm.train(train, k), test, ["sent_id"]).select("sent_id", "pos", F.col("p").alias(f"p{k}"))
        full = full.join(own, ["sent_id", "pos"])
    return full.groupBy("bucket").agg(F.count("*").alias("events"), *[F.round(F.avg(F.log10(f"p{k}")), 6).alias(f"mean_log10_{k}") for k in (2, 3, 5)])


def pruning_impact(spark: SparkSession, folder: str) -> DataFrame:
    """Where pruning hurts: events by the training count of their trigram, with both models' perplexities and changed positions."""
    train, test = _train(spark, folder), corpus(spark, folder, "test")
    full = lm.train(train, 3)
    a = lm.scores(full, test, ["sent_id"]).select("sent_id", "pos", "oov", F.col("p").alias("pa"))
    b = lm.scores(lm.train(train, 3, prune=[0, 0, 1]), test, ["sent_id"]).select("sent_id", "pos", F.col("p").alias("pb"))
    e = ng.grams(test, 3, ["sent_id"]).where("k = 3").join(full.counted.where("k = 3"), ["k", "hist", "w"], "left").select("sent_id", "pos", F.coalesce("c", F.lit(0)).alias("c"))
    c = F.col("c")
    bucket = F.when(F.col("oov"), "oov").when(c.isNull(), "short").when(c == 0, "0").when(c == 1, "1").when(c <= 4, "2-4").otherwise("5+")
    rows = a.join(b, ["sent_id", "pos"]).join(e, ["sent_id", "pos"], "left").withColumn("bucket", bucket)
    ppl = lambda p: F.round(F.pow(F.lit(10.0), -F.avg(F.log10(p))), 4)
    return rows.groupBy("bucket").agg(F.count("*").alias("events"), ppl("pa").alias("ppl_full"), ppl("pb").alias("ppl_pruned"), F.count_if(F.abs(F.log10("pa") - F.log10("pb")) > 1e-6).alias("changed"))


SQL |= {
    "lm_entries": f"WITH {model_sql(3)} SELECT k::INT AS k, replace(hist, chr(31), ' ') AS hist, w, round(p, 10) AS p FROM en",
    "match_bucket_means": "SELECT f.match::INT AS bucket, count(*) AS events, " + ", ".join(f"round(avg(log10(m{k}.p)), 6) AS mean_log10_{k}" for k in (2, 3, 5)) + f" FROM (WITH {model_sql(5)} SELECT sent_id, pos, match FROM sc WHERE NOT oov) f " + " ".join(f"JOIN (WITH {model_sql(k)} SELECT sent_id, pos, p FROM sc) m{k} USING (sent_id, pos)" for k in (2, 3, 5)) + " GROUP BY f.match",
    "pruning_impact": f"""SELECT CASE WHEN oov THEN 'oov' WHEN NOT long THEN 'short' WHEN c = 0 THEN '0' WHEN c = 1 THEN '1' WHEN c <= 4 THEN '2-4' ELSE '5+' END AS bucket, count(*) AS events, round(pow(10.0, -avg(log10(a.p))), 4) AS ppl_full, round(pow(10.0, -avg(log10(b.p))), 4) AS ppl_pruned, count(*) FILTER (abs(log10(a.p) - log10(b.p)) > 1e-6) AS changed
FROM (WITH {model_sql(3)} SELECT sc.sent_id, sc.pos, sc.oov, sc.p, e.sent_id IS NOT NULL AS long, coalesce(e.c, 0) AS c FROM sc LEFT JOIN (SELECT ev.sent_id, ev.pos, c.c FROM ev LEFT JOIN c ON c.k = 3 AND c.hist = ev.hist AND c.w = ev.w WHERE ev.k = 3) e ON e.sent_id = sc.sent_id AND e.pos = sc.pos) a
JOIN (WITH {model_sql(3, prune=[0, 0, 1])} SELECT sent_id, pos, p FROM sc) b USING (sent_id, pos) GROUP BY 1""",
    "matched_orders": f"WITH {model_sql(5)} SELECT match::INT AS match, count(*) AS events FROM sc WHERE NOT oov GROUP BY match",
}


def bits_per_char(spark: SparkSession, folder: str) -> DataFrame:
    """A word trigram and a character 5-gram model on the same text: bits per character, sentence ends counted once a sentence."""
    train, test = _train(spark, folder), corpus(spark, folder, "test")
    chars = lambda d: d.withColumn("tokens", F.flatten(F.transform("tokens", lambda t: F.split(t, ""))))
    n = test.agg(F.sum(F.char_length(F.concat_ws("", "tokens")) + 1).alias("chars"))
    out = []
    for unit, order, a, b in (("word", 3, train, test), ("char", 5, chars(train), chars(test))):
        s = lm.scores(lm.train(a, order), b, ["sent_id"])
        out.append(s.agg(F.count("*").alias("events"), (-F.sum(F.log2("p"))).alias("bits")).join(n).select(F.lit(unit).alias("unit"), "events", "chars", F.round(F.col("bits") / F.col("chars"), 4).alias("bits_per_char")))
    return reduce(DataFrame.unionByName, out)


def closed_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Perplexity with words under a count, and with all but the most frequent words, mapped to one placeholder that has real counts."""
    train, test = cut(_train(spark, folder)), cut(corpus(spark, folder, "test"))
    freq = cut(ng.vocabulary(train))
    rank = freq.orderBy(F.desc("c"), "w")
    kinds = {"min_2": freq.where("c >= 2"), "min_5": freq.where("c >= 5"), "top_500": rank.limit(500)}
    out = []
    for name, words in kinds.items():
        a, b = (ng.restricted(d.select("sent_id", "tokens"), words.select("w"), ng.RARE, "sent_id") for d in (train, test))
        out.append(lm.summary(lm.scores(lm.train(cut(a), 3), cut(b), ["sent_id"])).select(F.lit(name).alias("vocabulary"), "events", "oov_events", "ppl"))
    return reduce(DataFrame.unionByName, out)


def _closed_sql(name: str, words: str) -> str:
    mapped = lambda split: f"SELECT y.sent_id, y.article_id, list(CASE WHEN k.w IS NULL THEN '<rare>' ELSE y.t END ORDER BY i) AS tokens FROM (SELECT sent_id, article_id, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS i FROM sen WHERE split = '{split}') y LEFT JOIN ({words}) k ON y.t = k.w GROUP BY ALL"
    return f"SELECT * FROM (WITH {model_sql(3, train=mapped('train'), test=mapped('test'))} SELECT '{name}' AS vocabulary, count(*) AS events, count(*) FILTER (oov) AS oov_events, round(pow(10.0, -sum(log10(p)) / count(*)), 4) AS ppl FROM sc)"


_FREQ = "SELECT w, count(*) AS n FROM (SELECT unnest(tokens) AS w FROM sen WHERE split = 'train') GROUP BY w"
SQL["closed_vocabulary"] = " UNION ALL ".join(_closed_sql(n, w) for n, w in {"min_2": f"SELECT w FROM ({_FREQ}) WHERE n >= 2", "min_5": f"SELECT w FROM ({_FREQ}) WHERE n >= 5", "top_500": f"SELECT w FROM ({_FREQ}) ORDER BY n DESC, w LIMIT 500"}.items())
_CH = "SELECT sent_id, article_id, string_split(array_to_string(tokens, ''), '') AS tokens FROM sen WHERE split = "
SQL["bits_per_char"] = (
    f"WITH {CORPUS_SQL}, nc AS (SELECT sum(length(array_to_string(tokens, '')) + 1)::BIGINT AS chars FROM sen WHERE split = 'test') "
    + " UNION ALL ".join(f"SELECT '{u}' AS unit, events, chars, round(bits / chars, 4) AS bits_per_char FROM nc, (WITH {m} SELECT count(*) AS events, -sum(log2(p)) AS bits FROM sc)" for u, m in (("word", model_sql(3)), ("char", model_sql(5, train=_CH + "'train'", test=_CH + "'test'"))))
)


def quantisation(spark: SparkSession, folder: str) -> DataFrame:
    """An 8-bit quantised trigram model beside the exact one: perplexities, and how many events changed."""
    m, test = lm.train(_train(spark, folder), 3), corpus(spark, folder, "test")
    a = lm.scores(m, test, ["sent_id"]).select("sent_id", "pos", F.log10("p").alias("a"))
    b = lm.scores(lm.quantised(m), test, ["sent_id"]).select("sent_id", "pos", F.log10("p").alias("b"))
    x = a.join(b, ["sent_id", "pos"])
    return x.agg(F.count("*").alias("events"), F.round(F.pow(F.lit(10.0), -F.avg("a")), 4).alias("ppl"), F.round(F.pow(F.lit(10.0), -F.avg("b")), 4).alias("ppl_quantised"), F.count_if(F.abs(F.col("a") - F.col("b")) > 1e-6).alias("changed"))


def normalisation(spark: SparkSession, folder: str) -> DataFrame:
    """The sum of P(w | history) over all words after the 100 most frequent two-word histories; a stated set of histories."""
    train = _train(spark, folder)
    m = lm.train(train, 3)
    top = ng.counts(train, 3).where("k = 3").groupBy("hist").agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "hist").limit(100)
    return _shown(lm.mass(m, top)).withColumn("mass", F.round("mass", 9))


SQL["normalisation"] = f"""WITH {model_sql(3)}, t AS (SELECT hist AS h3, substr(hist, instr(hist, chr(31)) + 1) AS h2 FROM c WHERE k = 3 GROUP BY hist ORDER BY sum(c.c) DESC, hist LIMIT 100),
tg AS (SELECT t.*, coalesce(b2.gamma, 1.0) AS g2, coalesce(b3.gamma, 1.0) AS g3 FROM t LEFT JOIN bo b2 ON b2.k = 2 AND b2.hist = h2 LEFT JOIN bo b3 ON b3.k = 3 AND b3.hist = h3)
SELECT replace(h3, chr(31), ' ') AS hist, round(sum(coalesce(e3.p, g3 * coalesce(e2.p, g2 * u.p))), 9) AS mass FROM tg JOIN en u ON u.k = 1 LEFT JOIN en e2 ON e2.k = 2 AND e2.hist = h2 AND e2.w = u.w LEFT JOIN en e3 ON e3.k = 3 AND e3.hist = h3 AND e3.w = u.w GROUP BY h3"""

QUERIES |= {f.__name__: f for f in (ngram_counts, ngram_entry_counts, continuation_counts, history_stats, count_of_counts, kn_discounts, continuation_diversity, smooth_events, ppl_by_smoother, addk_grid, jm_grid, zero_prob_events, lm_entries, matched_orders, match_bucket_means, pruning_impact, bits_per_char, closed_vocabulary, quantisation, normalisation)}
