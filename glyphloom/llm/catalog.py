"""The queries of this subpackage and the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.functions.text import FULL_WIDTH, HALF_WIDTH, INVISIBLE_RANGES, SPACE_RANGES, SPACES, half_width
from glyphloom.llm import copied_spans, cross_split, grouped_split, leakage, lookalikes, packing, repetition, sentences, subjects
from glyphloom.operators import components
from glyphloom.plans.materialise import cut
from glyphloom.sources.tables import table


#: The row of the threshold table that finds repetition; documents are held against all rows in p2_ratios.
REPEATED = [t for t in repetition.THRESHOLDS if t[0] == "repeated_share"]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records that don't meet the table's threshold of repetition."""
    g = repetition.latest(table(spark, folder, "generations"), "gen_id", "finished_at").select(F.lit("generations").alias("tbl"), F.col("gen_id").alias("rec_id"), "tokens")
    d = table(spark, folder, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("rec_id"), "text")
    held = [repetition.measured(g, text=None, repeated=repetition.token_repetition(F.col("tokens")), thresholds=REPEATED), repetition.measured(d, text="text", repeated=repetition.text_repetition(F.col("text")), thresholds=REPEATED)]
    parts = [x.where(F.array_contains("failed", "repeated_share")).select("tbl", "rec_id") for x in held]
    return parts[0].unionByName(parts[1])


def p2_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """Every ratio of every document, and the thresholds it doesn't meet."""
    d = table(spark, folder, "documents").select("doc_id", "text")
    out = repetition.measured(d, text="text", repeated=repetition.text_repetition(F.col("text"), least=0.0))
    return out.select("doc_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c, _, _ in repetition.THRESHOLDS], F.array_join("failed", " ").alias("failed"))


def _long(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sentences").where(F.size("tokens") >= 10)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = lookalikes.lookalike_pairs(_long(spark, folder), key="sent_id", column="text")
    return pairs.select(F.col("a").alias("sent_a"), F.col("b").alias("sent_b"))


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences that read like differently written ones: their class and how many others it has."""
    return lookalikes.lookalike_classes(_long(spark, folder).select("sent_id", "text"), key="sent_id", column="text")


def p3_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The one consistent form of every sentence."""
    return lookalikes.consistent_form(table(spark, folder, "sentences").select("sent_id", "text"), "text").select("sent_id", "canonical")


def _leaks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    leaks = table(spark, folder, "leakage")
    references = leaks.select("leak_id", "text").unionByName(leaks.select("leak_id", F.col("source.train_sentence").alias("text")))
    return leaks, copied_spans.shared_spans(leaks, references, key="leak_id", text="text", least=30)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder)[1]


def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    leaks, found = _leaks(spark, folder)
    out = copied_spans.shared_share(leaks, found, key="leak_id", text="text")
    return out.withColumn("shared_share", F.round("shared_share", 6))


def _article_groups(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    articles = table(spark, folder, "articles")
    name = F.trim(F.regexp_replace(F.lower(half_width(F.col("author_id"))), f"^{SPACES}+|{SPACES}+$", ""))
    node = F.col("article_id").alias("node")
    authors = articles.select(node, name.alias("k")).where("k NOT IN ('desk', '')").select("node", F.concat(F.lit("author:"), "k").alias("key"))
    origins = articles.where("origin_id IS NOT NULL").select(node, F.concat(F.lit("origin:"), "origin_id").alias("key"))
    text = F.sha2(F.concat_ws("\u0001", F.transform("tokens", lambda t: F.concat(F.lit("="), t))), 256)
    shared = table(spark, folder, "sentences").where(F.size("tokens") >= 10).select(node, F.concat(F.lit("tokens:"), text).alias("key"))
    return components.groups(articles.select(node), authors.unionByName(origins).unionByName(shared))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    members, sizes = _article_groups(spark, folder)
    return members.join(sizes.where("size > 1"), "root").select(F.col("node").alias("article_id"), F.col("root").alias("group_id"))


def p6_splits(spark: SparkSession, folder: str) -> DataFrame:
    """A new assignment of 80/10/10 by articles, stratified by source and language."""
    members, _ = _article_groups(spark, folder)
    labels = table(spark, folder, "articles").where("article_id IS NOT NULL").groupBy("article_id").agg(F.min("source").alias("s"), F.min("lang").alias("l"))
    labels = labels.select(F.col("article_id").alias("node"), F.array_compact(F.array(F.concat(F.lit("source:"), "s"), F.concat(F.lit("lang:"), "l"))).alias("labels"))
    joined = members.join(labels, "node")
    placed = grouped_split.stratified(joined, proportions={"train": 0.8, "dev": 0.1, "test": 0.1})
    return members.join(placed, "root").select(F.col("node").alias("article_id"), F.col("root").alias("group_id"), "split")


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    latest = F.max(F.struct("ingested_at", "split"))["split"].alias("side")
    split = table(spark, folder, "articles").groupBy(F.col("article_id").alias("a")).agg(latest).where("side IN ('train', 'dev', 'test')")
    long = _long(spark, folder).select(F.col("sent_id").alias("id"), "article_id", "source", "tokens").where("id IS NOT NULL")
    sided = long.join(split, F.col("article_id") == F.col("a")).select("id", "side", "source", "tokens")
    rows = cut(cross_split.encoded(sided))
    return sided, rows, cross_split.cross_pairs(rows)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    _, rows, pairs = _sides(spark, folder)
    one = rows.where("side = 'train'").select(F.col("cid").alias("cid_train"), F.col("id").alias("i"))
    two = rows.where("side <> 'train'").select(F.col("cid").alias("cid_eval"), F.col("id").alias("j"))
    return pairs.join(one, "cid_train").join(two, "cid_eval").select(F.least("i", "j").alias("sent_a"), F.greatest("i", "j").alias("sent_b"))


def p7_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Per evaluation split and source: sentences, those with a counterpart in training, pairs, and the tokens of the longest verbatim cover of each; from counts of classes, not from pairs."""
    sided, rows, pairs = _sides(spark, folder)
    train = rows.where("side = 'train'").groupBy(F.col("cid").alias("cid_train")).agg(F.count("*").alias("n"))
    partners = pairs.join(train, "cid_train").groupBy(F.col("cid_eval").alias("cid")).agg(F.sum("n").alias("partners"), F.max("covered").alias("copied"))
    held = rows.where("side <> 'train'").select("id", "side", "cid").join(partners, "cid", "left")
    source = sided.select(F.col("id"), "source")
    out = held.join(source, "id").groupBy(F.col("side").alias("split"), "source")
    return out.agg(F.count("*").alias("sentences"), F.count("partners").alias("overlapping"), F.coalesce(F.sum("partners"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("copied"), F.lit(0)).alias("copied_tokens"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leakage.leaked(table(spark, folder, "documents"), table(spark, folder, "benchmark_items"), key="doc_id", text="text", item_key="item_id", item_text="text")
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p9_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with an item's wording under other numbers, names or units, consistently replaced."""
    found = leakage.reworded(table(spark, folder, "documents"), table(spark, folder, "benchmark_items"), key="doc_id", text="text", item_key="item_id", item_text="text")
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.round("held", 6).alias("held"), "changed")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("rec_id"), "text")
    rows = rows.unionByName(table(spark, folder, "sentences").select(F.lit("sentences").alias("tbl"), F.col("sent_id").alias("rec_id"), "text"))
    seen = sentences.observed(rows, keys=["tbl", "rec_id"], text="text")
    return sentences.sentence_ends(seen, sentences.fitted(seen), keys=["tbl", "rec_id"])


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document, or of every piece of it, for each capacity."""
    specs = [(r["spec_id"], r["capacity_tokens"]) for r in table(spark, folder, "container_specs").orderBy("spec_id").collect()]
    return packing.packed_for_all(table(spark, folder, "documents"), specs, key="doc_id", text="text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    names = sorted(r["subject"] for r in table(spark, folder, "subjects").select("subject").where("subject IS NOT NULL").distinct().collect())
    seen = sentences.observed(documents, keys=["doc_id"], text="text", keep_text=True)
    model = sentences.fitted(seen)
    rows = subjects.training_rows(seen, table(spark, folder, "labels"), names, model, key="doc_id")
    lookup = subjects.vocabulary(rows)
    fitted = subjects.fit(subjects.numbered(rows, lookup, len(names)), len(names), lookup)
    return subjects.scored(seen, fitted, lookup, names, model, key="doc_id").select("doc_id", "subject")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_ratios": p2_ratios, "p3_found": p3_found, "p3_forms": p3_forms, "p3_classes": p3_classes, "p4_found": p4_found, "p4_shares": p4_shares, "p6_found": p6_found, "p6_splits": p6_splits, "p7_found": p7_found, "p7_counts": p7_counts, "p8_containers": p8_containers, "p9_found": p9_found, "p9_variants": p9_variants, "p10_found": p10_found}


def _class(ranges: list[tuple[int, int]]) -> str:
    return "[" + "".join(f"\\x{{{a:04x}}}-\\x{{{b:04x}}}" for a, b in ranges) + "]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_FOLD = lambda c: f"lower(translate({c}, {_quoted(FULL_WIDTH)}, {_quoted(HALF_WIDTH)}))"
_COVERED = lambda grams, n: f"""(SELECT rec_id, sum(least({n}, coalesce(nx - i, {n}))) AS cov FROM (SELECT *, lead(i) OVER (PARTITION BY rec_id ORDER BY i) AS nx FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, g ORDER BY i) AS rn FROM {grams}) WHERE rn > 1)) GROUP BY rec_id)"""
_DENSE = "[\\x{0e01}-\\x{0e7f}\\x{3041}-\\x{30ff}\\x{3400}-\\x{9fff}\\x{ff66}-\\x{ff9f}]"
_LOOK = f"nfc_normalize(trim(regexp_replace(translate(regexp_replace(text, '{_class(INVISIBLE_RANGES)}', '', 'g'), {_quoted(''.join(lookalikes.MAPPED))}, {_quoted(''.join(lookalikes.MAPPED.values()))}), '{_class(SPACE_RANGES)}', ' ', 'g')))"
SQL: dict[str, str] = {
    "p2_found": f"""WITH d AS (SELECT doc_id AS rec_id, regexp_replace({_FOLD('text')}, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS s FROM documents),
dg AS (SELECT rec_id, i, substr(s, i, 20) AS g FROM (SELECT rec_id, s, unnest(range(1, length(s) - 18)) AS i FROM d WHERE length(s) >= 20)),
t AS (SELECT gen_id AS rec_id, list_transform(list_filter(tokens, lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')), lambda x: {_FOLD(f"regexp_replace(x, '{_class(INVISIBLE_RANGES)}', '', 'g')")}) AS s FROM (SELECT *, row_number() OVER (PARTITION BY gen_id ORDER BY finished_at DESC) AS r FROM generations) WHERE r = 1),
tg AS (SELECT rec_id, i, array_to_string(s[i : i + 2], chr(31)) AS g FROM (SELECT rec_id, s, unnest(range(1, len(s) - 1)) AS i FROM t WHERE len(s) >= 3))
SELECT 'documents' AS tbl, rec_id FROM d JOIN {_COVERED('dg', 20)} USING (rec_id) WHERE cov / length(s) >= 0.4
UNION ALL SELECT 'generations', rec_id FROM t JOIN {_COVERED('tg', 3)} USING (rec_id) WHERE cov / len(s) >= 0.4""",
    "p2_ratios": f"""WITH d AS (SELECT doc_id AS rec_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low, regexp_replace({_FOLD("coalesce(text, '')")}, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS s, list_filter(string_split_regex(coalesce(text, ''), '\\r\\n|[\\n\\x0b\\x0c\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: trim(x, ' ') <> '') AS ln FROM documents),
dg AS (SELECT rec_id, i, substr(s, i, 20) AS g FROM (SELECT rec_id, s, unnest(range(1, length(s) - 18)) AS i FROM d WHERE length(s) >= 20)), cv AS {_COVERED('dg', 20)},
r AS (SELECT rec_id, coalesce(cov, 0) / nullif(length(s), 0) AS a, 1 - len(list_distinct(ln)) / nullif(len(ln), 0) AS b, length(regexp_replace(t, '[\\p{{L}}\\p{{N}}\\p{{M}} \\t\\n\\x0b\\f\\r　]', '', 'g')) / nullif(length(t), 0) AS c, len(list_filter(ln, lambda x: length(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g')) < {repetition.SHORT_LINE})) / nullif(len(ln), 0) AS e, length(t)::DOUBLE AS f,
 (len(list_filter(regexp_extract_all(regexp_replace(low, '{_DENSE}', ' ', 'g'), '\\p{{L}}[\\p{{L}}\\p{{M}}]*'), lambda x: true)) + len(regexp_extract_all(low, '{_DENSE}')) / 2) AS u,
 len(list_filter(regexp_extract_all(low, '[\\p{{L}}\\p{{M}}]+'), lambda x: x IN ({', '.join(map(_quoted, repetition.STOP_WORDS))}))) + len(regexp_extract_all(low, '{'|'.join(repetition.DENSE_STOPS)}')) AS w FROM d LEFT JOIN cv USING (rec_id)),
v AS (SELECT rec_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(e, 0) AS e, f, CASE WHEN u > 0 THEN w / u ELSE 0 END AS g FROM r)
SELECT rec_id AS doc_id, round(a, 6) AS repeated_share, round(b, 6) AS duplicate_line_share, round(c, 6) AS symbol_share, round(e, 6) AS short_line_share, f AS length, round(g, 6) AS stop_word_share,
concat_ws(' ', CASE WHEN NOT a < 0.4 THEN 'repeated_share' END, CASE WHEN NOT b < 0.5 THEN 'duplicate_line_share' END, CASE WHEN NOT c < 0.4 THEN 'symbol_share' END, CASE WHEN NOT e < 0.8 THEN 'short_line_share' END, CASE WHEN NOT f >= 20 THEN 'length' END, CASE WHEN NOT g >= 0.01 THEN 'stop_word_share' END) AS failed FROM v""",
    "p3_found": f"WITH f AS (SELECT sent_id, text, {_LOOK} AS form FROM sentences WHERE len(tokens) >= 10) SELECT a.sent_id AS sent_a, b.sent_id AS sent_b FROM f a JOIN f b ON a.form = b.form AND a.text <> b.text AND a.sent_id < b.sent_id",
    "p3_classes": f"WITH f AS (SELECT sent_id, text, {_LOOK} AS form FROM sentences WHERE len(tokens) >= 10), g AS (SELECT *, min(text) OVER (PARTITION BY form) AS canonical, max(text) OVER (PARTITION BY form) AS greatest, count(*) OVER (PARTITION BY form) AS n, count(*) OVER (PARTITION BY form, text) AS same FROM f) SELECT sent_id, canonical, n - same AS others FROM g WHERE canonical <> greatest",
    "p3_forms": f"WITH f AS (SELECT sent_id, text, {_LOOK} AS form FROM sentences) SELECT sent_id, min(text) OVER (PARTITION BY form) AS canonical FROM f",
    "p4_found": """WITH t AS (SELECT leak_id, text AS s FROM leakage UNION ALL SELECT leak_id, source.train_sentence FROM leakage),
w AS (SELECT DISTINCT leak_id, substr(s, i + 1, 30) AS g FROM (SELECT leak_id, s, unnest(range(0, length(s) - 29)) AS i FROM t WHERE length(s) >= 30)),
o AS (SELECT g, min(leak_id) AS lo, max(leak_id) AS hi FROM w GROUP BY g),
h AS (SELECT leak_id, i FROM (SELECT leak_id, text, unnest(range(0, length(text) - 29)) AS i FROM leakage WHERE length(text) >= 30) p JOIN o ON o.g = substr(p.text, p.i + 1, 30) WHERE lo <> leak_id OR hi <> leak_id),
b AS (SELECT *, coalesce(i - lag(i) OVER (PARTITION BY leak_id ORDER BY i) > 30, true)::INT AS fresh FROM h),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY leak_id ORDER BY i) AS part FROM b)
SELECT leak_id, min(i)::INT AS start_pos, (max(i) + 30)::INT AS end_pos FROM n GROUP BY leak_id, part""",
    "p6_found": f"""WITH RECURSIVE k AS (SELECT article_id, 'a' || trim(regexp_replace({_FOLD('author_id')}, '^{_class(SPACE_RANGES)}+|{_class(SPACE_RANGES)}+$', '', 'g')) AS key FROM articles WHERE author_id IS NOT NULL
UNION SELECT article_id, 'o' || origin_id FROM articles WHERE origin_id IS NOT NULL
UNION SELECT article_id, 't' || array_to_string(tokens, chr(31)) FROM sentences WHERE len(tokens) >= 10),
e AS (SELECT DISTINCT a.article_id AS a, b.article_id AS b FROM k a JOIN k b USING (key) WHERE key NOT IN ('adesk', 'a')),
r(a, b) AS (SELECT DISTINCT article_id, article_id FROM articles UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS article_id, min(b) AS group_id FROM r GROUP BY a HAVING count(*) > 1""",
}
SQL["p4_shares"] = f"WITH fo AS ({SQL['p4_found']}), si AS (SELECT leak_id, coalesce(max(length(text)), 0)::INT AS n_chars FROM leakage WHERE leak_id IS NOT NULL GROUP BY leak_id), hi AS (SELECT leak_id, sum(end_pos - start_pos)::BIGINT AS c FROM fo GROUP BY leak_id) SELECT si.leak_id, n_chars, coalesce(c, 0) AS shared_chars, round(CASE WHEN n_chars > 0 THEN coalesce(c, 0) / n_chars ELSE 0 END, 6) AS shared_share FROM si LEFT JOIN hi USING (leak_id)"
