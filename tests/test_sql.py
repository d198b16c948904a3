"""Queries against the SQL that says the same, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from glyphloom.catalog import corpus, lm, study, text, versions

NAMES = ["p5_found", "p5_counts", "tagged_parse", "sentence_segments", "clean_stats", "vocab_coverage", "nested_sample", "article_components", "ngram_counts", "continuation_counts", "smooth_events", "kn_order_3", "kn_pruned_3", "wb_3", "sb_scores", "cache_decay", "longest_copied_span", "repetition_stats", "rank_metrics", "bootstrap_ci", "pair_discrimination", "source_sentence", "greedy_decode", "temperature_entropy", "article_split_greedy", "format_profile_full", "rendering_words", "span_cover", "oov_spelling", "core_perplexity", "kn_order_6", "pruned_effect"]


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, tiny, name):
    con = duckdb.connect()
    for p in Path(tiny).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    q = {**versions.QUERIES, **corpus.QUERIES, **lm.QUERIES, **text.QUERIES, **study.QUERIES}[name](spark, tiny)
    columns = sorted(q.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in q.collect())
    c = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in c.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in c.fetchall())


def test_entry(spark, tiny):
    assert set(entry.oracle_sql()) <= set(entry.queries())
