import pytest
from pyspark.sql import functions as F

from glyphloom.operators import annotated, components
from glyphloom.sources import text
from glyphloom.streaming import counts

LINES = [
    "20240102-03-004-001/m  [国家/n  图书馆/n]nt  开放/v  。/w  ”/w  读者/n  来/v  了/y  ？/w  ！/w",
    "20240102-03-004-002/m  标题/n",
    "",
    None,
    "20240103-01-001-001/m  明智之举/l/%  /m  次/q/m  ２０/m  无标",
]


def test_annotated_lines(spark):
    df = spark.createDataFrame([(i, x, "old") for i, x in enumerate(LINES)], "n int, value string, page string").drop("page")
    p = annotated.parsed(df).cache()
    t = {(r["n"], r["pos"]): r for r in p.select("n", F.posexplode("parsed").alias("pos", "t")).select("n", "pos", "t.*").collect()}
    assert (t[0, 0]["word"], t[0, 0]["tag"], t[0, 0]["starts_entity"], t[0, 1]["entity_type"]) == ("国家", "n", True, "nt")
    assert [(t[4, i]["word"], t[4, i]["tag"]) for i in range(4)] == [("明智之举", "l"), ("次", "q"), ("２０", "m"), ("无标", None)]
    s = {(r["n"], r["sent_no"]): r["tokens"] for r in annotated.segmented(p, ["n"]).collect()}
    assert s == {(0, 1): ["国家", "图书馆", "开放", "。", "”"], (0, 2): ["读者", "来", "了", "？", "！"], (1, 1): ["标题"], (4, 1): ["明智之举", "次", "２０", "无标"]}
    r = annotated.profile(df).first()
    assert (r["lines"], r["blank_lines"], r["articles"], r["entity_starts"], r["empty_words"], r["untagged"]) == (5, 2, 2, 1, 1, 1)
    with pytest.raises(Exception, match="no id"):
        annotated.parsed(spark.createDataFrame([("词/n",)], "value string")).select("date").collect()


def test_components_of_chains_and_hot_keys(spark):
    links = [(f"n{i:03}", f"k{j}") for i in range(60) for j in (i, i + 1)] + [("x", "hot"), ("y", "hot"), ("z", None), (None, "hot")]
    nodes = [(n,) for n in {a for a, _ in links if a}] + [("lonely",)]
    members, sizes = components.groups(spark.createDataFrame(nodes, "node string"), spark.createDataFrame(links, "node string, key string"))
    root = dict(map(tuple, members.collect()))
    assert {root[f"n{i:03}"] for i in range(60)} == {"n000"} and root["y"] == "x" and root["z"] == "z" and root["lonely"] == "lonely"
    assert {r["root"]: r["size"] for r in sizes.collect()}["n000"] == 60
    empty, _ = components.groups(spark.createDataFrame([], "node string"), spark.createDataFrame([], "node string, key string"))
    assert empty.count() == 0


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿甲 乙　丙\n\n丁\n".encode())
    (tmp_path / "b.txt").write_bytes("词/n 句/n\n".encode("gb18030"))
    assert [r["tokens"] for r in text.read_sentences(spark, f"{tmp_path}/a.txt").collect()] == [["甲", "乙", "丙"], ["丁"]]
    got = {(r["file"], r["line_no"]): r["value"] for r in text.read_encoded_lines(spark, [f"{tmp_path}/a.txt", f"{tmp_path}/b.txt"]).collect()}
    assert got["b.txt", 1] == "词/n 句/n" and got["a.txt", 1] == "甲 乙　丙"
    s = spark.createDataFrame([(["a", "b"], "train"), (["c"], "test")], "tokens array<string>, split string")
    text.write_sentences(s, f"{tmp_path}/out", by_split=True)
    assert {tuple(r) for r in spark.read.text(f"{tmp_path}/out").collect()} == {("a b", "train"), ("c", "test")}
    assert text.table_fingerprint(s).first() == text.table_fingerprint(s.orderBy("split")).first()
    assert "| tokens |" in text.markdown(s.select(F.size("tokens").alias("tokens")))


def test_streamed_counts_equal_batch(spark, tmp_path):
    s = spark.createDataFrame([(["a", "b"],), (["a"],)], "tokens array<string>")
    s.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(s.schema).parquet(f"{tmp_path}/in")
    q = counts.to_table(counts.running_counts(stream, 2), "streamed", "complete", f"{tmp_path}/cp")
    q.awaitTermination()
    from glyphloom.operators import ngrams as ng

    assert sorted(map(tuple, spark.table("streamed").collect())) == sorted(map(tuple, ng.counts(s, 2).collect()))
