"""Every operator against a brute-force version, with NULLs, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import random
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphloom.llm import copied_spans, cross_split, grouped_split, leakage, lookalikes, packing, repetition, sentences, subjects


def share(seq, width):
    seen, covered = set(), set()
    for i in range(len(seq) - width + 1):
        g = tuple(seq[i : i + width])
        if g in seen:
            covered |= set(range(i, i + width))
        seen.add(g)
    return len(covered) / len(seq) if seq else 0


def test_repetition_equals_brute_force(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefg ，") for _ in range(n)) + "句子重复了很多很多遍的一段话，共有二十多个字。" * k for n, k in [(0, 0), (5, 1), (40, 2), (10, 5), (300, 3), (95, 9), (116, 2), (1000, 40)]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(99, None, "x"), (98, "ＡＢＣ" * 30, "x"), (97, "一" * 50_000, "x")], "id int, text string, g string")
    got = dict(map(tuple, df.select("id", repetition.text_repetition(F.col("text"), least=0.0)).collect()))
    for i, t in enumerate(texts):
        s = [c for c in unicodedata.normalize("NFKC", t).lower() if c.isalnum()]
        assert got[i] == pytest.approx(share(s, 20)), i
    assert got[99] == 0 and got[98] > 0.9 and got[97] > 0.99
    lists = [[], ["a"], ["a", "b", "，", "c", "A", "B", "C"], ["x"] * 10, [str(rng.randrange(4)) for _ in range(60)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lists)] + [(9, None)], "id int, tokens array<string>")
    got = dict(map(tuple, df.select("id", repetition.token_repetition(F.col("tokens"), least=0.0)).collect()))
    for i, t in enumerate(lists):
        assert got[i] == pytest.approx(share([x.lower() for x in t if x.isalnum()], 3)), i
    assert got[9] == 0
    m = repetition.measured(df.select("id", F.lit("a b\na b\nthe 。").alias("text"), F.lit(1).alias("length")), text="text", repeated=F.lit(0.5)).first()
    assert m["length"] == 13 and m["duplicate_line_share"] == pytest.approx(1 / 3) and "repeated_share" in m["failed"]


def test_lookalikes(spark):
    rows = [(1, "Ｃafé　one"), (2, "Café one"), (3, "Cаfé​ one"), (4, "Cafe one"), (5, "café one"), (6, None), (7, ""), (8, "Café one"), (9, "⻋⼈ﾊﾞ"), (10, "车人バ"), (None, "x")]
    df = spark.createDataFrame(rows, "id bigint, text string").withColumn("look", F.lit(1))
    got = {tuple(r) for r in lookalikes.lookalike_pairs(df, key="id", column="text").collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (1, 8), (3, 8), (9, 10)}
    forms = {r["id"]: r["canonical"] for r in lookalikes.consistent_form(df, "text").collect()}
    assert forms[1] == forms[2] == forms[3] != forms[4] and forms[6] is None and forms[7] == ""
    assert lookalikes.lookalike_pairs(df.limit(0), key="id", column="text").count() == 0


@pytest.mark.parametrize("hot", [64, 0])
def test_shared_spans_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(copied_spans, "HOT_CONTEXTS", hot)
    rng = random.Random(2)
    base = "".join(rng.choice("abcd") for _ in range(400))
    texts = [(i, base[a : a + n] + "".join(rng.choice("wxyz") for _ in range(5)) + base[b : b + n]) for i, (a, b, n) in enumerate([(0, 100, 30), (90, 10, 45), (110, 300, 33), (0, 100, 29), (200, 260, 60), (0, 100, 30)])]
    texts += [(50, None), (51, ""), (52, "short"), (53, "q" * 80), (53, "q" * 80), (None, base)]
    df = spark.createDataFrame(texts, "id bigint, text string")
    owner = {}
    for i, t in texts:
        if i is not None:
            for k in range(len(t or "") - 29):
                owner.setdefault(t[k : k + 30], set()).add(i)
    expected = set()
    for i, t in texts:
        spans = []
        for k in range(len(t or "") - 29):
            if i is not None and owner[t[k : k + 30]] - {i}:
                if spans and spans[-1][1] >= k:
                    spans[-1][1] = k + 30
                else:
                    spans.append([k, k + 30])
        expected |= {(i, a, b) for a, b in spans}
    got = copied_spans.shared_spans(df, df, key="id", text="text", least=30)
    assert {tuple(r) for r in got.collect()} == expected and expected
    parts = {r["id"]: r for r in copied_spans.shared_share(df, got, key="id", text="text").collect()}
    assert parts[50]["shared_share"] == 0 and parts[51]["n_chars"] == 0
    assert copied_spans.shared_spans(df.limit(0), df.limit(0), key="id", text="text").count() == 0


def test_stratified_split_keeps_groups(spark):
    rng = random.Random(3)
    rows = [(f"n{i}", f"n{i}" if i % 4 else f"n{i // 40 * 40}", [f"s:{rng.choice('aaabbc')}"]) for i in range(4000)]
    rows += [(f"h{i}", "h0", ["s:z"]) for i in range(60)]
    df = spark.createDataFrame(rows, "node string, root string, labels array<string>")
    placed = dict(map(tuple, grouped_split.stratified(df, proportions={"train": 0.8, "dev": 0.1, "test": 0.1}).collect()))
    assert set(placed) == {r[1] for r in rows}
    n = {s: sum(placed[r[1]] == s for r in rows) / len(rows) for s in ("train", "dev", "test")}
    assert n["train"] == pytest.approx(0.8, abs=0.03) and n["dev"] == pytest.approx(0.1, abs=0.02)
    with pytest.raises(ValueError):
        grouped_split.stratified(df, proportions={"a": 0.5})
    assert grouped_split.stratified(df.limit(0), proportions={"a": 1.0}).count() == 0
    # Whatever the buckets, each split is within the largest component of its share.
    for bucket in (50, 10**6):
        got = dict(map(tuple, grouped_split.stratified(df, proportions={"train": 0.8, "dev": 0.1, "test": 0.1}, bucket=bucket).collect()))
        assert len(got) == len(placed)
        for s, share in (("train", 0.8), ("dev", 0.1), ("test", 0.1)):
            assert abs(sum(got[r[1]] == s for r in rows) - share * len(rows)) <= 70, (bucket, s)
    assert grouped_split.stratified(df.limit(5).withColumn("labels", F.lit(None).cast("array<string>")), proportions={"a": 1.0}).count() > 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_cross_split_equals_brute_force(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(30)}" for _ in range(rng.randrange(10, 32))] for _ in range(12)]
    rows = []
    for i in range(150):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            p = rng.randrange(len(t))
            what = rng.randrange(3)
            if what == 0:
                t[p] = "new"
            elif what == 1:
                del t[p]
            else:
                t.insert(p, "more")
        rows.append((i, rng.choice(["train", "dev", "test"]), t))
    rows += [(900, "train", None), (901, "dev", []), (902, "train", ["ｗ１"] * 12), (903, "test", ["w1"] * 12)]
    df = spark.createDataFrame(rows, "id bigint, side string, tokens array<string>")
    e = cross_split.encoded(df).cache()
    cid = {r["id"]: bytes(r["cid"]) for r in e.collect()}
    pairs = {(bytes(r[0]), bytes(r[1])) for r in cross_split.cross_pairs(e).collect()}
    plain = {i: [cross_split.plain_token(x) for x in t or []] for i, _, t in rows}
    for i, s, _ in rows:
        for j, z, _ in rows:
            if s == "train" and z != "train" and plain[i] and plain[j]:
                near = edits(plain[i], plain[j]) <= max(len(plain[i]), len(plain[j])) // 10
                assert ((cid[i], cid[j]) in pairs) == near, (plain[i], plain[j])
    assert cid[902] == cid[903]
    assert cross_split.cross_pairs(e.limit(0)).count() == 0


def test_index_finds_all_places():
    rng = np.random.default_rng(5)
    lists = [rng.integers(1, 5, rng.integers(1, 30)) for _ in range(40)]
    index = cross_split.Index(lists)
    for _ in range(60):
        want = rng.integers(1, 6, rng.integers(1, 5))
        s = index.symbols(want)
        low, high = index.search(s, np.array([0]), np.array([len(s)]))
        got = sorted(index.locate(np.arange(low[0], high[0])).tolist()) if high[0] > low[0] else []
        expected = sorted(int(index.starts[k]) + i for k, x in enumerate(lists) for i in range(len(x) - len(want) + 1) if (x[i : i + len(want)] == want).all())
        assert got == expected
    again = cross_split.Index.unpacked(index.packed())
    assert (again.text == index.text).all() and (again.place == index.place).all()
    assert [index.text[a : a + n].tolist() for a, n in zip(index.starts, index.sizes)] == [(np.searchsorted(index.alphabet, x) + 1).tolist() for x in lists]
    assert len(index.packed()) < 2 * sum(map(len, lists)) + 400


def test_maximal_matches_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(cross_split, "PLACES", 7)
    lists = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(6)]
    wanted = [rng.integers(1, 5, 15) for _ in range(8)] + [np.concatenate([lists[0], lists[1]]), lists[2], lists[2][:2]]
    index = cross_split.Index(lists)
    flat = index.symbols(np.concatenate(wanted))
    n = np.array([len(w) for w in wanted])
    start = np.cumsum(n) - n
    got = [(int(o), int(b - start[o]), int(e - start[o]), int(p)) for part in index.maximal_matches(flat, start, n, np.full(len(n), 3)) for o, b, e, p in zip(*part)]
    expected = []
    for w, own in enumerate(wanted):
        for x, other in enumerate(lists):
            for i in range(len(own)):
                for j in range(len(other)):
                    if own[i] == other[j] and (i == 0 or j == 0 or own[i - 1] != other[j - 1]):
                        k = 0
                        while i + k < len(own) and j + k < len(other) and own[i + k] == other[j + k]:
                            k += 1
                        if k >= 3:
                            expected.append((w, i, i + k, int(index.starts[x]) + j))
    assert sorted(got) == sorted(expected)
    pairs, covered = cross_split.merged(np.array([5, 1, 5, 5, 1]), np.array([0, 3, 2, 9, 3]), np.array([4, 6, 6, 12, 5]))
    assert pairs.tolist() == [1, 5] and covered.tolist() == [3, 9]


def test_leaked_passages(spark):
    item = "The clear orbit near Hafegimont surprised Pifeba and the large climate record near Sazagaburg was measured in 1998 by nine very patient observers."
    other = "荻湾轩陌等４０１４人接种康复，星垣瑄铮在栖利岭注射计划的疫苗。鹂艾湾编辑部再次缝合复杂的体温，冰壶硕荷指出抗体的成绩认真明显。"
    filler = "Nothing of this kind stands here, only other words about gardens and boats. "
    docs = [
        (1, filler + item + filler), (2, filler + item.upper().replace(" ", "\n") + filler), (3, filler + item[: len(item) // 3] + filler), (4, filler), (5, None), (6, ""),
        (7, item.replace("large", "small")), (8, other.replace("，", "").replace("康复", "康​复") * 1), (9, "甲乙丙" + other[: len(other) // 2 + 6]), (10, other[:15]), (11, filler * 500 + other), (1, filler + item + filler),
        (12, "The clear orbit near Gozoreville surprised Zomide and the large climate record near Tanoburg was measured in 2001 by nine very patient observers."),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(0))
    i = spark.createDataFrame([(70, item), (71, item), (72, other), (73, None), (74, "")], "item_id bigint, text string")
    got = {(r["doc"], r["item"]) for r in leakage.leaked(d, i, key="doc_id", text="text", item_key="item_id", item_text="text").collect()}
    assert got >= {(k, n) for k in (1, 2, 7) for n in (70, 71)} | {(8, 72), (9, 72), (11, 72)}
    assert not {k for k, _ in got} & {3, 4, 5, 6, 10, 12}
    assert leakage.leaked(d.limit(0), i, key="doc_id", text="text", item_key="item_id", item_text="text").count() == 0
    assert leakage.leaked(d, i.limit(0), key="doc_id", text="text", item_key="item_id", item_text="text").count() == 0


def test_short_items_are_found(spark):
    """Items without a window of the usual width have shorter ones."""
    items = [(1, "What is 2 plus 2?"), (2, "Who is Bob?"), (3, "今天天气好吗"), (4, "An item of ordinary length that nobody would ever call a short one, with quite a few words in it.")]
    filler = "Nothing of this kind stands here, only other words about gardens and boats. 这里没有别的话。"
    docs = [(i, filler + t + " " + filler) for i, t in items] + [(10, filler), (11, "WHAT IS 2\nPLUS 2"), (12, "今天 天气，好吗"), (13, "2"), (14, "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r["doc"], r["item"]) for r in leakage.leaked(d, spark.createDataFrame(items, "item_id bigint, text string"), key="doc_id", text="text", item_key="item_id", item_text="text").collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (11, 1), (12, 3)}


def test_reworded_questions(spark):
    item = "If Tolani sold 40 tonnes in Gedatown and Mirevo bought 15 tonnes, how many tonnes did Tolani keep in Gedatown?"
    good = "If Zekiru sold 70 tonnes in Pavohill and Lunite bought 22 tonnes, how many tonnes did Zekiru keep in Pavohill?"
    bad = "If Zekiru sold 70 tonnes in Pavohill and Lunite bought 22 tonnes, how many tonnes did Haruno keep in Sevahill?"
    unit = item.replace("40 tonnes", "40 kg").replace("15 tonnes", "15 kg")
    d = spark.createDataFrame([(1, item), (2, "So. " + good + " Yes."), (3, bad), (4, unit), (5, None), (6, ""), (7, "short")], "doc_id bigint, text string").withColumn("item", F.lit(0))
    i = spark.createDataFrame([(70, item), (71, None), (72, "")], "item_id bigint, text string")
    run = lambda d, i: {(r["doc"], r["item"]): r for r in leakage.reworded(d, i, key="doc_id", text="text", item_key="item_id", item_text="text").collect()}
    got = run(d, i)
    assert set(got) == {(2, 70), (4, 70)} or set(got) == {(2, 70)}
    assert got[2, 70]["held"] == 1 and got[2, 70]["changed"] == 7
    assert not run(d.limit(0), i) and not run(d, i.limit(0))
    assert leakage.consistent([("a", "b"), ("a", "b"), ("c", "d")]) and not leakage.consistent([("a", "b"), ("a", "c")]) and not leakage.consistent([("a", "b"), ("c", "b")])


def test_packing(spark):
    rng = random.Random(6)
    sizes = [(i, rng.choice([0, 1, 7, 50, 99, 100, 101, 250, rng.randrange(1, 100)])) for i in range(500)] + [(600, None), (601, -3), (7, 40), (None, 20)]
    df = spark.createDataFrame(sizes, "id bigint, n int").withColumn("container", F.lit("x"))
    out = packing.packed(df, key="id", size="n", capacity=100).collect()
    load, placed = {}, {}
    for r in out:
        load[r["container"]] = load.get(r["container"], 0) + r["size"]
        placed.setdefault(r["id"], []).append((r["piece"], r["size"]))
    total = sum(max(n or 0, 0) for _, n in sizes)
    assert max(load.values()) <= 100 and sum(load.values()) == total and len(load) <= -(-total // 100) * 1.03 + 1
    assert set(placed) == {i for i, _ in sizes} and sum(s for _, s in placed[3]) == dict(sizes)[3] and len(placed[7]) >= 2
    assert packing.packed(df.limit(0), key="id", size="n", capacity=5).count() == 0
    with pytest.raises(ValueError):
        packing.packed(df, key="id", size="n", capacity=0)


def test_best_two_fit_swaps_the_shortest():
    bins = packing.best_two_fit({60: 1, 30: 1, 25: 1, 14: 1}, 100)
    assert (sorted(bins[0][0]), bins[0][1]) == ([14, 25, 60], 1)
    for counts in ({3: 10, 2: 7}, {1: 1}, {}):
        assert sum(times * own.count(s) for own, times in packing.best_two_fit(counts, 5) for s in counts) == sum(counts.values())


def test_sentences(spark):
    rng = random.Random(9)
    name = lambda: "".join(rng.choice(["ba", "ke", "lo", "mi", "tu", "sa"]) for _ in range(3)).capitalize()
    made = [lambda: f"Mr. {name()} met Dr. {name()} in {name()}.", lambda: f"They talked for {rng.randrange(1, 9)}.5 hours.", lambda: f"Was {name()} late?", lambda: f"Nobody knew {name()}!", lambda: f"The train to {name()} left at noon."]
    zh = ["甲县开会了。", "乙镇讨论了问题！", "他说：“好的。”", "大家同意。"]
    texts = [" ".join(rng.choice(made)() for _ in range(rng.randrange(1, 5))) for _ in range(300)] + ["".join(rng.choice(zh) for _ in range(rng.randrange(1, 5))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").withColumn("end_pos", F.lit(None).cast("int"))
    model = sentences.fitted(sentences.observed(df, keys=["id"], text="text"))
    text = "Mr. Samike met Dr. Lobatu in Kelomi. They talked for 3.5 hours. Was Tusaba late? Nobody knew Milosa!"
    assert [text[:e] for e in sentences.ends_of(model, text)] == [text[:36], text[:63], text[:80], text]
    zh = "甲县开会了。乙镇讨论了问题！他说：“好的。”大家同意。"
    assert sentences.ends_of(model, zh) == [6, 14, 22, 27]
    assert sentences.ends_of(model, None) == sentences.ends_of(model, " \n\n ") == []
    assert sentences.ends_of(model, "Title\n\nNo mark here\nnor here  ") == [5, 19, 28]
    wrapped = "The train to Tusaba left at noon and then\nnobody in the whole town knew where it had\ngone or when it would return to Kelomi. They\ntalked for 3.5 hours."
    assert len(sentences.ends_of(model, wrapped)) == 2
    edge = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x. " * 20_000, "a"), (3, "x", "a")], "id bigint, text string, tbl string")
    got = sentences.sentence_ends(sentences.observed(edge, keys=["tbl", "id"], text="text"), model, keys=["tbl", "id"]).collect()
    assert {r["id"] for r in got} == {3} and max(r["end_pos"] for r in got) == 59_999
    none = sentences.observed(edge.limit(0), keys=["id"], text="text")
    assert sentences.sentence_ends(none, sentences.fitted(none), keys=["id"]).count() == 0


def test_sentences_without_any_punctuation(spark):
    """Runs of text without marks are cut by the words that begin and end sentences elsewhere."""
    rng = random.Random(12)
    en = ["Today the mayor opened a bridge", "Nobody wanted to leave the harbour", "Later some children sang near the station", "Trains were late again this week"]
    zh = ["今天市长剪彩了大桥", "昨夜渔民修理着旧船", "老师们称赞学生努力"]
    th = ["วันนี้นายกเปิดสะพาน", "เมื่อคืนชาวประมงซ่อมเรือ", "ครูชมนักเรียนขยัน"]
    texts = [" ".join(rng.choice(en) + "." for _ in range(4)) for _ in range(150)] + ["".join(rng.choice(zh) + "。" for _ in range(4)) for _ in range(150)] + [rng.choice(th) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    model = sentences.fitted(sentences.observed(df, keys=["id"], text="text"))
    for own, sep in ((en, " "), (zh, ""), (th, " ")):
        parts = [rng.choice(own) for _ in range(24)]
        text = sep.join(parts)
        want = np.cumsum([len(x) + len(sep) for x in parts]) - len(sep)
        got = set(sentences.ends_of(model, text))
        assert len(got & set(want.tolist())) >= 22 and len(got) <= 26, (text, got)
    assert sentences.ends_of(model, en[0] + " and nothing else") == [len(en[0]) + 17]


def test_rare_end_marks_do_not_set_the_rate_of_line_ends():
    """Bracketed sentences, rare and mostly at line ends, pass the least number of events in large tables only."""
    for times in (1, 55):
        left = pd.DataFrame([(".lport", ".la5", 70.0, 140.0), (".lto", ".la3", 0.0, 60.0), (".lport)", ".la5)", 10.0, 3.0)], columns=["l", "ls", "ends", "inside"])
        left = pd.concat([left, pd.DataFrame([("!l!", "!l", 400.0, 700.0)], columns=left.columns)], ignore_index=True)
        left[["ends", "inside"]] *= times
        got = sentences._boundaries(left.assign(open=left.inside))
        assert got["!l!"] > 0.9 and got[".lport"] > 0.9 and got[".lto"] < 0.1, (times, got)


def test_copies_of_rows_do_not_make_rare_words_well_known(spark):
    rng = random.Random(21)
    name = lambda n: "".join(rng.choice(["ba", "ke", "lo", "mi", "tu", "sa", "ri", "no"]) for _ in range(n)).capitalize()
    texts = [" ".join(f"{name(3)} met Mr. {name(3)} in {name(4)}." for _ in range(4)) for _ in range(150)]
    once = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    often = once.crossJoin(spark.range(40).select(F.col("id").alias("copy"))).select((F.col("copy") * 1000 + F.col("id")).alias("id"), "text")
    one, many = (sentences.fitted(sentences.observed(df, keys=["id"], text="text")) for df in (once, often))
    assert one.boundary == pytest.approx(many.boundary) and one.odds == pytest.approx(many.odds) and one.last == pytest.approx(many.last)
    assert [sentences.ends_of(many, t) for t in texts] == [sentences.ends_of(one, t) for t in texts]


def test_every_gap_between_words_is_looked_at(spark):
    """Short stretches without marks are cut as well if they are longer than stretches with marks are; between marks only where such text is common."""
    rng = random.Random(12)
    en = ["Today the mayor opened a bridge", "Nobody wanted to leave the harbour", "Later some children sang near the station", "Trains were late again this week"]
    zh = ["今天市长剪彩了大桥", "昨夜渔民修理着旧船", "老师们称赞学生努力"]
    texts = [" ".join(rng.choice(en) + "." for _ in range(4)) for _ in range(200)] + ["".join(rng.choice(zh) + "。" for _ in range(4)) for _ in range(200)]
    fit = lambda own: sentences.fitted(sentences.observed(spark.createDataFrame(list(enumerate(own)), "id bigint, text string"), keys=["id"], text="text"))
    model = fit(texts)
    assert sentences.ends_of(model, " ".join(en[:3])) == [31, 66, 108]
    mixed = f"{en[3]}. {en[0]} {en[1]} {en[2]}. {en[3]}."
    assert sentences.ends_of(model, mixed) == [33, 143, 177]
    assert sentences.ends_of(fit(texts + [" ".join(rng.choice(en) for _ in range(12)) for _ in range(40)]), mixed) == [33, 65, 100, 143, 177]
    assert sentences.ends_of(model, "".join(zh)) == [9, 18, 27]
    quoted = f"{en[0]}: “{en[1]} {en[2]} {en[3]}.”"
    assert sentences.ends_of(model, quoted) == [len(quoted)]
    seen = sentences.observed(spark.createDataFrame([(1, " ".join(en[:3])), (2, None), (3, en[0]), (4, texts[0]), (5, "".join(zh))], "id bigint, text string"), keys=["id"], text="text")
    got = sorted((r["id"], r["end_pos"]) for r in sentences.sentence_ends(seen, model, keys=["id"]).collect() if r["id"] != 4)
    assert got == [(1, 31), (1, 66), (1, 108), (3, 31), (5, 9), (5, 18), (5, 27)]
    for e in [*en, *zh]:
        assert sentences.ends_of(model, e) == [len(e)]


def test_events_of_a_batch_are_counted_together():
    """By the weight of each text, as if each event was counted by itself; events follow one another in a line only."""
    texts, weights = ["Mr. Bo met Al. They sat. Was it 3.5? Yes!\nNo. “Go. Now!” he said. Al. Bo.", "", "甲县开会了。乙镇讨论了！\n丙村。 丁。", "One. Two.\r\nAl. Bo."], [1, 1, 1 / 3, 0.5]
    counts, stops, events, sizes, n, steps = sentences._Counts(), [], [], [0], Counter(), Counter()
    for t, w in zip(texts, weights, strict=True):
        own = counts.add(t, w)
        before = 1.0
        for e in own[1]:
            n[e] += w
            if e:
                l, ls, r, rs, d = e.split("\x1f")
                steps[before, int(d), sentences.local_guess(l, ls, rs)] += w
            before = sentences.local_guess(l, ls, rs) if e else 1.0
        stops, events = stops + own[0], events + own[1]
        sizes.append(len(stops))
    counts.add_events(weights, sizes[:-1], pa.array(events, pa.string()))
    assert dict(counts.events) == pytest.approx(dict(n)) and dict(counts.steps) == pytest.approx(dict(steps)) and len(steps) > 3
    counts.add_words(texts, weights, sizes[:-1], stops, events)
    assert counts.words["al"] == 2.5 and counts.words[ord("甲") << 16 | ord("县")] == pytest.approx(1 / 3)
    assert counts.before["了"] == 0 and counts.before["会了"] == pytest.approx(1 / 3) and counts.after["乙镇"] == pytest.approx(1 / 3)
    assert {r[:2] for r in counts.rows()} >= {("T", "甲县"), ("F", "会了"), ("S", "乙镇")}


def test_posteriors_sum_over_all_paths():
    rng = random.Random(7)
    m = sentences.Model({"l0": 0.3, "l1": 0.8}, {"r0": 2.0, "r1": 0.5}, {(e, d): (rng.uniform(0.5, 2), rng.uniform(0.5, 2)) for e in (0, 1) for d in (0, 1, 2)})
    c = [(i, f"l{i % 2}", "x", f"r{i // 2 % 2}", "zz", i % 3) for i in range(6)]
    lines = [[sentences._event(x) for x in c] + [""], [""], [sentences._event(c[3]), ""]]
    got = sentences.posteriors(m, pa.array([lines[0] + lines[1], lines[2]], pa.list_(pa.string())))
    assert got[6] == got[7] == got[9] == 1
    got = got[:6]
    weights = np.zeros((6, 2))
    for path in range(64):
        w, before = 1.0, 1
        for i, (_, l, ls, r, rs, d) in enumerate(c):
            e = path >> i & 1
            w *= m.scores(l, ls, r, rs)[1 - e] * m.follow[before, d][1 - e]
            before = e
        for i in range(6):
            weights[i, path >> i & 1] += w
    assert got == pytest.approx((weights[:, 1] / weights.sum(axis=1)).tolist())


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(8)
    words = {"law": ["法院", "律师", "判决"], "sport": ["比赛", "球队", "冠军"]}
    rows, labels = [], []
    for i in range(240):
        own = rng.sample(["law", "sport", "none"], 1)[0]
        body = "".join("".join(rng.choice(["天气", "街道", "会议"]) for _ in range(4)) + (rng.choice(words[own]) if own != "none" else "") + "。" for _ in range(5))
        rows.append((i, body))
        if i % 2:
            labels.append((i, own, "a"))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id bigint, text string").withColumn("subject", F.lit(1))
    lab = spark.createDataFrame(labels + labels[:3] + [(None, "law", "a"), (1000, "law", "a"), (1, None, "a")], "doc_id bigint, subject string, annotator string")
    names = ["law", "sport"]
    seen = sentences.observed(docs, keys=["doc_id"], text="text", keep_text=True)
    model = sentences.fitted(seen)
    t = subjects.training_rows(seen, lab, names, model, key="doc_id")
    lookup = subjects.vocabulary(t)
    p = subjects.fit(subjects.numbered(t, lookup, 2), 2, lookup)
    got = {}
    for r in subjects.scored(seen, p, lookup, names, model, key="doc_id").collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    right = sum(got.get(i, set()) == {n for n in names if any(w in t for w in words[n])} for i, t in rows if i % 2 == 0)
    assert right >= 114 and 900 not in got and 901 not in got


def test_subjects_take_all_steps(monkeypatch):
    """30 steps on all sentences and 15 narrowed ones, at the rate that was found for them."""
    steps = []

    class Rows:
        sparkSession = sparkContext = property(lambda self: self)
        broadcast = lambda self, value: self
        destroy = lambda self: None

        def mapInArrow(self, run, schema):
            steps.append(run.__defaults__[1])
            return self

        def collect(self):
            return [{"n": 1, "gradient": np.ones(2 * subjects.WIDTH + subjects.WIDTH + 1, dtype=np.float32).tobytes()}]

    subjects.fit(Rows(), 1, np.array([0, 1], dtype=np.int32))
    assert steps == [False] * 30 + [True] * 15 and subjects.RATE == 0.1
