import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.catalog import text
from glyphloom.operators import backoff, decoding, document_cache, evaluation, lm, overlap, sampling, smoothing, splitting, tuning
from glyphloom.operators import ngrams as ng
from glyphloom.sources import arpa

TEXT = ["the cat sat on the mat", "the cat ate the fish", "a dog sat on the log", "the dog ate a fish", "the cat sat on a log", "a cat saw the dog"]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame([(i, t.split()) for i, t in enumerate(TEXT)], "sent_id bigint, tokens array<string>").cache()


class Whole:
    """A model in memory, by its definition: the longest entry, times the weights of the longer histories."""

    def __init__(self, model):
        self.order = model.order
        self.p = {(r["k"], r["hist"], r["w"]): r["p"] for r in model.entries.collect()}
        self.gamma = {(r["k"], r["hist"]): r["gamma"] for r in model.backoff.collect()}
        self.words = sorted(w for k, _, w in self.p if k == 1 and w != "<unk>")
        self.ids = {w: i for i, w in enumerate(self.words)}

    def probability(self, context, w):
        f = 1.0
        for k in range(min(self.order, len(context) + 1), 0, -1):
            h = ng.SEP.join(context[len(context) - k + 1 :])
            if (k, h, w) in self.p:
                return f * self.p[k, h, w]
            f *= self.gamma.get((k, h), 1.0) if k > 1 else 1.0
        return f * self.p[1, "", "<unk>"]

    def distribution(self, context):
        return np.array([self.probability(context, w) for w in self.words])


def test_counts_and_adjusted_counts(spark, train):
    c = {(r["k"], r["hist"], r["w"]): r["c"] for r in ng.counts(train, 3).collect()}
    expected = Counter()
    for t in TEXT:
        s = ["<s>", *t.split(), "</s>"]
        for i in range(1, len(s)):
            for k in range(1, 4):
                if i - k + 1 >= 0:
                    expected[k, ng.SEP.join(s[i - k + 1 : i]), s[i]] += 1
    assert c == dict(expected)
    a = {(r["k"], r["hist"], r["w"]): r["a"] for r in ng.adjusted(ng.counts(train, 3), 3).collect()}
    assert a[1, "", "cat"] == len({h for (k, h, w) in expected if k == 2 and w == "cat"})
    assert a[2, "<s>", "the"] == expected[2, "<s>", "the"]
    assert set(a) == set(c)


def test_discounts(spark):
    a = spark.createDataFrame([(1, x) for x in [1, 1, 1, 1, 2, 2, 3, 4, 9]], "k int, a bigint")
    d = ng.modified_discounts(ng.counts_of_counts(a)).first()
    assert (d["d1"], d["d2"], d["d3"]) == pytest.approx((0.5, 1.25, 1.0))
    bad = spark.createDataFrame([(1, 1)], "k int, a bigint")
    assert tuple(ng.modified_discounts(ng.counts_of_counts(bad), (0.5, 1.0, 1.5)).first())[1:] == (0.5, 1.0, 1.5)
    with pytest.raises(Exception, match="no discounts"):
        ng.modified_discounts(ng.counts_of_counts(bad)).collect()


@pytest.mark.parametrize(("order", "method", "prune"), [(3, "modified", None), (4, "modified", [0, 0, 1]), (3, "original", None), (3, "witten_bell", None)])
def test_probabilities_sum_to_one(spark, train, order, method, prune):
    m = lm.train(train, order, method=method, prune=prune)
    full = [ng.SEP.join(h) for h in (["the", "cat", "sat"], ["on", "the", "mat"], ["<s>", "never", "seen"], ["a", "zebra", "the"])]
    hists = spark.createDataFrame([(ng.SEP.join(h.split(ng.SEP)[-(order - 1) :]),) for h in full], "hist string")
    for r in lm.mass(m, hists).collect():
        assert r["mass"] == pytest.approx(1, abs=1e-9)


def test_general_model_is_the_trigram_formula(spark, train):
    test = spark.createDataFrame([(1, "the cat saw a bird".split()), (2, []), (3, None)], "sent_id bigint, tokens array<string>")
    m = lm.train(train, 3)
    a = {(r["sent_id"], r["pos"]): r["p"] for r in lm.scores(m, test, ["sent_id"]).collect()}
    e = ng.grams(test, 3, ["sent_id"])
    b = {(r["sent_id"], r["pos"]): r["p"] for r in smoothing.event_statistics(train, e, ["sent_id"]).select("sent_id", "pos", smoothing.p_kneser_ney().alias("p")).collect()}
    assert a.keys() == b.keys() and len(a) == 8
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-9)


def test_arpa_round_trip(spark, train, tmp_path):
    m = lm.train(train, 3)
    arpa.write_arpa(m, f"file://{tmp_path}/model")
    again = arpa.read_arpa(spark, f"file://{tmp_path}/model", 3)
    assert again.entries.count() == m.entries.count()
    test = spark.createDataFrame([(1, "a dog saw the mat".split())], "sent_id bigint, tokens array<string>")
    p, q = ({r["pos"]: r["p"] for r in lm.scores(x, test, ["sent_id"]).collect()} for x in (m, again))
    assert all(p[k] == pytest.approx(q[k], rel=1e-6) for k in p)


def test_quantised_model_is_near(spark, train):
    m = lm.train(train, 2)
    q = lm.quantised(m)
    x = m.entries.join(q.entries.withColumnRenamed("p", "q"), ["k", "hist", "w"])
    assert x.count() == m.entries.count()


def test_backoff_profiles_equal_brute_force(spark, train):
    words = sorted({w for t in TEXT for w in t.split()} | {"</s>"})
    b = backoff.train(train, 3)
    p = backoff.profiles(b, spark.createDataFrame([(1, "the cat sat near the dog".split())], "sent_id bigint, tokens array<string>"), ["sent_id"])
    got = {r["pos"]: (r["s"], r["n"]) for r in p.select("pos", backoff.score(0.4).alias("s"), backoff.normalised(0.4).alias("n")).collect()}
    c, total = Counter(), Counter()
    for t in TEXT:
        s = ["<s>", *t.split(), "</s>"]
        for i in range(1, len(s)):
            for k in range(1, 4):
                if i - k + 1 >= 0:
                    c[k, tuple(s[i - k + 1 : i]), s[i]] += 1
                    total[k, tuple(s[i - k + 1 : i])] += 1

    def score(context, w):
        f = 1.0
        for k in range(min(3, len(context) + 1), 0, -1):
            h = tuple(context[len(context) - k + 1 :])
            if c[k, h, w]:
                return f * c[k, h, w] / total[k, h]
            f *= 0.4
        return 0.0

    s = ["<s>", *"the cat sat near the dog".split(), "</s>"]
    for i in range(1, len(s)):
        own = score(s[:i], s[i])
        assert got[i - 1][0] == pytest.approx(own)
        assert got[i - 1][1] == pytest.approx(own / sum(score(s[:i], w) for w in words))


@pytest.mark.parametrize("decay", [None, 0.5, 0.98])
def test_cache_equals_direct_weights(spark, decay):
    rng = random.Random(3)
    events = [("a" if i < 40 else "b", i, rng.choice("xyz"), rng.random() < 0.2) for i in range(60)]
    df = spark.createDataFrame(events, "article string, pos int, w string, oov boolean")
    for r in document_cache.cached(df, "article", ["pos"], decay).collect():
        past = [(r["pos"] - p, w) for a, p, w, o in events if a == r["article"] and p < r["pos"] and not o]
        weight = {True: 0.0, False: 0.0}
        for d, w in past:
            weight[w == r["w"]] += 1.0 if decay is None else decay**d
        total = sum(weight.values())
        assert r["has"] == (total > 0)
        assert r["pc"] == pytest.approx(0.0 if r["oov"] or not total else weight[True] / total)


def test_ranks_with_ties(spark, train):
    m = evaluation.rank_metrics(F.lit(1), F.lit(2), F.lit(True))
    r = spark.range(1).select(*[c.alias(n) for n, c in m.items()]).first()
    assert (r["hit_1"], r["hit_5"], r["rank"]) == (0, 1, 3) and r["rr"] == pytest.approx((1 / 2 + 1 / 3 + 1 / 4) / 3)
    model = lm.train(train, 3)
    test = spark.createDataFrame([(1, "the cat sat on the log".split())], "sent_id bigint, tokens array<string>")
    state = Whole(model)
    got = {r["pos"]: (r["greater"], r["equal"]) for r in evaluation.ranks(model, test, "sent_id").collect()}
    s = ["<s>", *"the cat sat on the log".split(), "</s>"]
    for i in range(1, len(s)):
        p = state.distribution(s[:i])
        t = p[state.ids[s[i]]]
        assert got[i - 1][0] == pytest.approx(int((p > t * (1 + 1e-12)).sum()))


def test_power_law_and_bootstrap(spark):
    d = spark.createDataFrame([(float(x), 3 * x**0.5) for x in (10, 100, 1000)], "x double, y double")
    r = evaluation.power_law(d, "x", "y").first()
    assert (r["factor"], r["exponent"]) == pytest.approx((3, 0.5))
    g = spark.createDataFrame([(str(i), 2.0, 1.0, 4) for i in range(50)], "g string, a double, b double, n bigint")
    b = evaluation.bootstrap(g, "g", "a", "b", "n", repetitions=50).first()
    assert b["change"] == pytest.approx(10**-0.25 - 1) and b["low"] == pytest.approx(b["high"])


def test_decoding_policies(spark, train):
    m = lm.train(train, 3)
    whole = Whole(m)
    known = decoding.training_runs(train)
    assert decoding.copied_tails(known, [["x", "on", "the", "mat"], ["mat", "mat"], [], ["the"]]) == [3, 0, 0, 0]
    settings = [("greedy", 1.0, 0, 1.0), ("beam", 1.0, 0, 0.0), ("beam", 3.0, 0, 0.0), ("fixed", 0.8, 5, 0.9), ("anticopy", 3.0, 0, 1.0), ("entropy", 1.0, 0, 1.0)]
    runs = spark.createDataFrame([(i, ["the"], p, v, k, t, 5) for i, (p, v, k, t) in enumerate(settings)], "steps_of int, prompt array<string>, policy string, value double, top_k int, top_p double, seed int")
    got = {r["steps_of"]: r for r in decoding.generated(runs, m, longest=12, known=known).collect()}
    assert decoding.generated(runs.limit(0), m).count() == 0

    def walk(policy, value, top_k, top_p):
        context, out = ["<s>", "the"], []
        for step in range(12):
            p = whole.distribution(context)
            t = value
            if policy == "anticopy":
                tail = (["the"] + out)[-len(out) - 1 :]
                run = max([n for n in range(2, len(tail) + 1) if any(tail[-n:] == x.split()[i : i + n] for x in TEXT for i in range(len(x.split())))], default=0)
                t = 1.3 if run >= value else 0.7
            if policy == "entropy":
                t = decoding.temperature_for(p / p.sum(), value)
            order, q = (np.argsort(-p, kind="stable")[:1], np.ones(1)) if policy == "greedy" else decoding.reshape(p, t, top_k, top_p)
            w = whole.words[order[min(np.searchsorted(np.cumsum(q), decoding.draw(5, step), side="right"), len(q) - 1)]]
            if w == "</s>":
                return out, True
            out.append(w)
            context.append(w)
        return out, False

    for i in (0, 3, 4, 5):
        assert (got[i]["tokens"], got[i]["hit_eos"]) == walk(*settings[i])
        context = ["<s>", "the"]
        for x in got[i]["steps"]:
            assert x["p"] == pytest.approx(whole.probability(context, x["word"]))
            context.append(x["word"])
    assert got[1]["tokens"] == got[0]["tokens"]
    # A beam over everything that can be said in that many words.
    live, done = [(0.0, [])], []
    for _ in range(12):
        step = sorted(((s + math.log10(p), [*t, w]) for s, t in live for w, p in zip(whole.words, whole.distribution(["<s>", "the", *t]), strict=True)), key=lambda c: -c[0])
        live = []
        for c in step:
            if len(live) < 3:
                (done if c[1][-1] == "</s>" else live).append(c)
    best = max(done + live, key=lambda c: c[0])
    assert math.log10(got[2]["steps"][0]["p"]) == pytest.approx(best[0])


def test_shapes_of_a_distribution():
    p = np.array([0.5, 0.3, 0.15, 0.05])
    assert decoding.reshape(p, top_k=2)[1] == pytest.approx([0.625, 0.375])
    assert len(decoding.reshape(p, top_p=0.75)[0]) == 2 and len(decoding.reshape(p, top_p=0.9)[0]) == 3
    assert decoding.reshape(p, 0.5)[1] == pytest.approx(p * p / (p * p).sum())
    rng = np.random.default_rng(3)
    for n in (2, 7, 300):
        q = rng.dirichlet(np.full(n, 0.3))
        for bits in (0.2, 0.6 * np.log2(n), np.log2(n) + 1, 0.0):
            t = decoding.temperature_for(q, bits)
            h = decoding.entropy(decoding.reshape(q, t)[1])
            assert h == pytest.approx(bits, abs=1e-6) or (t == decoding.HOTTEST and h < bits) or (t == decoding.COLDEST and h > bits)


def test_scores_by_sums_equal_scores_by_longest_match(spark, train):
    test = spark.createDataFrame([(1, "the cat sat on a zebra".split()), (2, []), (3, None), (4, ["zebra"])], "sent_id bigint, tokens array<string>")
    for method, prune in (("modified", None), ("modified", [0, 0, 1]), ("original", None), ("witten_bell", [0, 1, 1])):
        m = lm.train(train, 3, method=method, prune=prune)
        a = {(r["sent_id"], r["pos"]): r for r in lm.scores(m, test, ["sent_id"]).collect()}
        b = {(r["sent_id"], r["pos"]): r for r in lm.scores(lm.Model(3, m.entries, m.backoff, m.words), test, ["sent_id"]).collect()}
        assert set(a) == set(b) and len(a) == 11
        for k in a:
            assert a[k]["p"] == pytest.approx(b[k]["p"]) and (a[k]["oov"], a[k]["match"], a[k]["w"]) == (b[k]["oov"], b[k]["match"], b[k]["w"])
        whole = Whole(m)
        s = ["<s>", *"the cat sat on a zebra".split(), "</s>"]
        for j in range(1, len(s)):
            assert a[1, j - 1]["p"] == pytest.approx(whole.probability(s[:j], s[j]))
    empty = lm.train(train.limit(0), 3)
    assert lm.scores(empty, test.limit(0), ["sent_id"]).count() == 0


def test_restricted_keeps_rows_with_one_key_apart(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["c", "a"]), (1, ["c", "a"]), (2, []), (3, None)], "sent_id bigint, tokens array<string>")
    words = spark.createDataFrame([("a",)], "w string")
    got = sorted((r["sent_id"], r["tokens"]) for r in ng.restricted(df, words, "?", "sent_id").collect())
    assert got == [(1, ["?", "a"]), (1, ["?", "a"]), (1, ["a", "?"]), (2, []), (3, [])]


@pytest.mark.parametrize("decay", [0.5, 0.98, 0.01])
def test_long_articles_with_any_decay(spark, decay):
    rng = random.Random(8)
    words = [rng.choice("abc") if i % 7 else "rare" for i in range(1500)]
    df = spark.createDataFrame([("x", i, w, w == "b") for i, w in enumerate(words)], "a string, pos int, w string, oov boolean")
    got = {r["pos"]: r for r in document_cache.cached(df, "a", ["pos"], decay).collect()}
    total, own = 0.0, Counter()
    for i, w in enumerate(words):
        assert got[i]["pc"] == pytest.approx(0.0 if w == "b" or not total else own[w] / total, abs=1e-9)
        total *= decay
        for k in own:
            own[k] *= decay
        if w != "b":
            total += decay
            own[w] += decay
    with pytest.raises(ValueError, match="decay"):
        document_cache.cached(df, "a", ["pos"], 1.5)


def test_harmonic_numbers(spark):
    r = {x["id"]: x["h"] for x in spark.range(0, 200).select("id", evaluation.harmonic(F.col("id")).alias("h")).collect()}
    for n in r:
        assert r[n] == pytest.approx(sum(1 / i for i in range(1, n + 1)), abs=1e-10)


def test_greedy_split_equals_one_by_one(spark):
    rng = random.Random(10)
    sizes = {f"g{i}": rng.choice([1, 1, 1, 2, 3, 17, 40]) for i in range(400)}
    df = spark.createDataFrame(list(sizes.items()), "root string, size bigint")
    for shares in ({"train": 0.8, "dev": 0.1, "test": 0.1}, {"a": 0.5, "b": 0.5}, {"a": 1.0}, {"a": 0.0, "b": 1.0}):
        got = dict(map(tuple, splitting.greedy_split(df, proportions=shares).collect()))
        total, load = sum(sizes.values()), dict.fromkeys(shares, 0)
        h = lambda g: int(__import__("hashlib").md5(f"20260929:{g}".encode()).hexdigest()[:12], 16)
        for g in sorted(sizes, key=lambda g: (-sizes[g], h(g), g)):
            to = max(shares, key=lambda s: round(shares[s] * total - load[s], 6))
            assert got[g] == to
            load[to] += sizes[g]
    assert splitting.greedy_split(df.limit(0), proportions={"a": 1.0}).count() == 0
    with pytest.raises(ValueError, match="sum to 1"):
        splitting.greedy_split(df, proportions={"a": 0.5})


def test_relational_transform_equals_arrays(spark, train):
    m = lm.train(train, 3)
    d = decoding.distribution_of(m, ["the"])
    state = Whole(m)
    order, q = decoding.reshape(state.distribution(["<s>", "the"]), 0.7, 6, 0.9)
    got = {r["w"]: r["q"] for r in decoding.reshaped(d, 0.7, 6, 0.9).collect()}
    assert sorted(got.values()) == pytest.approx(sorted(q.tolist()))


def test_overlap_and_repetition(spark, train):
    q = spark.createDataFrame([(1, "see the cat sat on zebras".split(), 1), (2, [], 0), (3, None, 0)], "id bigint, tokens array<string>, start int")
    f = overlap.found_spans(q, ["id"], train, longest=4).cache()
    assert {r["id"]: r["span"] for r in overlap.longest_copied(q, "id", f, "start").collect()} == {1: 4, 2: 0, 3: 0}
    assert {r["id"]: r["rate"] for r in overlap.overlap_rate(q, "id", f, 2).collect()}[1] == pytest.approx(3 / 5)
    s = overlap.source_sentences(q, "id", f, train).collect()
    assert [(r["sent_id"], r["words"]) for r in s] == [(0, 4)]
    r = spark.createDataFrame([(["a"] * 4,)], "t array<string>").select(*[c.alias(n) for n, c in overlap.repetition(F.col("t")).items()]).first()
    assert r["type_token_ratio"] == 0.25 and r["repeated_2gram_rate"] == pytest.approx(2 / 3)


def test_tuning(spark, train):
    p = backoff.profiles(backoff.train(train, 3), spark.createDataFrame([(1, "the cat sat on a mat".split())], "sent_id bigint, tokens array<string>"), ["sent_id"]).where("value > 0").cache()
    same = p.select(F.max(F.abs(backoff.normalised(0.4) - backoff.normalised_by_order([0.4, 0.4])))).first()[0]
    assert same == pytest.approx(0, abs=1e-12)
    one, found = tuning.growing_grid(p, [0.1, 0.2], backoff.normalised, factor=1.5, bound=10.0)
    assert found[one] == min(found.values())
    best, value = tuning.coordinate_descent(p, [one, one], [0.5, 1.5], backoff.normalised_by_order)
    assert value <= found[one] + 1e-9 and len(best) == 2


def test_mean_jaccard_with_and_without_pairs(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, "g", [rng.choice("abcdefgh") for _ in range(5)]) for i in range(40)] + [(90, "one", ["a"]), (91, "g", []), (92, "g", None)]
    df = spark.createDataFrame(rows, "id int, g string, tokens array<string>")
    exact = {r["g"]: r for r in overlap.mean_jaccard(df, "id", "g").collect()}
    assert set(exact) == {"g"} and exact["g"]["pairs"] == 780
    monkeypatch.setattr(overlap, "PAIRED", 10)
    rough = overlap.mean_jaccard(df, "id", "g").first()
    assert rough["pairs"] == 780 and rough["mean_jaccard"] == pytest.approx(exact["g"]["mean_jaccard"], abs=0.06)


def test_samples_are_nested(spark):
    s = spark.createDataFrame([(f"a{i}", ["w"] * 4) for i in range(10)], "article_id string, tokens array<string>")
    small, large, all_ = ({r[0] for r in sampling.nested_articles(s, t, 7).collect()} for t in (5, 20, 10**9))
    assert len(small) == 2 and small < large and len(all_) == 10
    v = spark.createDataFrame([("a", 4), ("b", 3), ("c", 1)], "w string, c bigint")
    assert {r["w"] for r in sampling.coverage(v, 0.8).collect()} == {"a", "b"}
    assert math.isclose(sum(r["c"] for r in sampling.coverage(v, 1.0).collect()), 8)


def test_training_runs_are_all_runs_and_no_other(spark):
    rng = random.Random(4)
    own = [[f"w{rng.randrange(1000)}" for _ in range(20)] for _ in range(50)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(own)] + [(90, []), (91, None), (92, ["w1"])], "sent_id bigint, tokens array<string>")
    runs = {tuple(t[i : i + n]) for t in own for n in range(2, 9) for i in range(len(t) - n + 1)}
    known = decoding.training_runs(df)
    assert known.count() == len(runs)
    absent = [r for r in ([f"w{rng.randrange(1000)}" for _ in range(2)] for _ in range(300)) if tuple(r) not in runs]
    assert decoding.copied_tails(known, [list(r) for r in list(runs)[:300]]) == [len(r) for r in list(runs)[:300]]
    assert not any(decoding.copied_tails(known, absent))


def test_mean_jaccard_of_large_groups_is_exact(spark):
    rng = random.Random(2)
    rows = [(i, "g" if i < 130 else "h", [rng.choice("abcdefgh") for _ in range(5)]) for i in range(360)]
    got = {r["g"]: r for r in overlap.mean_jaccard(spark.createDataFrame(rows, "id int, g string, tokens array<string>"), "id", "g").collect()}
    for g, n in (("g", 130), ("h", 230)):
        sets = [set(t) for _, own, t in rows if own == g]
        pairs = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
        assert got[g]["pairs"] == n * (n - 1) // 2 and got[g]["mean_jaccard"] == pytest.approx(sum(pairs) / len(pairs), abs=1e-9)


def test_rank_metrics_take_every_test_sentence(spark, train, monkeypatch):
    rng = random.Random(6)
    words = sorted({w for t in TEXT for w in t.split()})
    own = [[rng.choice([*words, "zebra"]) for _ in range(rng.randrange(1, 6))] for _ in range(130)]
    test = spark.createDataFrame(list(enumerate(own)), "sent_id bigint, tokens array<string>").cache()
    monkeypatch.setattr(text, "corpus", lambda spark, folder, split: train if split == "train" else test)
    assert text.rank_metrics(spark, "").first()["n"] == sum(len(t) + 1 for t in own)
    model = lm.train(train, 3)
    state = Whole(model)
    got = {(r["sent_id"], r["pos"]): (r["greater"], r["equal"]) for r in evaluation.ranks(model, test, "sent_id").collect()}
    for i, t in enumerate(own):
        s = ["<s>", *[w if w in words else "<unk>" for w in t], "</s>"]
        for j in range(1, len(s)):
            if s[j] != "<unk>":
                p = state.distribution(s[:j])
                own_p = p[state.ids[s[j]]]
                low, high = (p > own_p * (1 + 1e-12)).sum(), (p >= own_p * (1 - 1e-12)).sum()
                assert low <= got[i, j - 1][0] and sum(got[i, j - 1]) <= high - 1


def test_learning_curve_ends_with_all_training_words(spark, monkeypatch):
    rng = random.Random(9)
    own = [(i, f"a{i // 20}", [f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(20)]) for i in range(1600)]
    df = spark.createDataFrame(own, "sent_id bigint, article_id string, tokens array<string>").cache()
    monkeypatch.setattr(text, "corpus", lambda spark, folder, split: df if split == "train" else df.where("sent_id < 30"))
    rows = sorted(text.learning_curve_whole(spark, "").collect(), key=lambda r: r["target"])
    assert [r["target"] for r in rows] == [2000, 4000, 8000, 16000, 32000]
    assert rows[-1]["words"] == 32000 and rows[-1]["types"] == len({w for _, _, t in own for w in t})
