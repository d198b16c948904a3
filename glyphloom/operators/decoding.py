"""Generating text from a back-off model: sampling, greedy and beam search, and policies that watch entropy or copying.

All runs take one step at a time together. The model stays a table, sorted by a hash of the history:
a step reads the rows of the histories that the runs stand at (the scan is pruned by that hash), joins
them to the runs and lets each run choose. So a model of any size and order decodes; what is sent
whole is the vocabulary. The driver keeps the runs, a stated set, with the words each has so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.functions.keys import draw
from glyphloom.operators import ngrams as ng
from glyphloom.plans.materialise import cut

#: Temperatures that a policy may choose.
COLDEST, HOTTEST = 0.05, 3.0
#: Temperatures of the policy against copying: usual, and while the last words are copied.
CALM, HEATED = 0.7, 1.3
_STEP = "run int, choices array<struct<word:int,p:double,q:double,entropy:double,kept:int,top:double,match:int>>"


@dataclass
class Successors:
    """``table``: h (hash of order and history), k, hist, ids, p, gamma; the vocabulary with the ids' words and unigram probabilities."""

    order: int
    table: DataFrame
    words: list[str]
    unigram: np.ndarray


def successors(model) -> Successors:
    """The model as one row per history, with its followers as arrays; a history has no more followers than the vocabulary has words."""
    spark = model.entries.sparkSession
    one = model.entries.where((F.col("k") == 1) & (F.col("w") != ng.UNK)).select("w", "p").orderBy("w").toPandas()
    numbers = spark.createDataFrame(pd.DataFrame({"w": one.w, "id": np.arange(len(one), dtype=np.int32)}))
    follow = model.entries.where("k > 1").join(numbers, "w").groupBy("k", "hist").agg(F.collect_list(F.struct("id", "p")).alias("f"))
    rows = model.backoff.where("k > 1").join(follow, ["k", "hist"], "left").select(_place("k", "hist").alias("h"), "k", "hist", F.col("f.id").alias("ids"), F.col("f.p").alias("p"), "gamma")
    return Successors(model.order, cut(rows.repartitionByRange("h").sortWithinPartitions("h")), one.w.tolist(), one.p.to_numpy())


def _place(k: str, hist: str) -> Column:
    return F.xxhash64(F.col(k), F.col(hist))


def reshape(p: np.ndarray, temperature: float = 1.0, top_k: int = 0, top_p: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Words by falling probability and the shares they are drawn with.

    Of the ``top_k`` likeliest words (0: of all) each weighs p^(1/T); of those the shortest beginning that makes up ``top_p`` is kept. Ties in the order of the words.
    """
    best = np.lexsort((np.arange(len(p)), -p))[: top_k or len(p)]
    weight = np.power(p[best] / p[best[0]], 1 / temperature)
    share = weight / weight.sum()
    kept = share[np.cumsum(share) - share < top_p] if top_p < 1 else share
    return best[: len(kept)], kept / kept.sum()


def entropy(q: np.ndarray) -> float:
    q = q[q > 0]
    return float(q @ -np.log2(q))


def temperature_for(p: np.ndarray, bits: float) -> float:
    """The temperature between COLDEST and HOTTEST at which p^(1/T) has an entropy of ``bits``; the nearer end if none has.

    With b = 1/T the entropy falls by b Var[ln p] per unit of b, so Newton's method solves it; a step that
    leaves the interval known to hold the root halves that instead.
    """
    x = np.log(p[p > 0])
    x = x - x.max()
    goal = bits * np.log(2.0)

    def at(b: float) -> tuple[float, float]:
        w = np.exp(b * x)
        z = w.sum()
        mean = (w @ x) / z
        return float(np.log(z) - b * mean), float(-b * ((w @ (x * x)) / z - mean * mean))

    low, high = 1 / HOTTEST, 1 / COLDEST
    if goal >= at(low)[0]:
        return HOTTEST
    if goal <= at(high)[0]:
        return COLDEST
    b = 1.0
    for _ in range(60):
        value, slope = at(b)
        if abs(value - goal) < 1e-12:
            break
        low, high = (b, high) if value > goal else (low, b)
        nearer = b - (value - goal) / slope if slope else low - 1
        b = nearer if low < nearer < high else (low + high) / 2
    return 1 / b


def training_runs(train: DataFrame, *, longest: int = 8) -> DataFrame:
    """``h``: the 64-bit hashes of all distinct runs of 2..``longest`` words of training, sorted, so that a step reads only where its own may lie.

    Exact but for hash collisions: n runs take an absent one for one of them with probability n / 2^64.
    """
    places = F.sequence(F.lit(1), F.size("t") - 1)
    runs = F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(2), F.least(F.lit(longest), F.size("t") - i + 1)), lambda n: _run_hash(F.slice("t", i, n)))))
    h = train.select(F.col("tokens").alias("t")).where(F.size("t") >= 2).select(F.explode(runs).alias("h")).distinct()
    return cut(h.repartitionByRange("h").sortWithinPartitions("h"))


def _run_hash(words: Column) -> Column:
    return F.xxhash64(F.array_join(words, ng.SEP))


def copied_tails(known: DataFrame, texts: list[list[str]], longest: int = 8) -> list[int]:
    """For each text how many words at its end are a run of two or more that training has; a part of a known run is known, so the longest known one tells."""
    tails = [(i, n, ng.SEP.join(t[-n:])) for i, t in enumerate(texts) for n in range(2, min(longest, len(t)) + 1)]
    out = [0] * len(texts)
    if tails:
        asked = known.sparkSession.createDataFrame(tails, "i int, n int, run string").select("i", "n", F.xxhash64("run").alias("h"))
        hashes = [r["h"] for r in asked.select("h").distinct().collect()]
        for r in asked.join(known.where(F.col("h").isin(hashes)), "h").groupBy("i").agg(F.max("n").alias("n")).collect():
            out[r["i"]] = r["n"]
    return out


def _stepped(model: Successors, sent, runs: list[dict]) -> dict[int, list]:
    """One step of all ``runs`` (words, temperature or bits, top_k, top_p, u, most): what each may choose, by number."""
    spark = model.table.sparkSession
    rows, asked = [], []
    for i, r in enumerate(runs):
        rows.append((i, r["kind"], float(r["value"]), int(r["top_k"]), float(r["top_p"]), float(r["u"]), int(r["most"])))
        asked += [(i, k, ng.SEP.join(r["words"][len(r["words"]) - k + 1 :])) for k in range(2, min(model.order, len(r["words"]) + 1) + 1)]
    state = spark.createDataFrame(rows, "run int, kind string, value double, top_k int, top_p double, u double, most int")
    at = spark.createDataFrame(asked, "run int, k int, hist string").withColumn("h", _place("k", "hist"))
    hashes = [x["h"] for x in at.select("h").distinct().collect()]
    found = model.table.where(F.col("h").isin(hashes)).join(F.broadcast(at), ["h", "k", "hist"])  # as many rows as runs and orders
    levels = found.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("k", "gamma", "ids", "p"))).alias("levels"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unigram = sent.value
        for batch in batches:
            out = []
            for r in batch.itertuples():
                p, match = unigram.copy(), np.ones(len(unigram), dtype=np.int8)
                for level in r.levels if r.levels is not None else []:
                    p *= level["gamma"]
                    if level["ids"] is not None:
                        ids = np.asarray(level["ids"])
                        p[ids] = level["p"]
                        match[ids] = level["k"]
                bits = entropy(p / p.sum())
                if r.kind == "best":
                    order, q = reshape(p, 1.0, r.most)
                    pick = range(len(order))
                else:
                    order, q = reshape(p, temperature_for(p / p.sum(), r.value) if r.kind == "entropy" else r.value, r.top_k, r.top_p)
                    pick = [min(int(np.searchsorted(np.cumsum(q), r.u, side="right")), len(q) - 1)]
                out.append([{"word": int(order[i]), "p": float(p[order[i]]), "q": float(q[i]), "entropy": bits, "kept": len(order), "top": float(p.max()), "match": int(match[order[i]])} for i in pick])
            yield pd.DataFrame({"run": batch["run"], "choices": out})

    return {r["run"]: r["choices"] for r in state.join(levels, "run", "left").mapInPandas(choose, _STEP).collect()}


TRACE = "array<struct<word:string,p:double,q:double,entropy:double,kept:int,top:double,match:int>>"


def _trace(model: Successors, c) -> tuple:
    return (model.words[c["word"]], c["p"], c["q"], c["entropy"], c["kept"], c["top"], c["match"])


def generated(runs: DataFrame, model, *, longest: int = 40, known: DataFrame | None = None) -> DataFrame:
    """``runs`` (prompt, policy, value, top_k, top_p, seed and keys) with ``tokens, hit_eos, steps``.

    Policies: greedy; fixed (value: temperature); entropy (value: bits to hold); anticopy (CALM, or HEATED once
    the last ``value`` words, of the prompt at most one, copy ``known`` runs of training); beam (value: width, top_p: length penalty, keeps words but a single
    step with the whole probability). A draw comes from md5 of seed and step. An empty table gives an empty result.
    """
    spark = runs.sparkSession
    s = model if isinstance(model, Successors) else successors(model)
    sent = spark.sparkContext.broadcast(s.unigram)
    rows = runs.collect()  # a stated set
    states = [{"prompt": list(r["prompt"] or []), "out": [], "steps": [], "eos": False} for r in rows]
    beams = [i for i, r in enumerate(rows) if r["policy"] == "beam"]
    live = [i for i, r in enumerate(rows) if r["policy"] != "beam"]
    for step in range(longest):
        if not live:
            break
        hot = dict.fromkeys(live, 0)
        watch = [i for i in live if rows[i]["policy"] == "anticopy"]
        if watch:
            hot |= dict(zip(watch, copied_tails(known, [(states[i]["prompt"] + states[i]["out"])[-len(states[i]["out"]) - 1 :] for i in watch]), strict=True))
        asked = []
        for i in live:
            r, policy = rows[i], rows[i]["policy"]
            value = (HEATED if hot[i] >= r["value"] else CALM) if policy == "anticopy" else r["value"]
            asked.append({"words": [ng.BOS, *states[i]["prompt"], *states[i]["out"]], "kind": {"greedy": "best", "entropy": "entropy"}.get(policy, "draw"), "value": value, "top_k": r["top_k"], "top_p": r["top_p"], "u": draw(r["seed"], step), "most": 1})
        got = _stepped(s, sent, asked)
        after = []
        for n, i in enumerate(live):
            t = _trace(s, got[n][0])
            states[i]["steps"].append(t)
            if t[0] == ng.EOS:
                states[i]["eos"] = True
            else:
                states[i]["out"].append(t[0])
                after.append(i)
        live = after
    for i, found in zip(beams, beam(s, sent, [(states[i]["prompt"], int(rows[i]["value"])) for i in beams], longest), strict=True):
        score, words, ended = max(found, key=lambda c: (c[0] / max(len(c[1]) + c[2], 1) ** rows[i]["top_p"], c[0]))
        states[i] |= {"out": words, "eos": ended, "steps": [("", 10**score, 0.0, 0.0, 0, 0.0, 0)]}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema) + f", tokens array<string>, hit_eos boolean, steps {TRACE}"
    return spark.createDataFrame([(*r, x["out"], x["eos"], x["steps"]) for r, x in zip(rows, states, strict=True)], schema)


def beam(model: Successors, sent, starts: list[tuple[list[str], int]], longest: int) -> list[list[tuple[float, list[str], bool]]]:
    """For each (prompt, width) all finished hypotheses and those open at the end: log10 probability, words, finished.

    A step is one relation of hypotheses and their best successors. By falling score, the first ``width`` that don't end the sentence live on,
    and those that end it are finished if fewer than ``width`` living ones stand before them.
    """
    heads = [[(0.0, [])] for _ in starts]
    done: list[list] = [[] for _ in starts]
    for _ in range(longest):
        flat = [(i, score, words) for i, own in enumerate(heads) for score, words in own]
        if not flat:
            break
        got = _stepped(model, sent, [{"words": [ng.BOS, *starts[i][0], *words], "kind": "best", "value": 1.0, "top_k": 0, "top_p": 1.0, "u": 0.0, "most": starts[i][1] + 1} for i, _, words in flat])
        heads = [[] for _ in starts]
        for i, (_, width) in enumerate(starts):
            step = [(score + float(np.log10(c["p"])), n, rank, model.words[c["word"]], words) for n, (j, score, words) in enumerate(flat) if j == i for rank, c in enumerate(got[n])]
            step.sort(key=lambda c: (-c[0], c[1], c[2]))
            open_ = np.array([c[3] != ng.EOS for c in step], dtype=bool)
            living = np.cumsum(open_)
            heads[i] = [(step[x][0], [*step[x][4], step[x][3]]) for x in np.flatnonzero(open_ & (living <= width))]
            done[i] += [(step[x][0], step[x][4], True) for x in np.flatnonzero(~open_ & (living < width))]
    return [d + [(score, words, False) for score, words in own] for d, own in zip(done, heads, strict=True)]


def distribution_of(model, context: list[str]) -> DataFrame:
    """``w, p`` of every word after one context, as a relation: followers at their longest match, the rest by the weights above."""
    spark = model.entries.sparkSession
    full = [ng.BOS, *context]
    hists = [(k, ng.SEP.join(full[len(full) - k + 1 :])) for k in range(1, min(model.order, len(full) + 1) + 1)]
    h = F.broadcast(spark.createDataFrame(hists, "k int, hist string"))  # as many rows as the order
    own = model.entries.join(h, ["k", "hist"]).groupBy("w").agg(F.max(F.struct("k", "p")).alias("m"))
    g = {r["k"]: r["gamma"] for r in model.backoff.join(h, ["k", "hist"]).collect()}
    above = {k: float(np.prod([g.get(j, 1.0) for j in range(k + 1, len(hists) + 1)])) for k in range(1, len(hists) + 1)}
    factor = F.element_at(F.array(*[F.lit(above[k]) for k in range(1, len(hists) + 1)]), F.col("m.k"))
    return own.where(F.col("w") != ng.UNK).select("w", (F.col("m.p") * factor).alias("p"))


def reshaped(distribution: DataFrame, temperature: float, top_k: int, top_p: float) -> DataFrame:
    """``w, q``: the transform as windows over one context's words (a vocabulary, ordered once)."""
    order = Window.orderBy(F.desc("p"), "w")
    d = distribution.withColumn("_r", F.row_number().over(order))
    if top_k:
        d = d.where(F.col("_r") <= top_k)
    d = d.withColumn("_x", F.pow("p", F.lit(1.0 / temperature))).withColumn("_q", F.col("_x") / F.sum("_x").over(Window.partitionBy()))
    if top_p < 1:
        d = d.withColumn("_before", F.coalesce(F.sum("_q").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).where(F.col("_before") < top_p)
    return d.select("w", (F.col("_q") / F.sum("_q").over(Window.partitionBy())).alias("q"))
