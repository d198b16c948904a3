"""Same or near-same records across splits, through a compressed full-text index of the evaluation side."""

from __future__ import annotations

import pickle
import unicodedata
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.text import INVISIBLE_RANGES, SPACE_RANGES
from glyphloom.llm.lookalikes import MAPPED
from glyphloom.plans.materialise import cut

#: Tokens of one index shard; bounds what is sent to every executor for it (a few bytes a token, about 20 in a worker), and how many shards are searched at a time.
SHARD_TOKENS, AT_ONCE = 2_000_000, 4
#: Places of matches that are held at a time.
PLACES = 500_000
#: Cells of the edit-distance table that are held at a time.
CELLS = 2_000_000

_TABLE = {ord(a): b for a, b in MAPPED.items()} | {c: None for lo, hi in INVISIBLE_RANGES for c in range(lo, hi + 1)} | {c: " " for lo, hi in SPACE_RANGES for c in range(lo, hi + 1)}


def plain_token(token: str) -> str:
    """The token in the form of the look-alike operator, accents composed."""
    return unicodedata.normalize("NFC", token.translate(_TABLE)).strip()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the tokens' 64-bit codes and a 128-bit key of the whole list; works on the distinct tokens of a batch."""
    for batch in batches:
        lists = batch.column("tokens")
        flat = lists.flatten().dictionary_encode()
        own = [plain_token(t or "") for t in flat.dictionary.to_pylist()]
        codes = np.array([xxhash.xxh64_intdigest(t.encode()) >> 1 if t else 0 for t in own] or [0], dtype=np.int64)
        values = codes[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
        ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        out, keys = [], []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            v = values[a:b]
            v = v[v != 0]
            out.append(v)
            keys.append(xxhash.xxh3_128_digest(v.tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("side"), pa.array(keys, pa.binary()), pa.array(out, pa.list_(pa.int64()))], names=["id", "side", "cid", "codes"]
        )


def most_edits(n: np.ndarray) -> np.ndarray:
    """The most edits between a list of n tokens and any partner: one per ten tokens of the longer one, which may be longer than n."""
    k = n // 10
    while True:
        more = (n + k + 1) // 10 >= k + 1
        if not more.any():
            return k
        k = k + more


class Index:
    """An FM-index over lists of integer codes. What is kept of it is the Burrows-Wheeler transform of the lists, compressed.

    From that follow the ranks per symbol, and by walking back from the ends of all lists at once the lists themselves and the place of every row.
    """

    def __init__(self, lists: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in lists], dtype=np.int64)
        self.alphabet = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int64)
        starts = np.concatenate([[0], np.cumsum(self.sizes + 1)]).astype(np.int64)
        text = np.zeros(int(starts[-1]), dtype=np.int64)
        for s, x in zip(starts, lists, strict=False):
            text[s : s + len(x)] = np.searchsorted(self.alphabet, x) + 1
        order = self._suffixes(text) if len(text) else np.zeros(0, np.int64)
        before = text[order - 1] if len(text) else text
        before[order == 0] = 0
        self._expand(before)

    def packed(self) -> bytes:
        """The index in as few bytes as its symbols need, compressed: codes, sizes and the transform."""
        small = self.before.astype(np.min_scalar_type(len(self.alphabet)))
        return zlib.compress(pickle.dumps((self.alphabet, self.sizes.astype(np.int32), small)), 6)

    @classmethod
    def unpacked(cls, blob: bytes) -> Index:
        index = cls.__new__(cls)
        index.alphabet, sizes, before = pickle.loads(zlib.decompress(blob))
        index.sizes = sizes.astype(np.int64)
        index._expand(before.astype(np.int64))
        return index

    def _expand(self, before: np.ndarray) -> None:
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)]).astype(np.int64)
        self.n = n = len(before)
        self.before = before.astype(np.int32)
        by_symbol = np.argsort(before, kind="stable")
        self.keys = before[by_symbol] * (n + 1) + by_symbol
        self.text, self.place = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        # The ends of the lists are the first rows, in the order of the lists.
        live, row, at = np.arange(len(self.sizes)), np.arange(len(self.sizes)), self.starts[:-1] + self.sizes
        self.place[row] = at
        while len(live):
            symbol = before[row]
            go = at > self.starts[live]
            live, row, at, symbol = live[go], row[go], at[go] - 1, symbol[go]
            row = np.searchsorted(self.keys, symbol * (n + 1) + row)
            self.text[at], self.place[row] = symbol, at

    def _suffixes(self, text: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling; the ends of lists are smaller than any symbol and differ from one another."""
        ends = np.flatnonzero(text == 0)
        rank = text + len(ends)
        rank[ends] = np.arange(len(ends))
        step = 1
        while True:
            after = np.full(len(text), -1, dtype=np.int64)
            after[:-step] = rank[step:]
            key = rank * (int(rank.max(initial=0)) + 2) + after + 1
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank = np.empty(len(text), dtype=np.int64)
            rank[order] = fresh
            if fresh[-1] == len(text) - 1 or step >= len(text):
                return order
            step *= 2

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """Dense symbols of codes; -1 for those that the index doesn't have."""
        if not len(self.alphabet):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 1, -1)

    def search(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the index whose suffixes begin with symbols[begin:end], by backward search of all patterns at once."""
        low, high = np.zeros(len(begin), dtype=np.int64), np.full(len(begin), self.n, dtype=np.int64)
        at = end - 1
        live = np.flatnonzero(at >= begin)
        while len(live):
            c = symbols[at[live]]
            good = c > 0
            low[live[~good]] = high[live[~good]] = 0
            live, c = live[good], c[good]
            low[live] = np.searchsorted(self.keys, c * (self.n + 1) + low[live])
            high[live] = np.searchsorted(self.keys, c * (self.n + 1) + high[live])
            at[live] -= 1
            live = live[(low[live] < high[live]) & (at[live] >= begin[live])]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        return self.place[rows].astype(np.int64)

    def maximal_matches(self, symbols: np.ndarray, start: np.ndarray, n: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """All maximal exact matches of ``least`` tokens or more between lists symbols[start:start + n] and the indexed ones: list, begin, end and place in the index, in blocks.

        Backward search finds all places of every window of ``least`` tokens; those that can be grown to the left lie in the
        match of the window before and are dropped, so each match is met once, at its beginning, and grown to the right.
        """
        owner = np.repeat(np.arange(len(n)), np.maximum(n - least + 1, 0))
        heads = np.cumsum(np.maximum(n - least + 1, 0)) - np.maximum(n - least + 1, 0)
        begin = np.arange(len(owner)) - heads[owner] + start[owner]
        low, high = self.search(symbols, begin, begin + least[owner])
        hit = np.flatnonzero(high > low)
        total = np.cumsum((high - low)[hit])
        at = 0
        while at < len(hit):
            # A frequent window has many places; they are taken in blocks, so that they don't fill the memory.
            take = max(1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PLACES, side="right")) - at)
            own = hit[at : at + take]
            at += take
            count = (high - low)[own]
            window = np.repeat(own, count)
            place = self.locate(np.repeat(low[own], count) + np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count))
            b, o = begin[window], owner[window]
            before = np.where(b > start[o], symbols[b - 1], -1)
            fresh = (before <= 0) | (before != np.where(place > 0, self.text[place - 1], 0))
            b, o, place = b[fresh], o[fresh], place[fresh]
            size = least[o].copy()
            live = np.arange(len(size))
            while len(live):
                live = live[b[live] + size[live] < start[o[live]] + n[o[live]]]
                live = live[symbols[b[live] + size[live]] == self.text[place[live] + size[live]]]
                size[live] += 1
            yield o, b, b + size, place


def merged(pair: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, and how many tokens the union of each one's spans has."""
    if not len(pair):
        return pair, np.zeros(0, dtype=np.int64)
    order = np.lexsort((begin, pair))
    pair, begin, end = pair[order], begin[order], end[order]
    heads = np.flatnonzero(np.concatenate([[True], np.diff(pair) != 0]))
    far = int(end.max()) + 1
    part = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(pair))))
    reach = np.maximum.accumulate(end + part * far) - part * far  # how far the pair's spans reach so far
    before = np.concatenate([[0], reach[:-1]])
    before[heads] = 0
    return pair[heads], np.add.reduceat(np.maximum(0, end - np.maximum(begin, before)), heads)


def edits_within(a: np.ndarray, a_at: np.ndarray, n: np.ndarray, b: np.ndarray, b_at: np.ndarray, m: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether each pair a[a_at:a_at+n], b[b_at:b_at+m] is within k edits; banded dynamic programming over all pairs at once."""
    if not len(n):
        return np.zeros(0, dtype=bool)
    width, far = 2 * int(k.max()) + 1, 1 << 20
    mid = width // 2
    j0 = np.arange(width) - mid
    row = np.where((j0 >= 0)[None, :] & (j0[None, :] <= m[:, None]), np.abs(j0)[None, :], far)
    live, result = np.arange(len(n)), np.zeros(len(n), dtype=bool)
    for i in range(1, int(n.max()) + 2):
        over = live[n[live] < i]
        if len(over):
            column = m[over] - n[over] + mid
            inside = (column >= 0) & (column < width)
            result[over[inside]] = row[np.flatnonzero(n[live] < i)[inside], column[inside]] <= k[over[inside]]
        stay = n[live] >= i
        live, row = live[stay], row[stay]
        if not len(live):
            break
        j = i + j0
        ok = (j >= 1)[None, :] & (j[None, :] <= m[live][:, None])
        letters = b[np.minimum(b_at[live][:, None] + np.clip(j - 1, 0, None)[None, :], len(b) - 1)]
        change = row + (letters != a[a_at[live] + i - 1][:, None])
        drop = np.concatenate([row[:, 1:], np.full((len(live), 1), far)], axis=1) + 1
        new = np.where(ok, np.minimum(change, drop), np.where((j == 0)[None, :], i, far))
        # An insertion costs one more than the cell to its left: a running minimum along the band.
        new = np.where(ok, np.minimum.accumulate(new - j0, axis=1) + j0, new)
        alive = new.min(axis=1) <= k[live]
        live, row = live[alive], new[alive]
    return result


def _probe(index: Index, ids: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                yield _matches(index, ids, part.column("cid").to_pylist(), part.column("codes"))

    return run


def _matches(index: Index, ids: list[bytes], cids: list[bytes], lists: pa.ListArray) -> pa.RecordBatch:
    """Pairs of a training class and an evaluation class within the allowed edits.

    k edits leave one of k + 1 pieces of the training list untouched, so a pair has a maximal match of such a piece's
    length at least. The spans of a pair's matches are merged; banded edit distance then decides. ``covered`` counts the
    training list's tokens in merged spans.
    """
    ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    symbols = index.symbols(lists.flatten().to_numpy(zero_copy_only=False))
    start, n = ends[:-1].astype(np.int64), np.diff(ends).astype(np.int64)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
    for t, begin, end, place in index.maximal_matches(symbols, start, n, np.maximum(n // (most_edits(n) + 1), 1)):
        other = np.searchsorted(index.starts, place, side="right") - 1
        longest = np.maximum(n[t], index.sizes[other])
        near = (np.abs(n[t] - index.sizes[other]) <= longest // 10) & (np.abs((place - index.starts[other]) - (begin - start[t])) <= longest // 10)
        parts.append((t[near] * len(ids) + other[near], (begin - start[t])[near], (end - start[t])[near]))
    codes, covered = merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    out_a: list[bytes] = []
    out_b: list[bytes] = []
    out_c: list[int] = []
    t, other = np.divmod(codes, max(len(ids), 1))
    band = 2 * (np.maximum(n[t], index.sizes[other]) // 10) + 1
    by_band = np.argsort(band, kind="stable")
    codes, covered, band = codes[by_band], covered[by_band], band[by_band]
    x = 0
    while x < len(codes):
        # Few pairs at a time where bands are wide: the cells of a row bound the memory.
        take = max(1, CELLS // int(band[x]))
        take = max(1, CELLS // int(band[min(x + take, len(band)) - 1]))
        t, other = np.divmod(codes[x : x + take], max(len(ids), 1))
        spans = covered[x : x + take]
        x += take
        good = edits_within(symbols, start[t], n[t], index.text, index.starts[other], index.sizes[other], np.maximum(n[t], index.sizes[other]) // 10)
        out_a += [cids[i] for i in t[good]]
        out_b += [ids[i] for i in other[good]]
        out_c += spans[good].tolist()
    return pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary()), pa.array(out_c, pa.int32())], names=["cid_train", "cid_eval", "covered"])


def _build(shard: pd.DataFrame) -> pd.DataFrame:
    index = Index([np.asarray(x, dtype=np.int64) for x in shard["codes"]])
    return pd.DataFrame({"shard": [int(shard["shard"].iloc[0])], "index": [pickle.dumps((index.packed(), list(shard["cid"])))]})


def encoded(df: DataFrame) -> DataFrame:
    """``id, side, cid, codes`` of ``id, side, tokens``: rows with equal plain tokens have the same cid."""
    return df.select("id", "side", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")).mapInArrow(_encode, "id bigint, side string, cid binary, codes array<bigint>")


def cross_pairs(rows: DataFrame, train: str = "train") -> DataFrame:
    """``cid_train, cid_eval, covered``: classes of equal token lists on either side within one edit per ten tokens of the longer; covered: tokens of the training list in verbatim spans.

    ``rows`` is an encoded table. The evaluation classes are cut into shards of about SHARD_TOKENS
    tokens; each shard's compressed index is built in one task and then sent to the executors, which stream the
    training classes through it, AT_ONCE shards at a time. Nothing grows with the corpus but the number of shards.
    """
    spark = rows.sparkSession
    classes = rows.groupBy("cid").agg(F.first("codes").alias("codes"), F.max(F.col("side") == train).alias("in_train"), F.max(F.col("side") != train).alias("in_eval"))
    classes = cut(classes.where(F.size("codes") > 0))
    held = classes.where("in_eval")
    tokens = held.agg(F.sum(F.size("codes"))).first()[0] or 0
    shards = max(1, -(-tokens // SHARD_TOKENS))
    built = cut(held.withColumn("shard", F.pmod(F.xxhash64("cid"), F.lit(shards)).cast("int")).select("shard", "cid", "codes").groupBy("shard").applyInPandas(_build, "shard int, index binary"))
    stream = classes.where("in_train").select("cid", "codes")
    schema = "cid_train binary, cid_eval binary, covered int"

    def search(s: int) -> DataFrame | None:
        blob = built.where(F.col("shard") == s).select("index").collect()
        if not blob:
            return None
        sent = spark.sparkContext.broadcast(bytes(blob[0]["index"]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            packed, ids = pickle.loads(sent.value)
            yield from _probe(Index.unpacked(packed), ids)(batches)

        found = cut(stream.mapInArrow(run, schema))
        sent.destroy()
        return found

    with ThreadPoolExecutor(AT_ONCE) as pool:
        parts = [x for x in pool.map(search, range(shards)) if x is not None]
    out = reduce(DataFrame.unionByName, parts, spark.createDataFrame([], schema))
    return out.groupBy("cid_train", "cid_eval").agg(F.max("covered").alias("covered"))
