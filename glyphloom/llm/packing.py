"""Filling containers of fixed capacity with items of varying length: best-two-fit over the histogram of lengths."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.keys import running_before
from glyphloom.functions.workers import per_process
from glyphloom.plans.materialise import cut

#: Where the public tokenizer's vocabulary is; a parameter of every function that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pattern by which that vocabulary cuts a text before merging bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Items that a task numbers, at most about.
NUMBERED = 200_000


def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, *, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``key, n_tokens``; NULL and empty texts have none. Special tokens in a text are ordinary text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = per_process("tokenizer_" + tokenizer, lambda: _encoding(tokenizer))
        for batch in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n, pa.int32())], names=[key, "n_tokens"])

    plain = df.select(key, F.col(text).alias("_text"))
    return plain.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens int")


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how many such bins), from how many items there are of each length up to the capacity.

    A bin is filled greedily with the longest items that fit; then its shortest item gives way to
    the two unpacked items that fit the widened gap most tightly, if they fill more. The bin is repeated while
    its items last, so every step uses up a length and there are at most as many kinds of bins as lengths.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts.items():
        left[size] = n
    bins: list[tuple[list[int], int]] = []
    while True:
        present = np.flatnonzero(left)
        if not len(present):
            return bins
        used: dict[int, int] = {}
        gap, own = capacity, []
        while gap > 0:
            at = np.searchsorted(present, gap, side="right") - 1
            while at >= 0 and used.get(int(present[at]), 0) >= left[present[at]]:
                at -= 1
            if at < 0:
                break
            size = int(present[at])
            take = min(int(left[size]) - used.get(size, 0), gap // size)
            used[size] = used.get(size, 0) + take
            own += [size] * take
            gap -= size * take
        if gap > 0 and len(own) > 1:
            least = own[-1]
            used[least] -= 1
            room = gap + least
            sizes = present[(present <= room) & (left[present] > [used.get(int(p), 0) for p in present])]
            # Of each first item the longest second one that fits beside it; the same length needs two items.
            second = np.searchsorted(sizes, room - sizes, side="right") - 1
            best, pair = least, None
            for i in np.flatnonzero(second >= 0):
                j = int(second[i])
                if j == i and left[sizes[i]] - used.get(int(sizes[i]), 0) < 2:
                    j -= 1
                if j >= 0 and sizes[i] + sizes[j] > best:
                    best, pair = int(sizes[i] + sizes[j]), (int(sizes[i]), int(sizes[j]))
                    if best == room:
                        break
            if pair:
                own = [*own[:-1], *pair]
                for p in pair:
                    used[p] = used.get(p, 0) + 1
            else:
                used[least] += 1
        times = min(int(left[s]) // n for s, n in used.items() if n)
        bins.append((own, times))
        for s, n in used.items():
            left[s] -= n * times


def packed(sizes: DataFrame, *, key: str, size: str, capacity: int) -> DataFrame:
    """``key, piece, size, container``: where every item, or every piece of an item longer than the capacity, goes.

    An item longer than the capacity gives full pieces, which fill a container each, and a rest that is
    packed like an item. Only the histogram of lengths, at most one number per length up to the
    capacity, comes to the driver; bins are made of lengths, and the items of one length are
    numbered across the cluster and take the places of that length in order. Items of length 0, NULL or less go into
    the first container. Repeated and NULL keys are items of their own. A capacity under 1 raises ValueError.
    """
    if capacity < 1:
        raise ValueError("the capacity has to be at least 1")
    spark = sizes.sparkSession
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint")
    items = sizes.select(F.col(key).alias("_key"), n.alias("_n")).withColumn("_full", F.floor(F.col("_n") / capacity)).withColumn("_rest", F.col("_n") % capacity)
    loose = items.where((F.col("_rest") > 0) | (F.col("_n") == 0)).select("_key", F.col("_full").alias("_piece"), F.col("_rest").cast("int").alias("_size"))
    counts = {r["_size"]: r["n"] for r in loose.where("_size > 0").groupBy("_size").agg(F.count("*").alias("n")).collect()}
    first: list[tuple[int, int]] = []
    base: list[int] = []
    used: dict[int, int] = {}
    containers = 0
    for own, times in best_two_fit(counts, capacity):
        for s in own:
            first.append((s, used.get(s, 0)))
            base.append(containers)
            used[s] = used.get(s, 0) + times
        containers += times
    containers = max(containers, 1)
    # (length, number) -> container: the last place of the length that begins at or before the number.
    place = np.array([s << 40 | r for s, r in first], dtype=np.int64)
    order = np.argsort(place)
    sent = spark.sparkContext.broadcast((place[order], np.array(base, dtype=np.int64)[order]))

    @F.pandas_udf("bigint")
    def container(lengths: pd.Series, numbers: pd.Series) -> pd.Series:
        places, bases = sent.value
        keys = lengths.to_numpy(np.int64) << 40 | numbers.to_numpy(np.int64)
        if not len(places):
            return pd.Series(np.zeros(len(keys), dtype=np.int64))
        at = np.maximum(np.searchsorted(places, keys, side="right") - 1, 0)
        return pd.Series(np.where(lengths.to_numpy() > 0, bases[at] + keys - places[at], 0))

    buckets = max(64, sum(counts.values()) // NUMBERED)
    numbered = running_before(loose, ["_size"], ["_key", "_piece"], F.lit(1), "_number", buckets=buckets)
    rest = numbered.select("_key", "_piece", "_size", container("_size", "_number").alias("_container"))
    whole = running_before(items.where("_full > 0").select("_key", "_full"), [], ["_key"], F.col("_full"), "_before", buckets=buckets)
    pieces = whole.select("_key", "_before", F.explode(F.sequence(F.lit(0), F.col("_full") - 1)).alias("_piece")).select("_key", "_piece", F.lit(capacity).alias("_size"), (F.col("_before") + F.col("_piece") + containers).alias("_container"))
    return rest.unionByName(pieces).select(F.col("_key").alias(key), F.col("_piece").cast("int").alias("piece"), F.col("_size").alias("size"), F.col("_container").alias("container"))


def packed_for_all(documents: DataFrame, capacities: list[tuple[int, int]], *, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``spec_id`` and the packing for each (spec_id, capacity); tokens are counted once."""
    sizes = cut(token_counts(documents, key=key, text=text, tokenizer=tokenizer))
    out = None
    for spec, capacity in capacities:
        own = packed(sizes, key=key, size="n_tokens", capacity=capacity).select(F.lit(spec).alias("spec_id"), key, "piece", "size", "container")
        out = own if out is None else out.unionByName(own)
    return out
