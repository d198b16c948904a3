"""Subject area of each document, by averaged word and subword embeddings with independent logistic outputs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.llm import sentences
from glyphloom.llm.codepoints import ACCENT, BREAK, DENSE, INVISIBLE, LETTER, VOWEL, folded, joined, slices
from glyphloom.plans.materialise import cut

#: Labelled documents that the classifier is fitted on at most, in a fixed hash order; scoring covers every document.
TRAINING_DOCUMENTS = 6000
#: Hash buckets of words and subwords; those kept, which at least so many training sentences have (training is bounded, so they are); the width of their embeddings.
BUCKETS, VOCABULARY, LEAST_SEEN, WIDTH = 1 << 20, 32_768, 4, 10
#: Letters of the runs that are the subwords of a word.
SUBWORD = 4
#: Synchronised gradient steps with document labels on all sentences, and with labels only on sentences that show them.
FIRST_STEPS, SECOND_STEPS = 30, 15
RATE, DECAY = 0.1, 2e-4
#: Scale of an averaged embedding: a sentence has a few telling words among dozens.
GAIN = 8.0
#: Probability from which a sentence of a labelled document keeps the label in the second steps.
KEPT = 0.2
SHARE = 0.25
#: Partitions of the training sentences: a fixed number, as their count is bounded and gradients are summed in this order.
PARTS = 8


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and subwords, and where each text's begin (one more at the end); an empty text has one bucket of its own.

    Scripts written without spaces give runs of two and three letters, others whole words and
    all runs of SUBWORD letters inside them. Case, width and accents don't matter; digits are left out.
    """
    data, _ = joined(texts)
    fold, kind = folded(data)
    stop = data == BREAK
    letter = (kind & (LETTER | VOWEL)) > 0
    hidden = (kind & (INVISIBLE | ACCENT)) > 0
    if hidden.any():
        keep = ~hidden
        fold, kind, stop, letter = fold[keep], kind[keep], stop[keep], letter[keep]
    dense = letter & ((kind & DENSE) > 0)
    c = fold.astype(np.uint64)
    text = np.cumsum(np.concatenate([[0], stop[:-1]]))
    parts, owners = [np.zeros(len(texts), dtype=np.uint64)], [np.arange(len(texts))]
    two = dense[:-1] & dense[1:]
    h = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    at = np.flatnonzero(two)
    parts.append(h[at] >> np.uint64(20))
    owners.append(text[at])
    three = np.flatnonzero(two[:-1] & two[1:])
    parts.append((h[three] * np.uint64(0x165667B19E3779F9) + c[three + 2] * np.uint64(0x27D4EB2F165667C5)) >> np.uint64(21))
    owners.append(text[three])
    word = letter & ~dense
    first = word & ~np.concatenate([[False], word[:-1]])
    starts = np.flatnonzero(first)
    if len(starts):
        inside = np.flatnonzero(word)
        number = np.cumsum(first)[inside] - 1
        place = inside - starts[number]
        power = np.cumprod(np.full(64, 0x100000001B3, dtype=np.uint64), dtype=np.uint64)
        value = (c[inside] + np.uint64(7)) * power[place % 64]
        edge = np.flatnonzero(np.concatenate([[True], np.diff(number) > 0]))
        parts.append(np.add.reduceat(value, edge) >> np.uint64(17))
        owners.append(text[starts])
        n = len(inside) - SUBWORD + 1
        if n > 0:
            whole = np.flatnonzero(number[SUBWORD - 1 :] == number[:n])
            h = np.zeros(len(whole), dtype=np.uint64)
            for k in range(SUBWORD):
                h = h * np.uint64(0x9E3779B97F4A7C15) + c[inside[whole + k]]
            parts.append(h >> np.uint64(23))
            owners.append(text[inside[whole]])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    bucket = (np.concatenate(parts)[order] % np.uint64(BUCKETS)).astype(np.int32)
    return bucket, np.searchsorted(owner[order], np.arange(len(texts) + 1))


def _pieces(model: sentences.Model, batch: pa.RecordBatch, texts: list[str | None]) -> Iterator[tuple[int, int, list[str], np.ndarray]]:
    """A few rows of observed texts at a time: their range, all their sentences, and where each row's begin (one more at the end)."""
    ends, starts = sentences.decided(model, batch.column("_stops"), batch.column("_events"), batch.column("_longest").to_numpy(zero_copy_only=False), texts)
    for low, high in slices(texts, 300_000):
        out: list[str] = []
        for i in range(low, high):
            a, t = 0, texts[i]
            for b in ends[starts[i] : starts[i + 1]].tolist():
                out.append(t[a:b])
                a = b
        yield low, high, out, starts[low : high + 1] - starts[low]


def _training_rows(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        given = batch.column("labels")
        for low, _, own, at in _pieces(model, batch, batch.column("_text").to_pylist()):
            bucket, starts = features(own)
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(bucket, pa.int32()))
            which = np.repeat(np.arange(low, low + len(at) - 1), np.diff(at))
            yield pa.RecordBatch.from_arrays([lists, given.take(pa.array(which))], names=["buckets", "labels"])


def _averaged(table: np.ndarray, bucket: np.ndarray, starts: np.ndarray) -> np.ndarray:
    if len(starts) < 2:
        return np.zeros((0, table.shape[1]), dtype=np.float32)
    return np.add.reduceat(table.take(bucket, axis=0), starts[:-1], axis=0) * (np.float32(GAIN) / np.diff(starts).astype(np.float32))[:, None]


def _block(bucket: np.ndarray, starts: np.ndarray, labels: list[list[int]], subjects: int) -> dict[str, bytes]:
    """Training sentences as arrays: their buckets in order, and which sentences have each bucket, so that no step has to sort them again."""
    truth = np.zeros((len(labels), subjects), dtype=np.uint8)
    for i, own in enumerate(labels):
        truth[i, own] = 1
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    edge = np.flatnonzero(np.concatenate([[True], np.diff(ordered) > 0]))
    row = np.repeat(np.arange(len(labels)), np.diff(starts))[order]
    arrays = {"bucket": bucket, "starts": starts, "row": row, "edge": edge, "held": ordered[edge]}
    return {k: v.astype(BLOCK[k]).tobytes() for k, v in arrays.items()} | {"truth": truth.tobytes()}


#: What a block of at most BLOCK_ROWS training sentences holds.
BLOCK = {"bucket": np.uint16, "starts": np.int32, "row": np.uint16, "edge": np.int32, "held": np.uint16, "truth": np.uint8}
BLOCK_ROWS = 1 << 16


def _gradients(parameters, narrowed: bool, subjects: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The summed gradient of a partition. Narrowed: of a document's labels the likeliest counts on a sentence, if the model sees it there."""
    table, weight, bias = parameters
    total_t, total_w, total_b, n = np.zeros_like(table), np.zeros_like(weight), np.zeros_like(bias), 0
    for batch in batches:
        for r in batch.to_pylist():
            bucket, starts, row, edge, held, truth = (np.frombuffer(r[k], dtype=kind) for k, kind in BLOCK.items())
            truth = truth.reshape(-1, subjects).astype(np.float32)
            mean = _averaged(table, bucket, starts)
            p = 1 / (1 + np.exp(-(mean @ weight + bias)))
            if narrowed:
                own = truth * p
                truth *= (p > KEPT) & (own == own.max(axis=1, keepdims=True))
            error = (p - truth).astype(np.float32)
            total_w += mean.T @ error
            total_b += error.sum(axis=0)
            back = (error @ weight.T) * (np.float32(GAIN) / np.diff(starts).astype(np.float32))[:, None]
            total_t[held] += np.add.reduceat(back.take(row, axis=0), edge, axis=0)
            n += len(truth)
    blob = np.concatenate([total_t.ravel(), total_w.ravel(), total_b]).astype(np.float32).tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([blob], pa.binary())], names=["n", "gradient"])


def vocabulary(rows: DataFrame) -> np.ndarray:
    """For each hash bucket its number among the kept ones, or -1. Bucket 0, which every text has, is kept."""
    seen = rows.select(F.explode(F.array_distinct("buckets")).alias("bucket")).groupBy("bucket").count().where((F.col("count") >= LEAST_SEEN) & (F.col("bucket") > 0))
    kept = sorted(r["bucket"] for r in seen.orderBy(F.desc("count"), "bucket").limit(VOCABULARY - 1).collect())
    lookup = np.full(BUCKETS, -1, dtype=np.int32)
    lookup[[0, *kept]] = np.arange(len(kept) + 1)
    return lookup


def _kept(lookup: np.ndarray, bucket: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    number = lookup[bucket]
    keep = number >= 0
    return number[keep], np.concatenate([[0], np.cumsum(keep)])[starts]


def fit(rows: DataFrame, subjects: int, lookup: np.ndarray, *, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, weights and biases after synchronised steps: every partition's gradient is summed, then one step is made (Adam).

    ``rows`` are the blocks of ``numbered``; what comes back per step is one gradient a partition, whose size is fixed.
    """
    spark = rows.sparkSession
    rng = np.random.default_rng(seed)
    shapes = [(int(lookup.max()) + 1, WIDTH), (WIDTH, subjects), (subjects,)]
    parameters = [rng.normal(0, 0.05, shapes[0]).astype(np.float32), rng.normal(0, 0.5, shapes[1]).astype(np.float32), np.full(shapes[2], -2.0, dtype=np.float32)]
    ends = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for step in range(1, FIRST_STEPS + SECOND_STEPS + 1):
        sent = spark.sparkContext.broadcast(tuple(parameters))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, narrowed=step > FIRST_STEPS) -> Iterator[pa.RecordBatch]:
            yield from _gradients(sent.value, narrowed, subjects, batches)

        total, n = None, 0
        for r in rows.mapInArrow(run, "n bigint, gradient binary").collect():
            g = np.frombuffer(r["gradient"], dtype=np.float32)
            total = g.copy() if total is None else total + g
            n += r["n"]
        sent.destroy()
        if not n:
            break
        for i, g in enumerate(np.split(total / n, ends)):
            g = g.reshape(shapes[i]) + DECAY * parameters[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            parameters[i] = parameters[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return tuple(parameters)


def numbered(rows: DataFrame, lookup: np.ndarray, subjects: int) -> DataFrame:
    """The training sentences in blocks of arrays, with vocabulary numbers for buckets, others left out."""
    sent = rows.sparkSession.sparkContext.broadcast(lookup)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, BLOCK_ROWS) for b in batches for k in range(0, b.num_rows, BLOCK_ROWS)):
            lists = batch.column("buckets")
            number, starts = _kept(sent.value, lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets) - lists.offsets[0].as_py())
            own = _block(number, starts, batch.column("labels").to_pylist(), subjects)
            yield pa.RecordBatch.from_arrays([pa.array([own[k]], pa.binary()) for k in BLOCK], names=list(BLOCK))

    return cut(rows.mapInArrow(run, ", ".join(f"{k} binary" for k in BLOCK)))


def training_rows(seen: DataFrame, labels: DataFrame, names: list[str], model: sentences.Model, *, key: str, limit: int = TRAINING_DOCUMENTS) -> DataFrame:
    """``buckets, labels`` of the sentences of at most ``limit`` labelled documents. A document has every subject that a label gives it; 'none' gives none.

    ``seen`` has the observed documents with their texts.
    """
    spark = seen.sparkSession
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("subject")).cast("int") - 1
    per = labels.where(F.col(key).isNotNull() & F.col("subject").isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.array_sort(F.collect_set(F.when(number >= 0, number))).alias("labels"))
    few = per.orderBy(F.xxhash64("_k"), "_k").limit(limit)
    rows = seen.where("_kind IS NULL").join(F.broadcast(few), F.col(key) == F.col("_k")).select("_text", "_stops", "_events", "_longest", "labels").repartition(PARTS)
    sent = spark.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _training_rows(sentences.Model(**sent.value), batches)

    return cut(rows.mapInArrow(run, "buckets array<int>, labels array<int>"))


def scored(seen: DataFrame, parameters, lookup: np.ndarray, names: list[str], model: sentences.Model, *, key: str, share: float = SHARE) -> DataFrame:
    """``key, subject, share``: the subjects of at least ``share`` of a document's sentences, in one narrow pass over the observed documents.

    A sentence has every subject that the model gives at least even odds; outputs are independent. NULL and empty
    texts have no subject; repeated rows are scored each; NULL keys stay.
    """
    spark = seen.sparkSession
    table, weight, bias = parameters
    sent = spark.sparkContext.broadcast(((table @ weight).astype(np.float32), bias, lookup, vars(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits, bias, lookup, state = sent.value
        model = sentences.Model(**state)
        for batch in batches:
            for low, high, own, at in _pieces(model, batch, batch.column("_text").to_pylist()):
                if not own:
                    continue
                shown = _averaged(logits, *_kept(lookup, *features(own))) + bias >= 0
                n = np.diff(at)
                hits = np.diff(np.concatenate([np.zeros((1, len(names)), np.int64), np.cumsum(shown, axis=0)])[at], axis=0)
                a, b = np.nonzero((hits > 0) & (hits >= share * n[:, None]))
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(low, high - low).take(pa.array(a)), pa.array([names[i] for i in b], pa.string()), pa.array(hits[a, b] / n[a], pa.float64())], names=[key, "subject", "share"])

    rows = seen.where("_kind IS NULL").select(key, "_text", "_stops", "_events", "_longest")
    return rows.mapInArrow(run, f"`{key}` {seen.schema[key].dataType.simpleString()}, subject string, share double")
