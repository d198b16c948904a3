"""Evaluation texts leaking into training text, by template windows whose slots are then checked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.llm.codepoints import BREAK, DENSE, DIGIT, LETTER, UPPER, folded, joined, slices

#: Bounds of what one pass sends to the executors; more items make more passes over the documents.
BLOCK_ITEMS, BLOCK_CHARS = 4096, 4_000_000
#: Symbols of a template window where characters are words or syllables, and in alphabets; an item shorter than SHORT windows has windows of a quarter of its symbols.
DENSE_WINDOW, WINDOW, SHORT = 8, 16, 4
#: Share of the item that one passage has to hold, and words of which one may be altered or missing.
HELD, WORDS_PER_CHANGE = 0.5, 10
#: Letters of a word in writing without spaces, on average; only counts allowed changes.
DENSE_WORD = 2.2
#: Letters by which changed words may move the rest of a passage.
SHIFT = 16
NUMBER, NAME, UNIT = 1, 2, 3
_BITS = 22
# Units of measure that follow a number, in the corpus languages.
UNITS = ["km", "kg", "cm", "mm", "m", "g", "t", "km/h", "%", "percent", "prozent", "pourcent", "tonnes", "tons", "tonnen", "toneladas", "hours", "days", "euro", "euros", "dollars", "рублей", "тонн", "часов", "元", "亿元", "万元", "吨", "项", "人", "名", "台", "批", "米", "公里", "小时", "天", "件", "円", "人分", "トン"]


class Streams:
    """Letters and digits of a batch of texts, with the template: numbers and names as one typed placeholder each.

    A number is a run of digits, a name a capitalised word. ``at`` gives the place of each template
    symbol among the letters and digits, ``word`` the number of each letter's word.
    """

    def __init__(self, texts: list[str | None]):
        data, starts = joined(texts)
        fold, kind = folded(data)
        keep = (kind & (LETTER | DIGIT)) > 0
        stop = data == BREAK
        shown = np.flatnonzero(keep | stop)
        self.letters = np.where(stop[shown], 0, fold[shown]).astype(np.int64)
        k = kind[shown]
        digit, upper, dense = (k & DIGIT) > 0, (k & UPPER) > 0, (k & DENSE) > 0
        gap = np.ones(len(shown), dtype=bool)  # something visible or a space stands before
        if len(shown) > 1:
            seen = np.cumsum((kind & 16) == 0)
            gap[1:] = (seen[shown[1:]] - seen[shown[:-1]]) > 1
        before = np.concatenate([[True], stop[shown][:-1]])
        first = gap | before | (digit != np.concatenate([[False], digit[:-1]]))
        self.word = np.cumsum(first) - 1
        starts_of = np.flatnonzero(first)
        lower_next = np.zeros(len(shown), dtype=bool)
        lower_next[:-1] = ((k[1:] & LETTER) > 0) & ~upper[1:] & ~first[1:]
        named = (upper & lower_next)[starts_of][self.word] if len(starts_of) else np.zeros(0, dtype=bool)
        number = digit & ~named
        run = np.concatenate([[False], number[:-1]]) & number
        self.dense = dense
        symbol = np.where(stop[shown], 0, np.where(number, NUMBER, fold[shown] + 4)).astype(np.int64)
        self.first, self.number, self.named = first, number, named
        ends = np.flatnonzero(stop[shown])
        self.begin = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, dtype=np.int64)
        self.end = ends
        # Names are only known where case is: the template with names is joined beside the one that keeps their letters.
        self.templates = []
        for names in (False, True):
            if names:
                if not named.any():
                    continue
                symbol = np.where(named, NAME, symbol)
            at = np.flatnonzero(~run & ~(named & ~first)) if names else np.flatnonzero(~run)
            self.templates.append((names, at, symbol[at], dense[at] | (symbol[at] == NUMBER)))

    def widths(self) -> np.ndarray:
        """For each text the width of its windows: that of its script, or for a short text the power of two at a quarter of its letters, 2 at least."""
        out = []
        for a, b in zip(self.begin, self.end, strict=True):
            usual = DENSE_WINDOW if b > a and self.dense[a:b].mean() > 0.5 else WINDOW
            n = int(b - a)
            out.append(usual if n >= SHORT * usual else max(2, 1 << max(1, (max(n, 1) // 4).bit_length() - 1)))
        return np.array(out, dtype=np.int64)

    def windows(self, widths: set[tuple[int, bool]], names: tuple[bool, ...] = (False, True)) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place among the letters of every window of the (width, at letters of scripts without spaces) given, within one text.

        Windows of the usual widths begin at a letter of their kind of script, short ones anywhere.
        """
        parts: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for named, at, template, dense in self.templates:
            if named not in names:
                continue
            stops = np.cumsum(template == 0)
            rolled = _rolled(template)
            for width, short in widths:
                if width not in rolled or width == DENSE_WINDOW and not short and named:
                    continue
                h = rolled[width]
                n = len(h)
                ok = (stops[width - 1 :] == stops[:n]) & (template[:n] != 0)
                if not short:
                    ok &= dense[:n] == (width == DENSE_WINDOW)
                place = np.flatnonzero(ok)
                parts.append((h[place] ^ np.uint64(4 * width + 2 * short + named), at[place]))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _rolled(template: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of all windows of 2, 4, 8, ... symbols; each from two of half the width."""
    h = template.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x1234567)
    h ^= h >> np.uint64(29)
    size, out = 1, {}
    while size < max(DENSE_WINDOW, WINDOW) and len(h) > size:
        h = h[: len(h) - size] * np.uint64(0xBF58476D1CE4E5B9 + 2 * size) + h[size:]
        h ^= h >> np.uint64(31)
        size *= 2
        out[size] = h
    return out


USUAL = {(DENSE_WINDOW, False), (WINDOW, False)}


def _index(items: list[tuple[int, str]]) -> dict:
    s = Streams([t for _, t in items])
    widths = s.widths()
    sizes = s.end - s.begin
    dense = np.array([bool(b > a and s.dense[a:b].mean() > 0.5) for a, b in zip(s.begin, s.end, strict=True)], dtype=bool)
    usual = np.where(dense, DENSE_WINDOW, WINDOW)
    short = {(int(w), True) for w in np.unique(widths[sizes < SHORT * usual])}
    h, place = s.windows(USUAL | short)
    # A short item stands in the index with its own width only, a long one with the usual widths.
    owner = np.searchsorted(s.end, place)
    kinds = {w: s.windows({w})[0] for w in short}
    is_short = np.zeros(len(h), dtype=bool)
    mine = np.zeros(len(h), dtype=bool)
    for (w, _), own in kinds.items():
        inside = np.isin(h, own)
        is_short |= inside
        mine |= inside & (widths[owner] == w) & (sizes[owner] < SHORT * usual[owner])
    keep = np.where(is_short, mine, sizes[owner] >= SHORT * usual[owner])
    h, place, owner = h[keep], place[keep], owner[keep]
    order = np.argsort(h, kind="stable")
    bits = np.zeros(1 << _BITS, dtype=bool)
    bits[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
    place, owner = place[order], owner[order]
    return {
        "ids": np.array([i for i, _ in items], dtype=np.int64), "bits": np.packbits(bits), "hash": h[order], "item": owner, "place": place - s.begin[owner], "width": widths, "windows": USUAL | short, "short": sizes < SHORT * usual,
        "letters": [s.letters[a:b] for a, b in zip(s.begin, s.end, strict=True)], "word": [s.word[a:b] - (s.word[a] if b > a else 0) for a, b in zip(s.begin, s.end, strict=True)], "dense": dense,
    }


def _runs(item: np.ndarray, doc: np.ndarray, low: int, high: int, least: int) -> list[tuple[int, int, int]]:
    """Runs of at least ``least`` equal letters on the diagonals low..high (place in doc less place in item): (item place, doc place, size)."""
    n = len(item)
    padded = np.full(n + high - low, -1, dtype=np.int64)
    a, b = max(0, low), min(len(doc), n + high)
    if b > a:
        padded[a - low : b - low] = doc[a:b]
    same = np.lib.stride_tricks.sliding_window_view(padded, n)[: high - low + 1] == item[None, :]
    edge = np.zeros((same.shape[0], n + 2), dtype=np.int8)
    edge[:, 1:-1] = same
    step = np.diff(edge, axis=1)
    row, start = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    long = end - start >= least
    row, start, end = row[long], start[long], end[long]
    order = np.lexsort((row, start))
    return [(int(start[x]), int(start[x] + row[x] + low), int(end[x] - start[x])) for x in order]


def _held(item: np.ndarray, word: np.ndarray, dense: bool, runs: list[tuple[int, int, int]], short: bool = False) -> float:
    """The largest share of the item's letters and digits that stands in the document as one passage in the item's order.

    Equal runs are chained in both texts' order; what lies between two of them has to be altered or missing
    words, and of every WORDS_PER_CHANGE words of the passage one may be (in a passage of fewer words one as well, but not in a ``short`` item). Here the slots of the
    placeholders are compared by value: another number or name is an altered word.
    """
    best = max((r[2] for r in runs), default=0)
    for i, (a0, _, _) in enumerate(runs):
        cost = {i: 0.0}
        for j in range(i, len(runs)):
            if j not in cost:
                continue
            a, b, n = runs[j]
            words = (a + n - a0) / DENSE_WORD if dense else word[a + n - 1] - word[a0] + 1
            if cost[j] <= max(0.0 if short else 1.0, words // WORDS_PER_CHANGE if short else words / WORDS_PER_CHANGE):
                best = max(best, a + n - a0)
            for k in range(j + 1, len(runs)):
                a1, b1, n1 = runs[k]
                over = max(0, a + n - a1, b + n - b1)  # letters that both runs could have
                if over >= n1 or b1 + over > b + n + 40:
                    continue
                gap_a, gap_b = a1 + over - a - n, b1 + over - b - n
                if dense:
                    change = max(1.0, max(gap_a, gap_b) / 4)
                else:
                    change = float(max(1, word[a1 + over - 1] - word[a + n] + 1 if gap_a else 0, gap_b / 12))
                if cost[j] + change < cost.get(k, 1e9):
                    cost[k] = cost[j] + change
    return best / len(item)


def _bands(doc: np.ndarray, item: np.ndarray, at: np.ndarray, place: np.ndarray, begin: np.ndarray, sizes: np.ndarray, widths: np.ndarray, short: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Document, item and diagonals of each run of neighbouring diagonals whose seeds cover enough of the item.

    Changed words move the rest of a passage by up to SHIFT. A passage that holds half of an item has intact windows over
    well more than 0.4 of that half, even with the most changes. Of a short item one window is enough.
    """
    if not len(doc):
        return
    diagonal = at - begin[doc] - place
    code = doc * len(sizes) + item
    order = np.lexsort((diagonal, code))
    code, diagonal, place, item, doc = code[order], diagonal[order], place[order], item[order], doc[order]
    new = np.concatenate([[True], (np.diff(code) != 0) | (np.diff(diagonal) > SHIFT)])
    band = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    by = np.lexsort((place, band))
    p, width = place[by], widths[item[by]]
    step = np.concatenate([np.diff(p), [1 << 30]])
    step[np.concatenate([heads[1:] - 1, [len(p) - 1]])] = 1 << 30
    covered = np.add.reduceat(np.minimum(step, width), heads)
    good = np.flatnonzero(short[item[heads]] | (covered >= 0.4 * HELD * sizes[item[heads]]))
    tails = np.concatenate([heads[1:], [len(p)]]) - 1
    for g in good:
        yield int(doc[heads[g]]), int(item[heads[g]]), int(diagonal[heads[g]]), int(diagonal[tails[g]])


def _scan(index: dict, batches: Iterator[pa.RecordBatch], share: bool = False) -> Iterator[pa.RecordBatch]:
    bits = np.unpackbits(index["bits"]).astype(bool)
    hashes, items, places, letters = index["hash"], index["item"], index["place"], index["letters"]
    sizes, widths = np.array([len(x) for x in letters], dtype=np.int64), index["width"]
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for low, high in slices(texts):
            ids = batch.column("id").slice(low, high - low).to_pylist()
            s = Streams(texts[low:high])
            h, place = s.windows(index["windows"])
            maybe = np.flatnonzero(bits[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
            h, place = h[maybe], place[maybe]
            first, last = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            n = last - first
            which = np.repeat(np.arange(len(h)), n)
            row = np.repeat(first, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            out_d, out_i, out_s = [], [], []
            for d, i, lo, hi in _bands(np.searchsorted(s.end, place[which]), items[row], place[which], places[row], s.begin, sizes, widths, index["short"]):
                dense, best = bool(index["dense"][i]), 0.0
                text = s.letters[s.begin[d] : s.end[d]]
                # A repeated passage has seeds on many diagonals: it is looked at in bands that overlap.
                for band in range(lo, hi + 1, 8 * SHIFT):
                    runs = _runs(letters[i], text, band - SHIFT, min(hi, band + 8 * SHIFT) + SHIFT, min(int(widths[i]), 3 if dense else 5))
                    best = max(best, _held(letters[i], index["word"][i], dense, runs, bool(index["short"][i])))
                    if best >= 1:
                        break
                if share or best >= HELD:
                    out_d.append(ids[d])
                    out_i.append(int(index["ids"][i]))
                    out_s.append(best)
            yield pa.RecordBatch.from_arrays([pa.array(out_d, pa.int64()), pa.array(out_i, pa.int64()), pa.array(out_s, pa.float64())], names=["doc", "item", "held"])


def leaked(documents: DataFrame, items: DataFrame, *, key: str, text: str, item_key: str, item_text: str, share: bool = False) -> DataFrame:
    """``doc, item, held``: documents that hold at least HELD of an item as one passage.

    Both sides become templates, their windows are hash-joined inside one narrow pass over the documents, and
    the slots and letters around the joined windows decide. Items come in blocks of bounded size; each
    block is one pass. Items with the same passage all count. NULL keys are left out; NULL and empty texts
    hold nothing and are held nowhere; columns beyond those named are ignored.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    schema = "doc bigint, item bigint, held double"
    out = spark.createDataFrame([], schema)
    for own in _blocks(items, item_key, item_text):
        sent = spark.sparkContext.broadcast(_index(own))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            yield from _scan(sent.value, batches, share)

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out.groupBy("doc", "item").agg(F.max("held").alias("held"))


class Slotted:
    """The typed template of a batch of texts: ``symbol`` and ``slot`` (-1: none) of each place, one text after the other with 0 between.

    Numbers, names and the units behind numbers are one placeholder each; ``value`` gives what stands in a slot.
    """

    def __init__(self, texts: list[str | None]):
        s = Streams(texts)
        n = len(s.letters)
        self.letters = s.letters.astype(np.uint32)
        starts = np.flatnonzero(s.first)
        ends = np.append(starts[1:], n)
        symbol = np.where(s.letters == 0, 0, s.letters + 4)
        keep = np.ones(n, dtype=bool)
        kind = np.where(s.number[starts], NUMBER, np.where(s.named[starts], NAME, 0)) if n else np.zeros(0, np.int64)
        size = np.where(kind > 0, ends - starts, 0)
        for i in np.flatnonzero(np.append(False, kind[:-1] == NUMBER) & (kind == 0) & (symbol[starts] > 0)) if n else []:
            w = self._text(starts[i], ends[i])
            size[i] = len(w) if w in UNITS else max((len(u) for u in UNITS if w.startswith(u)), default=0) if s.dense[starts[i]] else 0
            kind[i] = UNIT if size[i] else 0
        slots = np.flatnonzero(kind > 0)
        inside = np.repeat(starts[slots], size[slots] - 1) + 1 + np.arange(int((size[slots] - 1).sum())) - np.repeat(np.cumsum(size[slots] - 1) - (size[slots] - 1), size[slots] - 1)
        keep[inside] = False
        symbol[starts[slots]] = kind[slots]
        number = np.full(n, -1, dtype=np.int64)
        number[starts[slots]] = np.arange(len(slots))
        self.symbol, self.slot = symbol[keep], number[keep]
        self.spans = np.stack([starts[slots], starts[slots] + size[slots]], axis=1)

    def _text(self, a: int, b: int) -> str:
        return "".join(map(chr, self.letters[a:b]))

    def value(self, slot: int) -> str:
        return self._text(*self.spans[slot])


def consistent(pairs: list[tuple[str, str]]) -> bool:
    """Whether slot values stand for one another one to one: the same value always becomes the same other value, and different ones different ones."""
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    return all(there.setdefault(a, b) == b and back.setdefault(b, a) == a for a, b in pairs)


def _variants(index: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for low, high in slices(texts, 300_000):
            ids = batch.column("id").slice(low, high - low).to_pylist()
            t = Slotted(texts[low:high])
            symbol, slot = t.symbol, t.slot
            stops = np.flatnonzero(symbol == 0)
            begins = np.concatenate([[0], stops[:-1] + 1]).astype(np.int64) if len(stops) else np.zeros(0, np.int64)
            found: dict[tuple[int, int], tuple[float, int]] = {}
            rolled = _rolled(symbol)
            for width, (hashes, item, place) in index["windows"].items():
                h = rolled.get(width, np.zeros(0, np.uint64))
                first, last = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
                n = last - first
                which = np.repeat(np.arange(len(h)), n)
                row = np.repeat(first, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                doc = np.searchsorted(stops, which)
                diagonal = which - begins[doc] - place[row]
                # One look per text, item and diagonal, however many windows lie on it.
                for d, i, shift in np.unique(np.stack([doc, item[row], diagonal], axis=1), axis=0).tolist():
                    mine, own = index["symbols"][i], index["slots"][i]
                    a, b = max(0, -shift), min(len(mine), int(stops[d] - begins[d]) - shift)
                    here = symbol[begins[d] + shift + a : begins[d] + shift + b]
                    same = np.concatenate([[False], here == mine[a:b], [False]]).astype(np.int8)
                    edge = np.flatnonzero(np.diff(same))
                    for x, y in zip(edge[::2] + a, edge[1::2] + a, strict=True):
                        if y - x < width or (y - x) / len(mine) <= found.get((d, i), (0.0, 0))[0]:
                            continue
                        both = [(own[k], t.value(slot[begins[d] + shift + k])) for k in range(x, y) if own[k]]
                        changed = sum(p != q for p, q in both)
                        if changed and consistent(both):
                            found[d, i] = ((y - x) / len(mine), changed)
            good = [(ids[d], int(index["ids"][i]), share, changed) for (d, i), (share, changed) in found.items() if share >= HELD]
            columns = list(zip(*good, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int32())], names=["doc", "item", "held", "changed"])


def _slot_index(items: list[tuple[int, str]]) -> dict:
    s = Slotted([t for _, t in items])
    symbol, slot = s.symbol, [s.value(k) if k >= 0 else "" for k in s.slot]
    stops = np.flatnonzero(symbol == 0)
    begins = np.concatenate([[0], stops[:-1] + 1]).astype(np.int64)
    sizes = stops - begins
    # Half an item in one piece has a whole window of the greatest power of two in it, up to WINDOW.
    width_of = np.array([min(WINDOW, 1 << max(1, (int(n) // 2).bit_length() - 1)) for n in sizes], dtype=np.int64)
    rolled, count, windows = _rolled(symbol), np.cumsum(symbol == 0), {}
    for width in np.unique(width_of[sizes > 1]).tolist():
        h = rolled.get(width, np.zeros(0, np.uint64))
        owner = np.searchsorted(stops, np.arange(len(h)))
        place = np.flatnonzero((symbol[: len(h)] != 0) & (count[: len(h)] == count[width - 1 : width - 1 + len(h)]) & (width_of[np.minimum(owner, len(stops) - 1)] == width))
        order = place[np.argsort(h[place], kind="stable")]
        windows[width] = (h[order], owner[order], order - begins[owner[order]])
    return {"ids": np.array([i for i, _ in items], dtype=np.int64), "windows": windows, "symbols": [symbol[a:b] for a, b in zip(begins, stops, strict=True)], "slots": [slot[a:b] for a, b in zip(begins, stops, strict=True)]}


def _blocks(items: DataFrame, item_key: str, item_text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size."""
    clean = items.select(F.col(item_key).cast("bigint").alias("id"), F.col(item_text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL").distinct()
    n, chars = clean.agg(F.count("*"), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    for k in range(blocks):
        own = clean if blocks == 1 else clean.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k)
        yield [(r["id"], r["text"]) for r in own.collect()]


def reworded(documents: DataFrame, items: DataFrame, *, key: str, text: str, item_key: str, item_text: str) -> DataFrame:
    """``doc, item, held, changed``: documents with at least HELD of an item's template in one piece, but with other numbers, names or units in ``changed`` of its slots.

    Template windows are hash-joined inside one narrow pass and grown to the longest equal stretch of
    templates; there the slots have to be consistent: each value of the item stands for one value of the document
    and the other way round, as in a question with new parameters. Items and documents are cleaned as in ``leaked``.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    schema = "doc bigint, item bigint, held double, changed int"
    out = spark.createDataFrame([], schema)
    for own in _blocks(items, item_key, item_text):
        if not own:
            continue
        sent = spark.sparkContext.broadcast(_slot_index(own))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            yield from _variants(sent.value, batches)

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out.groupBy("doc", "item").agg(F.max(F.struct("held", "changed")).alias("m")).select("doc", "item", "m.held", "m.changed")
