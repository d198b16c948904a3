"""Sentence boundaries across languages and scripts, by a hidden-event n-gram language model.

Between two words stands a hidden event, boundary or none. The model knows how likely a boundary is
after a left word (with its mark), how much likelier a right word is after a boundary than after
none, and how events follow one another at a distance. It is counted over all different texts (one that stands in
several rows tells no more than one that stands in one): the ends and starts of lines and rows are observed boundaries, the events inside them are estimated. Forward-backward posteriors over a line decide.

Every gap between words, or letters of a script without spaces, is looked at; the words that stand before
and after boundaries elsewhere decide, weighed by how likely a stretch of its length is to be text
without marks. That is counted, too: where sentences are marked, long stretches without any punctuation are
rare. In stretches longer than PLAIN gaps are events like marks, others are decided each by itself. Inside
quotations and beside commas, brackets and the like no gap ends a sentence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.text import INVISIBLE, INVISIBLE_RANGES, SPACE_RANGES, SPACES, char_class
from glyphloom.functions.workers import per_process
from glyphloom.llm.codepoints import joined
from glyphloom.plans.materialise import cut

#: Words that have statistics of their own are those seen this often, the most frequent ones up to a bound on what is sent to every worker; others share those of their shape.
LEAST_SEEN, MOST_WORDS = 3, 200_000
ROUNDS = 3
#: How far a right word may move an event.
MOST_ODDS = 4.0
#: Occurrences by which a right word is drawn to its shape.
SHRINK = 8.0
#: Occurrences by which a left word is drawn to its shape.
DRAW = 20.0
#: An end mark tells its script's rate of line ends if it has this many events inside lines and this share of its script's; rarer ones, brackets mostly, may stand at line ends alone.
LEAST_INSIDE, LEAST_SHARE = 30, 0.01
#: The widths that a hard wrap is believed to have.
NARROWEST_WRAP, WIDEST_WRAP = 30, 120
#: Characters that a stretch runs on without any punctuation before it surely is text without marks and all its gaps are events: in alphabets, in scripts without spaces.
PLAIN, PLAIN_DENSE = 240, 120
#: How far one word may move an event of a stretch without punctuation, and a word longer than this counts by its shape.
MOST_GAP_ODDS, LONGEST_WORD = 50.0, 64
_US = "\x1f"

# End marks, quotation marks in pairs, closing marks.
STRONG = "。｡！？!?।॥؟۔"
WEAK = ".．…"
QUOTED = re.compile(r"“[^”“„]*”|„[^“”„]*[“”]|«[^«»]*»|「[^「」]*」|『[^『』]*』|\"[^\"]*\"")
CLOSERS = "”’」』）)】》〉»"
#: Letters of scripts written without spaces.
DENSE_RANGES = [(0xE00, 0xE7F), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3041, 0x31FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F)]
_DENSE = char_class(DENSE_RANGES)[1:-1]
_INV = INVISIBLE[1:-1]
_SP = SPACES[1:-1]
MARKS = re.compile(f"[{STRONG}{WEAK}][{STRONG}{WEAK}{_INV}]*(?:[{_INV}]*[{CLOSERS}])*")
# The search skips to where a pattern may begin if that begins with one set of characters, not with a repeated one.
GAPS = re.compile(f"[{_SP}][{_SP}]*(?=[{_DENSE}0-9０-９A-Za-z“「（])")
QUOTE = re.compile("[”“«「『\"]")
BLANKS = frozenset(chr(c) for ranges in (SPACE_RANGES, INVISIBLE_RANGES) for a, b in ranges for c in range(a, b + 1))
BLANK = re.compile(rf"[{_SP}{_INV}]*")
LINES = re.compile(r"[\n\r\x0b\x0c\x85\u2028\u2029](?:(?<=\r)\n)?")
LEFT = re.compile(rf"[\w{_INV}]+(?:\.[\w{_INV}]+)*\Z")
RIGHT = re.compile(r"\w+")
DENSE = re.compile(f"[{_DENSE}]")
HIDDEN = re.compile(INVISIBLE)
ALPHA = re.compile(r"[^\W\d_]")
SPACE = re.compile(rf"[{_SP}][{_SP}]*")
LETTERS = re.compile(rf"[^\W\d_{_DENSE}][^\W\d_{_DENSE}]*")
#: Anything that is neither a letter, a digit nor white space.
PUNCTUATION = re.compile(rf"[^\w{_SP}{_INV}\u0300-\u036f\u064b-\u0652\u0900-\u0903\u093a-\u094f\u0e31\u0e34-\u0e3a\u0e47-\u0e4e]|_")
# First and last code point of a script and its letter here.
SCRIPTS = [(0x400, 0x52F, "y"), (0x620, 0x6FF, "a"), (0x900, 0x963, "h"), (0x971, 0x97F, "h"), (0xE00, 0xE7F, "t"), (0x3041, 0x30FF, "j"), (0xFF66, 0xFF9F, "j"), (0x2E80, 0x2FDF, "z"), (0x3005, 0x3007, "z"), (0x3400, 0x9FFF, "z"), (0xF900, 0xFAFF, "z")]
_SCRIPT: dict[str, str] = {}


def script(c: str) -> str:
    known = _SCRIPT.get(c)
    if known is None:
        x = ord(c)
        known = "0" if c.isdigit() else next((n for a, b, n in SCRIPTS if a <= x <= b), "l" if c.isalpha() else ",")
        _SCRIPT[c] = known
    return known


@dataclass(slots=True)
class Segment:
    """A line, or a paragraph of a hard-wrapped text, with its candidates: where each ends, and left word, left shape, right word, right shape and distance class in one string."""

    begin: int
    end: int
    stops: list[int] = field(default_factory=list)
    events: list[str] = field(default_factory=list)
    first: tuple[str, str] = ("", "")
    last: tuple[str, str] = ("", "")
    #: The words before and after plain boundaries.
    before: list[str] = field(default_factory=list)
    after: list[str] = field(default_factory=list)


def is_wrapped(lines: list[str]) -> bool:
    """Whether single line breaks come from wrapping at one width.

    There has to be a width that (but for a few lines changed later) no line exceeds and that no broken line
    had room in for the next line's first word, and some lines have to end in mid-sentence.
    """
    seen = [(x if x.isascii() else HIDDEN.sub("", x)).rstrip() for x in lines]
    if not any(map(all, zip(seen, seen[1:], strict=False))):
        return False
    sizes, bounds, inside = [len(x) for x in seen if x], [], 0
    for a, b in zip(seen, seen[1:], strict=False):
        if not a or not b:
            continue
        if b[0].isspace():
            return False
        dense = DENSE.match(b) is not None
        bounds.append((len(a), len(a) + (3 if dense else 1 + len(b.split(None, 1)[0]))))
        inside += a[-1] not in STRONG + WEAK + CLOSERS
    if not bounds or inside * 3 < len(bounds) or dense and len(bounds) < 3:
        return False
    best = 0.0
    for width in {a for a, _ in bounds if NARROWEST_WRAP <= a <= WIDEST_WRAP}:
        if sum(x > width for x in sizes) <= len(sizes) // 10:
            best = max(best, sum(a <= width < b for a, b in bounds) / len(bounds))
    return best >= 0.8


#: Right words of two letters, left words that are end marks or stand before periods, and whether characters are letters of scripts without spaces; they come again and again.
_DENSE_WORDS: dict[tuple[str, str], tuple[str, str]] = {}
_MARK_WORDS: dict[tuple[str, str], tuple[str, str]] = {}
_PERIOD_WORDS: dict[tuple[str, str, str], tuple[str, str]] = {}
_SOLID_LETTERS: dict[str, bool] = {}


def is_solid(c: str) -> bool:
    known = _SOLID_LETTERS.get(c)
    if known is None:
        known = _SOLID_LETTERS[c] = DENSE.match(c) is not None
    return known


def right_word(text: str, at: int, end: int, own: str) -> tuple[str, str]:
    """The word after a candidate and its shape, both under the script of the line, so that scripts don't outweigh one another."""
    key = (own, text[at : min(at + 2, end)])
    known = _DENSE_WORDS.get(key)
    if known is None:
        word, shape = _right_word(text, at, end)
        known = (own + word, own + shape) if word else ("", "")
        if shape in ("t", "j", "z") and len(_DENSE_WORDS) < 100_000:
            _DENSE_WORDS[key] = known
    return known


def _right_word(text: str, at: int, end: int) -> tuple[str, str]:
    c = text[at] if at < end else ""
    if not c:
        return "", ""
    kind = script(c)
    if kind in "tjz":
        return text[at : min(end, at + 2)], kind
    if kind == ",":
        return c, c if c in "“«„「『（(¿¡\"" else ","
    word = RIGHT.match(text, at, end)[0]
    if kind == "0":
        numbered = text[at + len(word) : at + len(word) + 1] in (")", "）", ".", "．", "、") and len(word) <= 3
        return ("0)", "0)") if numbered else ("0", "0")
    shape = kind + ("A" if c.isupper() else "a" if c.islower() else "")
    return (word if len(word) <= LONGEST_WORD else shape), shape


def _word_before(text: str, begin: int, at: int) -> str:
    """The word that ends at ``at``, of at most LONGEST_WORD characters and one more; most words are found in the first, short look."""
    low = max(begin, at - 16)
    near = text[low:at].rsplit(None, 1)
    if near and near[-1].isalpha() and (low == begin or len(near) > 1) and not text[at - 1].isspace():
        return near[-1]
    m = LEFT.search(text, low, at)
    if m and m.start() == low > begin:
        m = LEFT.search(text, max(begin, at - LONGEST_WORD - 1), at)
    return HIDDEN.sub("", m[0]) if m else ""


def left_word(text: str, begin: int, at: int, mark: str, closed: bool, first: bool, opened: str, own: str) -> tuple[str, str]:
    """The word before a mark, and its shape: kind of mark, script, and for periods the look of the word."""
    plain = mark if len(mark) == 1 else HIDDEN.sub("", mark).rstrip(CLOSERS)
    if opened:
        kind = "q" if first else "Q"
        return f"{kind}{own}{opened}{plain[-1:]}", f"{kind}{own}{opened}"
    tail = ")" if closed else ""
    if not all(c in WEAK for c in plain):
        return f"!{own}{plain[-1:]}{tail}", f"!{own}{tail}"
    if len(plain) > 1 or plain == "…":
        return f"…{own}{tail}", f"…{own}{tail}"
    word = _word_before(text, begin, at)
    known = _PERIOD_WORDS.get((own, tail, word))
    if known is None:
        known = _period_word(word, own, tail)
        if len(_PERIOD_WORDS) < 100_000:
            _PERIOD_WORDS[own, tail, word] = known
    return known


def _period_word(word: str, own: str, tail: str) -> tuple[str, str]:
    if word[:1].isdigit() or word[-1:].isdigit():
        look = "#"
    elif "." in word:
        look = "p"
    elif len(word) == 1:
        look = "i" if word.isupper() else "1"
    else:
        look = ("A" if word[:1].isupper() else "a") + ("3" if len(word) <= 3 else "5" if len(word) <= 5 else "9")
    shape = f".{own}{look}{tail}"
    return (f".{own}{word.lower()}{tail}" if 0 < len(word) <= LONGEST_WORD and look != "#" else shape), shape


def segments(text: str) -> list[Segment]:
    out: list[Segment] = []
    spans: list[tuple[int, int]] = []
    lines, at = [], 0
    for m in LINES.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    if len(lines) > 1 and is_wrapped([text[a:b] for a, b in lines]):
        for a, b in lines:
            blank = BLANK.match(text, a, b).end() == b
            if blank:
                spans.append((-1, -1))
            elif spans and spans[-1][0] >= 0:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
        spans = [s for s in spans if s[0] >= 0]
    else:
        spans = lines
    for a, b in spans:
        a = BLANK.match(text, a, b).end()
        if a >= b:
            continue
        while b > a and text[b - 1] in BLANKS:
            b -= 1
        if a < b:
            out.append(_segment(text, a, b))
    return out


def gram_before(text: str, at: int) -> str:
    """The word that ends at ``at``, or two letters of a script without spaces."""
    if at and is_solid(text[at - 1]):
        return text[max(0, at - 2) : at]
    return _word_before(text, 0, at).lower()


def gram_after(text: str, at: int) -> str:
    """The word that begins at ``at``, or two letters of a script without spaces."""
    if at < len(text) and is_solid(text[at]):
        return text[at : at + 2]
    m = RIGHT.match(text, at, at + LONGEST_WORD)
    return m[0].lower() if m else ""


def _gaps(text: str, begin: int, end: int, own: str) -> list[tuple[int, int, str, bool, str]]:
    """All gaps between words of a long stretch; none if it has punctuation."""
    dense = own in "tjz"
    if PUNCTUATION.search(text, begin, end):
        return []
    places = [i for i in range(begin + 2, end - 1) if text[i].isalpha() and is_solid(text[i]) and is_solid(text[i - 1])] if dense else [m.start() for m in SPACE.finditer(text, begin + 1, end - 1)]
    return [(i, i, "", False, "w") for i in places]


def _segment(text: str, begin: int, end: int) -> Segment:
    seg = Segment(begin, end)
    m = ALPHA.search(text, begin, end)
    own = script(m[0]) if m else ","
    flat = own in "ly" and text[begin:end].islower()  # then a small letter says nothing
    seg.first = right_word(text, begin, end, own)
    quotes = [m.span() for m in QUOTED.finditer(text, begin, end)] if QUOTE.search(text, begin, end) else []
    marked = False
    q, quoted, fresh, previous = 0, len(quotes), begin, begin
    raw: list[tuple[int, int, str, bool, str]] = []
    events = [(*m.span(), m[0]) for m in MARKS.finditer(text, begin, end)]
    if own in "tjz":
        # White space is a candidate between letters of scripts that write without it; a digit may stand on one side.
        gaps = [m.span() for m in GAPS.finditer(text, begin, end)]
        gaps = [(a, b) for a, b in gaps if is_solid(text[a - 1]) or (text[a - 1].isdigit() or text[a - 1] in BLANKS) and not text[b].isascii() and not text[b].isdigit()]
        if gaps:
            events = sorted(events + [(a, b, " ") for a, b in gaps])
    for a, b, mark in events:
        while q < quoted and quotes[q][1] <= a:
            q += 1
        if q < quoted and quotes[q][0] < a:
            # Inside a quotation; only marks right before its end can close a sentence, together with it.
            close = quotes[q][1]
            rest = HIDDEN.sub("", text[b:close]).strip()
            if mark[0] in STRONG + WEAK and (b >= close or rest in ("”", "“", "»", "」", "』", '"')):
                stop = max(b, close)
                opener = text[quotes[q][0]]
                raw.append((a, stop, mark, HIDDEN.sub("", text[fresh : quotes[q][0]]).strip() == "", opener))
                fresh = stop
            continue
        if mark[0] in STRONG:
            marked = True
            raw.append((a, b, mark, False, ""))
            fresh = b
        elif mark[0] in WEAK:
            plain = mark if len(mark) == 1 else HIDDEN.sub("", mark)
            nxt = text[b] if b < end else ""
            if plain in (".", "．"):
                if nxt and (nxt.isdigit() or nxt.islower()) and not nxt.isspace():
                    continue
                if nxt.isalpha() and text[a - 1 : a].isdigit():
                    continue
            marked = True
            raw.append((a, b, mark, False, ""))
            fresh = b
        else:
            raw.append((a, a, " ", False, " "))
    long = PLAIN_DENSE if own in "tjz" else PLAIN
    if end - begin > long:
        at, more = begin, []
        for r in raw:
            if r[0] - at > long:
                more += _gaps(text, at, r[0], own)
            at = r[1]
        if end - at > long:
            more += _gaps(text, at, end, own)
        if more:
            raw = sorted(raw + more)
    for a, stop, mark, first, opened in raw:
        nxt = stop
        while nxt < end and text[nxt] in BLANKS:
            nxt += 1
        if not opened:
            left = _MARK_WORDS.get((own, mark))
            if left is None:
                left = left_word(text, begin, a, mark, mark[-1] in CLOSERS, False, "", own)
                if left[1][0] != "." and len(_MARK_WORDS) < 100_000:
                    _MARK_WORDS[own, mark] = left
            shape = left[1]
            if shape[0] == "!" or shape[2:4] in ("a5", "a9"):
                seg.before.append(gram_before(text, a))
                if nxt < end:
                    seg.after.append(gram_after(text, nxt))
        elif opened == " ":
            kind = "S" if marked else "s"
            left = (f"{kind}{own}", f"{kind}{own}")
        elif opened == "w":
            left = (f"w{own}{gram_before(text, a)}", f"w{own}")
        else:
            left = left_word(text, begin, a, mark, mark[-1] in CLOSERS, first, opened, own)
        if nxt >= end:
            seg.last = left
            continue
        r = right_word(text, nxt, end, own)
        if flat and r[1][1:] in ("la", "ya"):
            r = (r[0], r[1][:2] + "A")
        d = stop - previous
        seg.stops.append(stop)
        seg.events.append(_event((stop, *left, *r, 0 if d <= 4 else 1 if d <= 12 else 2)))
        previous = stop
    if not seg.last[0]:
        kind = "S" if marked else "s"
        c = text[end - 1]
        if is_solid(c):
            seg.last = (f"{kind}{own}", f"{kind}{own}")
    return seg


def local_guess(left: str, shape: str, right_shape: str) -> float:
    """Where expectation maximisation starts for an event that no line end shows; the line ends then correct it."""
    if left[0] in "!":
        return 0.95
    if left[0] == "w":
        return 0.02
    if left[0] == "Q":
        return 0.7
    if left[0] == "q":
        return 0.1
    if left[0] == "s":
        return 0.9
    if left[0] == "S":
        return 0.3
    return 0.02 if right_shape[1:] in ("la", "ya", "0", ",") else 0.5


def _event(c: tuple[int, str, str, str, str, int]) -> str:
    return f"{c[1]}{_US}{c[2]}{_US}{c[3]}{_US}{c[4]}{_US}{c[5]}"


_MARK, _WHITE, _WORD, _STARTS, _SOLID, _STRONG, _WEAK = 1, 2, 4, 8, 16, 32, 64


def _kind(c: str) -> int:
    if PUNCTUATION.match(c):
        return _MARK | _STRONG * (c in STRONG) | _WEAK * (c in WEAK)
    if SPACE.match(c):
        return _WHITE
    return 0 if HIDDEN.match(c) else _WORD | _STARTS * c.isalnum() | _SOLID * bool(DENSE.match(c))


def _kinds(data: np.ndarray) -> np.ndarray:
    table = per_process("sentence_kinds", lambda: np.array([_kind(chr(i)) for i in range(0x10000)], dtype=np.uint8))
    kind = table.take(np.minimum(data, 0xFFFF))
    beyond = np.flatnonzero(data > 0xFFFF)
    for c in np.unique(data[beyond]).tolist():
        kind[beyond[data[beyond] == c]] = _kind(chr(c))
    return kind


@dataclass(slots=True)
class Runs:
    """The stretches without punctuation of several texts, none across the end of a line or an event.

    ``places`` of all letters and digits; each stretch is those from ``head`` to before ``tail``. Sizes are in characters, one of a
    script without spaces (``close``) for PLAIN / PLAIN_DENSE; ``marked``: whether its line has end marks.
    """

    kind: np.ndarray
    places: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    close: np.ndarray
    size: np.ndarray
    marked: np.ndarray
    text: np.ndarray

    def longest(self, n: int) -> np.ndarray:
        out = np.zeros(n, dtype=np.int32)
        np.maximum.at(out, self.text, self.size.astype(np.int32))
        return out


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lines: np.ndarray) -> Runs:
    """Stretches of ``joined`` texts; ``ends`` of stretches and of lines are places in all of them."""
    kind = _kinds(data)
    new = (kind & _MARK).astype(bool)
    new[ends] = True
    places = np.flatnonzero(kind & _WORD)
    head = np.searchsorted(places, np.flatnonzero(new))
    head = np.concatenate([[0], head])[np.append(True, np.diff(head, prepend=0) > 0)]
    head = head[head < len(places)]
    tail = np.append(head[1:], len(places)).astype(np.int64) if len(head) else head
    solid = (kind[places] & _SOLID) > 0
    close = 2 * np.add.reduceat(solid, head, dtype=np.int64) >= tail - head if len(head) else np.zeros(0, dtype=bool)
    size = (places[tail - 1] - places[head] + 1) * np.where(close, PLAIN // PLAIN_DENSE, 1)
    strong, weak = np.flatnonzero(kind & _STRONG), np.flatnonzero(kind & _WEAK)
    weak = weak[(kind[np.minimum(weak + 1, len(kind) - 1)] & _WORD == 0) | (weak + 1 == len(kind))]  # not the dots of numbers and the like
    bounds = np.append(0, lines)
    before = np.searchsorted(strong, bounds) + np.searchsorted(weak, bounds)
    line = np.searchsorted(lines, places[head], side="right")
    return Runs(kind, places, head, tail, close, size, before[line + 1] > before[line], np.searchsorted(starts, places[head], side="right") - 1)


def run_ends(starts: np.ndarray, sizes: list[int], stops: list[int], events: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches and where lines of joined texts end (``sizes``: where a text's events begin). Events other than gaps end a stretch, white space in scripts written without it included."""
    first = np.fromiter((0 if not e else 2 if e[0] == "w" else 1 for e in events), dtype=np.int8, count=len(events))
    at = np.asarray(stops, dtype=np.int64) + np.repeat(starts[: len(sizes)], np.diff(np.append(sizes, len(events))))
    return at[first < 2], at[first == 0]


class _Counts:
    """What a task has counted: pairs of words around events, how guessed events follow one another, words at plain boundaries and anywhere, and stretches without punctuation by size.

    ``add`` cuts a text, the rest is counted for a batch of texts at once.
    """

    def __init__(self) -> None:
        self.events: Counter = Counter()
        self.edges: Counter = Counter()
        self.steps: Counter = Counter()
        self.words: Counter = Counter()
        self.before: Counter = Counter()
        self.after: Counter = Counter()
        self.runs: Counter = Counter()

    def add(self, text: str, weight: float = 1) -> tuple[list[int], list[str]]:
        """Counts the ends of a text's lines and its plain boundaries, by its weight; its events and ends in order: places, and the words around each, an empty string at the end of a line."""
        stops: list[int] = []
        events: list[str] = []
        before: list[str] = []
        after: list[str] = []
        for s in segments(text):
            if s.last[0]:
                self.edges["e", *s.last] += weight
            if s.first[0]:
                self.edges["b", *s.first] += weight
            stops += s.stops
            stops.append(s.end)
            events += s.events
            events.append("")
            before += s.before
            after += s.after
        for counted, words in ((self.before, before), (self.after, after)):
            for w in words:
                counted[w] += weight
        return stops, events

    def add_events(self, weights: list[float], sizes: list[int], events: pa.StringArray) -> None:
        """Counts all events of the texts (``sizes``: where a text's events begin) and how they follow one another in a line, by the weight of each text."""
        coded = events.dictionary_encode()
        if not len(coded):
            return
        code, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        weight = np.repeat(np.asarray(weights, dtype=float), np.diff([*sizes, len(code)]))
        for e, n in zip(words, np.bincount(code, weights=weight, minlength=len(words)).tolist(), strict=True):
            self.events[e] += n
        guesses, distance = np.ones(len(words)), np.zeros(len(words), dtype=np.int64)
        for i, e in enumerate(words):
            if e:
                l, ls, _, rs, d = e.split(_US)
                guesses[i], distance[i] = local_guess(l, ls, rs), int(d)
        values, guess = np.unique(guesses, return_inverse=True)  # 1, that of the start of a line, is the last
        own = guess[code]
        step = (np.append(len(values) - 1, own[:-1]) * 3 + distance[code]) * len(values) + own
        inside = code != (words.index("") if "" in words else -1)
        counts = np.bincount(step[inside], weights=weight[inside], minlength=3 * len(values) ** 2)
        for i in np.flatnonzero(counts).tolist():
            before, now = divmod(i, len(values))
            self.steps[float(values[before // 3]), before % 3, float(values[now])] += counts[i]

    def add_words(self, texts: list[str | None], weights: list[float], sizes: list[int], stops: list[int], events: list[str]) -> np.ndarray:
        """Counts all words of the texts, all pairs of neighbouring letters of scripts without spaces and all stretches, by the weight of each text; the size of each text's longest stretch."""
        alike: dict[float, list[str]] = {}
        for t, w in zip(texts, weights, strict=True):
            if t:
                alike.setdefault(w, []).append(t)
        for weight, some in alike.items():
            words = chain.from_iterable(map(LETTERS.findall, map(str.lower, some)))
            if weight == 1:
                self.words.update(words)
            else:
                for w, k in Counter(words).items():
                    self.words[w] += k * weight
        data, starts = joined(texts)
        found = runs(data, starts, *run_ends(starts, sizes, stops, events))
        own = np.asarray(weights, dtype=float)
        dense = (found.kind & _SOLID) > 0
        two = np.flatnonzero(dense[:-1] & dense[1:])
        codes = data[two] << np.uint32(16) | data[two + 1]  # all of them are in the first plane
        if (own == 1).all():
            pairs, n = np.unique(codes, return_counts=True)
        else:
            pairs, which = np.unique(codes, return_inverse=True)
            n = np.bincount(which, weights=own[np.searchsorted(starts, two, side="right") - 1], minlength=len(pairs))
        for p, k in zip(pairs.tolist(), n.tolist(), strict=True):
            self.words[p] += k
        n = np.bincount(found.close * (PLAIN + 2) + np.minimum(found.size, PLAIN + 1), weights=own[found.text], minlength=2 * (PLAIN + 2))
        for i in np.flatnonzero(n).tolist():
            self.runs["ds"[i < PLAIN + 2], i % (PLAIN + 2)] += n[i]
        return found.longest(len(texts))

    def rows(self) -> list[tuple[str, str, str, str, float]]:
        """``kind, l, ls, r, rs`` joined in one tuple with the count, and an empty memory."""
        self.events.pop("", None)
        out = [("p", *e.split(_US)[:4], float(n)) for e, n in self.events.items()]
        out += [("p", l, ls, "", "", float(n)) if k == "e" else ("p", "", "", l, ls, float(n)) for (k, l, ls), n in self.edges.items()]
        for (before, d, now), n in self.steps.items():
            for e, p in ((1, before), (0, 1 - before)):
                out += [("f", str(e), str(d), str(v), "", n * p * q) for v, q in ((1, now), (0, 1 - now))]
        out += [("T", w if isinstance(w, str) else chr(w >> 16) + chr(w & 0xFFFF), "", "", "", float(n)) for w, n in self.words.items()]
        out += [(k, w, "", "", "", float(n)) for k, counted in (("F", self.before), ("S", self.after)) for w, n in counted.items() if w]
        out += [("L", k, str(size), "", "", float(n)) for (k, size), n in self.runs.items()]
        self.__init__()
        return out

    def size(self) -> int:
        return len(self.events) + len(self.words) + len(self.before) + len(self.after) + len(self.edges)


_STATISTICS = ["_kind", "_l", "_ls", "_r", "_rs", "_n"]


def observed(rows: DataFrame, *, keys: list[str], text: str, keep_text: bool = True) -> DataFrame:
    """The one pass that cuts the texts into words: a row per row of ``rows`` with its events, and rows of counts (those have ``_kind``).

    Each of n rows with equal texts counts 1/n, so that copies don't make rare words look well known; the hashes of texts that
    several rows have are found before.

    ``keys, _stops, _events, _longest`` (the size of the longest stretch without punctuation) and ``_text``, which ``sentence_ends`` needs.
    Written to the shared folder: the model is fitted on the counts and then decides the events, so no text is cut into words twice.
    """
    plain = rows.select(*keys, F.col(text).alias("_text"))
    types = [(f.name, f.dataType.simpleString()) for f in plain.schema if keep_text or f.name != "_text"]
    schema = ", ".join(f"`{n}` {t}" for n, t in types) + ", _stops array<int>, _events array<string>, _longest int, _kind string, _l string, _ls string, _r string, _rs string, _n double"
    kept = [n for n, _ in types]
    own_hash = F.xxhash64("_text").alias("_hash")
    copies = cut(plain.where("_text <> ''").groupBy(own_hash).agg(F.count("*").alias("_copies")).where("_copies > 1"))
    plain = plain.select("*", own_hash).join(copies, "_hash", "left").drop("_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kinds = _Counts(), None

        def statistics() -> pa.RecordBatch:
            own = list(zip(*counts.rows(), strict=True)) or [()] * 6
            n = len(own[0])
            nothing = [pa.nulls(n, k) for k in kinds] + [pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.int32())]
            return pa.RecordBatch.from_arrays(nothing + [pa.array(c, pa.string()) for c in own[:5]] + [pa.array(own[5], pa.float64())], names=[*kept, "_stops", "_events", "_longest", *_STATISTICS])

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in kept]
            texts = batch.column("_text").to_pylist()
            weights = [1 if n is None else 1 / n for n in batch.column("_copies").to_pylist()]
            at = 0
            while at < len(texts):
                # Few characters at a time, so that long texts don't multiply a batch's memory.
                stops, events, sizes, low, chars = [], [], [0], at, 0
                while at < len(texts) and chars < 2_000_000:
                    t = texts[at] or ""
                    own = counts.add(t, weights[at])
                    stops += own[0]
                    events += own[1]
                    sizes.append(len(stops))
                    chars += len(t)
                    at += 1
                coded = pa.array(events, pa.string())
                counts.add_events(weights[low:at], sizes[:-1], coded)
                longest = counts.add_words(texts[low:at], weights[low:at], sizes[:-1], stops, events)
                part = batch.slice(low, at - low)
                offsets = pa.array(sizes, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(stops, pa.int32())), pa.ListArray.from_arrays(offsets, coded), pa.array(longest, pa.int32())]
                none = [pa.nulls(part.num_rows, pa.string())] * 5 + [pa.nulls(part.num_rows, pa.float64())]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + lists + none, names=[*kept, "_stops", "_events", "_longest", *_STATISTICS])
                if counts.size() > 300_000:
                    yield statistics()
        if kinds is not None:
            yield statistics()

    return cut(plain.mapInArrow(run, schema))


@dataclass
class Model:
    """``boundary``: P(boundary | left word, a right word that may begin a sentence); ``odds``: how much likelier a right word is after a boundary.

    ``last`` and ``start``: by how much a word before, after a gap moves an event without a mark; ``gap``: the odds it starts from in text without marks;
    ``unmarked``: by the kind of a stretch without punctuation (d: scripts without spaces, s: others; capitals: in lines that have end marks) and its size, how likely it is such text.
    """

    boundary: dict[str, float]
    odds: dict[str, float]
    follow: dict[tuple[int, int], tuple[float, float]]
    last: dict[str, float] = field(default_factory=dict)
    start: dict[str, float] = field(default_factory=dict)
    gap: float = 0.01
    unmarked: dict[str, list[float]] = field(default_factory=dict)

    def scores(self, l: str, ls: str, r: str, rs: str) -> tuple[float, float]:
        """Likelihoods of boundary and none at an event."""
        if ls[:1] == "w":
            o = self.gap * self.last.get(l[2:], 1.0) * self.start.get(r[1:].lower(), 1.0)
            return o, 1.0
        p = self.boundary.get(l) or self.boundary.get("~" + ls, 0.5)
        if goes_on(l, rs):
            return min(p, 0.01), 0.99
        odds = self.odds.get(r) or self.odds.get("~" + rs, 1.0)
        return p * odds, 1 - p

    def likely(self, kind: str, size: int) -> float:
        """How likely a stretch is text without marks."""
        return self.unmarked[kind][min(size, PLAIN + 1)] if self.unmarked else float(size > PLAIN)

    def least_size(self) -> int:
        """Gaps of smaller stretches are none, whatever the words around."""
        most = self.gap * max([1.0, *self.last.values()]) * max([1.0, *self.start.values()])
        return next((n for n in range(PLAIN + 2) if any(self.likely(k, n) * most > 1 for k in "dsDS")), PLAIN + 1)


def goes_on(left: str, right_shape: str) -> bool:
    """A small letter or a comma after a mark shows that the sentence goes on."""
    return left[0] not in "sSw" and right_shape[1:] in ("la", "ya", ",")


def _clip(x: float) -> float:
    return min(max(x, 0.0005), 0.995)


def _boundaries(left: pd.DataFrame) -> dict[str, float]:
    """P(boundary) of left words and shapes from ``l, ls, ends, inside, open``.

    Lines end with a left word as often as sentences do inside lines, up to one factor per script, that
    of its purest end marks that aren't rare; so the ends of lines tell how many of a left word's events are
    boundaries. Events that plainly go on are taken off.
    """
    shapes = left.groupby("ls")[["ends", "inside", "open"]].sum()
    factor: dict[str, float] = {}
    marks = shapes[shapes.index.str[0].isin(["!", "."])]
    whole = marks.inside.groupby(marks.index.str[1]).sum()
    for ls, s in marks.iterrows():
        if s.inside >= max(LEAST_INSIDE, LEAST_SHARE * whole[ls[1]]):
            factor[ls[1]] = max(factor.get(ls[1], 0.0), (s.ends + 1.0) / (s.inside + 2.0))
    boundary: dict[str, float] = {}
    for ls, s in shapes.iterrows():
        q = factor.get(ls[1], 1.0)
        boundary["~" + ls] = local_guess(ls, ls, "") if ls[0] in "sSw" else _clip((s.ends + DRAW * q * 0.7) / (q * (s.open + DRAW)))
    for l, ls, ends, open_ in zip(left.l, left.ls, left.ends, left.open, strict=True):
        if l[0] != "~" and ls[0] not in "sSw":
            q = factor.get(ls[1], 1.0)
            p = _clip((ends + DRAW * q * boundary["~" + ls]) / (q * (open_ + DRAW)))
            # An abbreviation hardly ever ends a line; a word that does so at a good part of the usual rate is a plain word.
            boundary[l] = max(p, 0.97) if p >= 0.3 and ls[0] in ".…" else p
    return boundary


def _odds(right: pd.DataFrame, start: dict[str, float], inner: dict[str, float]) -> dict[str, float]:
    """Odds of right words and shapes from ``r, rs, begins`` and the expected starts and other places inside lines.

    A word is drawn to its shape, a shape to even odds. Odds are limited, for without the limit the
    rounds would drift to explain rare words by whichever event is rare.
    """
    d = pd.DataFrame({"r": right.r, "rs": right.rs, "s": right.begins + right.r.map(start).fillna(0.0), "x": right.r.map(inner).fillna(0.0)})
    d["own"] = d.rs.str[:1]
    by, all_ = d.groupby("rs")[["s", "x"]].sum(), d.groupby("own")[["s", "x"]].sum() + 1.0
    a, b = d.own.map(all_.s), d.own.map(all_.x)
    bs, bx = d.rs.map(by.s), d.rs.map(by.x)
    s, x = bs + SHRINK * a / (a + b), bx + SHRINK * b / (a + b)
    shape = (s / a / (x / b)).clip(1 / MOST_ODDS, MOST_ODDS)
    whole = bs + bx + 1.0 + SHRINK
    word = ((d.s + SHRINK * s / whole) / a / ((d.x + SHRINK * x / whole) / b)).clip(1 / MOST_ODDS, MOST_ODDS)
    return dict(zip("~" + d.rs, shape, strict=True)) | dict(zip(d.r, word, strict=True))


def _expected(pairs: DataFrame, model: Model) -> list[tuple[str, str, float, float]]:
    """Expected boundaries and others per right word, and per left shape where white space is the event; sums of every task, so what returns is bounded by the words."""
    sent = pairs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**sent.value)
        for batch in batches:
            d = batch.to_pandas()
            if not len(d):
                continue
            p = []
            for key in zip(d.l, d.ls, d.r, d.rs, strict=True):
                s, x = model.scores(*key)
                p.append(s / (s + x))
            d["y"], d["z"] = np.array(p) * d.n, (1 - np.array(p)) * d.n
            white, on = d.ls.str[0].isin(["s", "S"]), [goes_on(l, rs) for l, rs in zip(d.l, d.rs, strict=True)]
            parts = [d[white].groupby("ls")[["y", "z"]].sum().reset_index().rename(columns={"ls": "w"}).assign(kind="s"), d[~np.array(on)].groupby("r")[["y", "z"]].sum().reset_index().rename(columns={"r": "w"}).assign(kind="r")]
            yield pa.RecordBatch.from_pandas(pd.concat(parts)[["kind", "w", "y", "z"]].astype({"y": float, "z": float}), schema=pa.schema([("kind", pa.string()), ("w", pa.string()), ("y", pa.float64()), ("z", pa.float64())]), preserve_index=False)

    out = pairs.mapInArrow(run, "kind string, w string, y double, z double").groupBy("kind", "w").agg(F.sum("y").alias("y"), F.sum("z").alias("z"))
    found = [tuple(r) for r in out.collect()]
    sent.destroy()
    return found


def fitted(seen: DataFrame) -> Model:
    """The model of everything ``observed``.

    The pairs of words around events stay distributed; what comes to the driver are sums per word, for
    the MOST_WORDS most frequent words seen LEAST_SEEN times. Right words get their odds from line
    starts and from the events, weighted by the model so far, in a few rounds of expectation maximisation.
    """
    counted = cut(seen.where("_kind IS NOT NULL").groupBy(*_STATISTICS[:5]).agg(F.round(F.sum("_n"), 6).alias("_n")))  # whole numbers again where copies met
    raw = counted.where("_kind = 'p'")
    often = lambda c: raw.where(F.col(c) != "").groupBy(c).agg(F.sum("_n").alias("_s")).where(F.col("_s") >= LEAST_SEEN).orderBy(F.desc("_s"), c).limit(MOST_WORDS).select(c, F.lit(True).alias(f"_k{c}"))
    known = raw.join(F.broadcast(often("_l")), "_l", "left").join(F.broadcast(often("_r")), "_r", "left")  # MOST_WORDS words at most
    keep = lambda c: F.when(F.col(f"_k{c}") | (F.col(c) == ""), F.col(c)).otherwise(F.concat(F.lit("~"), f"{c}s"))
    pairs = cut(known.select(keep("_l").alias("l"), F.col("_ls").alias("ls"), keep("_r").alias("r"), F.col("_rs").alias("rs"), "_n").groupBy("l", "ls", "r", "rs").agg(F.sum("_n").alias("n")))
    both = (F.col("l") != "") & (F.col("r") != "")
    on = ~F.left("l", F.lit(1)).isin("s", "S", "w", "~") & F.substring("rs", 2, 9).isin("la", "ya", ",") | (F.left("l", F.lit(1)) == "~") & F.substring("rs", 2, 9).isin("la", "ya", ",")
    left = pairs.where("l <> ''").groupBy("l", "ls").agg(F.sum(F.when(~both, F.col("n")).otherwise(0.0)).alias("ends"), F.sum(F.when(both, F.col("n")).otherwise(0.0)).alias("inside"), F.sum(F.when(both & ~on, F.col("n")).otherwise(0.0)).alias("open")).orderBy("l", "ls").toPandas()
    right = pairs.where("r <> ''").groupBy("r", "rs").agg(F.sum(F.when(~both, F.col("n")).otherwise(0.0)).alias("begins"), F.sum("n").alias("_n")).orderBy("_n", "rs").toPandas()
    right = right.groupby("r", as_index=False).agg({"rs": "last", "begins": "sum"}) if len(right) else right
    model = Model(_boundaries(left), {}, {})
    inside = pairs.where(both & ~F.substring("ls", 1, 1).isin("w"))
    for _ in range(ROUNDS if len(right) else 0):
        start: dict[str, float] = {}
        inner: dict[str, float] = {}
        for kind, w, y, z in _expected(inside, model):
            if kind == "s":
                model.boundary["~" + w] = (y + 1.0) / (y + z + 2.0)
            else:
                start[w], inner[w] = y, z
        model = Model(model.boundary, _odds(right, start, inner), {})
    follow: Counter = Counter()
    for r in counted.where("_kind = 'f'").collect():  # twelve rows
        follow[int(r["_l"]), int(r["_ls"]), int(r["_r"])] += r["_n"]
    for r in counted.where("_kind = 'L'").collect():  # a row per size and kind of stretch, PLAIN + 1 of each at most
        model.unmarked.setdefault(r["_l"], [0.0] * (PLAIN + 2))[int(r["_ls"])] += r["_n"]
    model.unmarked = {own: _unmarked(model.unmarked.get(k, [0.0] * (PLAIN + 2)), own != k) for k in "ds" for own in (k, k.upper())}
    for e in (0, 1):
        for d in (0, 1, 2):
            y, n = follow[e, d, 1] + 1.0, follow[e, d, 0] + 1.0
            all_y, all_n = (sum(follow[x, z, v] for x in (0, 1) for z in (0, 1, 2)) + 1.0 for v in (1, 0))
            model.follow[e, d] = (y / (y + n) / (all_y / (all_y + all_n)), n / (y + n) / (all_n / (all_y + all_n)))
    return _gap_odds(counted, model)


def _unmarked(runs: list[float], marked: bool) -> list[float]:
    """How likely stretches of each size are text without marks, from how many there are of each.

    As often as stretches are longer than PLAIN a text has no marks; else a stretch gets to a size as often as the others do. Where
    its line has end marks, this has to be a rare case among rare cases.
    """
    all_, long = sum(runs[:-1]) + 2.0, runs[-1] + 1.0
    prior = (long / (all_ + long)) ** (1 + marked)
    reach = (np.cumsum(runs[-2::-1])[::-1] + 1.0) / all_
    return [*(prior / (prior + (1 - prior) * reach)).tolist(), 1.0]


def _gap_odds(counted: DataFrame, model: Model) -> Model:
    """Adds how words stand before and after plain boundaries, against how often they stand anywhere."""
    of = lambda k: F.sum(F.when(F.col("_kind") == k, F.col("_n")).otherwise(0.0))
    words = counted.where("_kind IN ('T', 'F', 'S')").groupBy("_l").agg(of("T").alias("t"), of("F").alias("f"), of("S").alias("s"))
    words = cut(words)
    t, f, s = (x or 0.0 for x in words.agg(F.sum("t"), F.sum("f"), F.sum("s")).first())
    if t <= f or not f or not s:
        return model
    own = words.where((F.col("t") >= LEAST_SEEN) & (F.col("f") + F.col("s") > 0)).orderBy(F.desc("t"), "_l").limit(MOST_WORDS).toPandas()

    def moved(n: pd.Series, total: float) -> dict[str, float]:
        rate = total / t
        x = ((n + SHRINK * rate) / (own.t + SHRINK)) / rate
        return dict(zip(own._l, x.clip(1 / MOST_GAP_ODDS, MOST_GAP_ODDS), strict=True))

    model.last, model.start, model.gap = moved(own.f, f), moved(own.s, s), f / (t - f)
    return model


def posteriors(model: Model, events: pa.ListArray) -> np.ndarray:
    """Probability of a boundary at every event of a batch, one row's after the other's; 1 at the ends of lines.

    The forward-backward algorithm runs over all lines of the batch at once, from the first event on and back from the last.
    """
    coded = events.flatten().dictionary_encode()
    n = len(coded)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    local, which = np.zeros((len(coded.dictionary), 2)), np.zeros(len(coded.dictionary), dtype=np.int64)
    for i, e in enumerate(coded.dictionary.to_pylist()):
        if e:
            l, ls, r, rs, d = e.split(_US)
            s, x = model.scores(l, ls, r, rs)
            local[i], which[i] = (s / (s + x) if s + x > 0 else 0.0, x / (s + x) if s + x > 0 else 1.0), int(d)
        else:
            which[i] = -1
    end = which[code] < 0
    tails = np.flatnonzero(end)
    heads = np.concatenate([[0], tails[:-1] + 1])[: len(tails)]
    sizes = tails - heads
    lines = np.argsort(-sizes, kind="stable")
    heads, tails, sizes = heads[lines], tails[lines], sizes[lines]
    step = np.ones((2, 3, 2))
    for (e, d), v in model.follow.items():
        step[e, d] = v
    yes, no = local[code, 0], local[code, 1]
    kind = np.maximum(which[code], 0)
    after_yes, after_no = step[1][kind], step[0][kind]  # factors of (boundary, none) at an event after a boundary, after none
    forward = np.zeros((n, 2))
    fs, fn = np.ones(len(heads)), np.zeros(len(heads))
    for t in range(int(sizes.max(initial=0))):
        k = int(np.searchsorted(-sizes, -t, side="left"))
        at = heads[:k] + t
        s = yes[at] * (fs[:k] * after_yes[at, 0] + fn[:k] * after_no[at, 0])
        x = no[at] * (fs[:k] * after_yes[at, 1] + fn[:k] * after_no[at, 1])
        total = np.where(s + x > 0, s + x, 1.0)
        fs[:k], fn[:k] = s / total, x / total
        forward[at, 0], forward[at, 1] = fs[:k], fn[:k]
    out = np.ones(n)
    bs, bn = np.ones(len(heads)), np.ones(len(heads))
    for t in range(int(sizes.max(initial=0))):
        k = int(np.searchsorted(-sizes, -t, side="left"))
        at = tails[:k] - 1 - t
        s, x = forward[at, 0] * bs[:k], forward[at, 1] * bn[:k]
        out[at] = s / np.where(s + x > 0, s + x, 1.0)
        y, z = yes[at] * bs[:k], no[at] * bn[:k]
        s, x = y * after_yes[at, 0] + z * after_yes[at, 1], y * after_no[at, 0] + z * after_no[at, 1]
        total = np.where(s + x > 0, s + x, 1.0)
        bs[:k], bn[:k] = s / total, x / total
    return out


def _plain_gaps(model: Model, text: str, stops: list[int], events: list[str], least: int) -> list[int]:
    """The boundaries among the gaps of a text's stretches that aren't events: those more likely than not by the words around and their stretch."""
    data, starts = joined([text])
    ends = [s for s, e in zip(stops, events, strict=True) if not e]
    found = runs(data, starts, *run_ends(starts, [0], stops, events))
    which = np.repeat(np.arange(len(found.head)), found.tail - found.head)
    a, b = found.places[:-1], found.places[1:]
    white = np.cumsum(found.kind & _WHITE > 0)
    apart = (white[b] > white[a]) | ((found.kind[a] | found.kind[b]) & _SOLID > 0) & (found.kind[b] & _STARTS > 0)
    at = np.flatnonzero((which[:-1] == which[1:]) & apart & (found.size[which[:-1]] >= least)) if len(which) else []
    quoted = []
    if len(at) and QUOTE.search(text):
        for low, high in zip([0, *ends], ends, strict=False):
            quoted += [m.span() for m in QUOTED.finditer(text, low, high)]
    out, known, q = [], set(stops), 0
    for i in at:
        stop, run = int(a[i]) + 1, which[i]
        while q < len(quoted) and quoted[q][1] <= stop:
            q += 1
        if stop in known or q < len(quoted) and quoted[q][0] < stop:
            continue
        own = script(text[stop - 1])
        odds = model.scores(f"w{own}{gram_before(text, stop)}", f"w{own}", *right_word(text, int(b[i]), len(text), own))[0]
        if odds * model.likely("sdSD"[int(found.close[run]) + 2 * int(found.marked[run])], int(found.size[run])) > 1:
            out.append(stop)
    return out


def decided(model: Model, stops: pa.ListArray, events: pa.ListArray, longest: np.ndarray, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """End positions of all rows one after the other, and where each row's begin (one more at the end).

    Only rows with a ``longest`` stretch of the model's least size have to have their texts.
    """
    keep = posteriors(model, events) > 0.5
    offsets = np.asarray(events.offsets) - events.offsets[0].as_py()
    ends, starts = stops.flatten().to_numpy(zero_copy_only=False)[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
    least = model.least_size()
    more = [(i, stop) for i in np.flatnonzero(longest >= least).tolist() for stop in _plain_gaps(model, texts[i], stops[i].as_py(), events[i].as_py(), least)]
    if more:
        rows, added = np.array(more, dtype=np.int64).T
        row = np.concatenate([np.repeat(np.arange(len(starts) - 1), np.diff(starts)), rows])
        order = np.lexsort((both := np.concatenate([ends, added]), row))
        ends, starts = both[order], np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(starts) - 1))])
    return ends, starts


def ends_of(model: Model, text: str | None) -> list[int]:
    """End positions of the sentences of one text, in order; none for NULL, empty and blank texts."""
    counts = _Counts()
    stops, events = counts.add(text or "")
    longest = counts.add_words([text], [1], [0], stops, events)
    return decided(model, pa.array([stops], pa.list_(pa.int32())), pa.array([events], pa.list_(pa.string())), longest, [text])[0].tolist()


def sentence_ends(seen: DataFrame, model: Model, *, keys: list[str]) -> DataFrame:
    """``keys, end_pos``: a row per sentence of each row that was ``observed``, in one narrow pass.

    Rows with a NULL, empty or blank text have no sentences; repeated rows give their sentences each
    time; very long texts are read as a whole; other columns are ignored.
    """
    sent = seen.sparkSession.sparkContext.broadcast(vars(model))
    wanted = F.when(F.col("_longest") >= model.least_size(), F.col("_text"))
    rows = seen.where("_kind IS NULL").select(*keys, "_stops", "_events", "_longest", wanted.alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys) + ", end_pos int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**sent.value)
        for batch in batches:
            ends, starts = decided(model, *(batch.column(c) for c in ("_stops", "_events")), batch.column("_longest").to_numpy(zero_copy_only=False), batch.column("_text").to_pylist())
            at = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(starts)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(k).take(at) for k in keys] + [pa.array(ends, pa.int32())], names=[*keys, "end_pos"])

    return rows.mapInArrow(run, schema)
