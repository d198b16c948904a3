"""Texts of a batch as one array of code points, so that whole batches are classified and folded at once."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np

from glyphloom.functions.text import INVISIBLE_RANGES, SPACE_RANGES
from glyphloom.functions.workers import per_process
from glyphloom.llm.lookalikes import RADICALS

BREAK = 0x10FFFF  # stands between two texts
LETTER, DIGIT, UPPER, DENSE, INVISIBLE, SPACE, VOWEL, ACCENT = 1, 2, 4, 8, 16, 32, 64, 128


def _fold(c: str) -> str:
    if "가" <= c <= "힣":
        return c
    base = unicodedata.normalize("NFKD", RADICALS.get(c, c))
    return (base[:1] or c).lower()[:1] or c


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the first plane: its folded letter (case, width, accents aside) and its kinds."""
    fold, kind = np.arange(0x10000, dtype=np.uint32), np.zeros(0x10000, dtype=np.uint8)
    for i in range(0x10000):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        category = unicodedata.category(c)
        if category[0] in "LN":
            fold[i] = ord(_fold(c))
            kind[i] = (DIGIT if category[0] == "N" else LETTER) | (UPPER if category in ("Lu", "Lt") else 0)
            if 0x2E80 <= i < 0xA000 or 0xF900 <= i < 0xFB00 or 0xFF66 <= i < 0xFFA0 or 0x0E00 <= i < 0x0E80:
                kind[i] |= DENSE
        elif category in ("Mn", "Mc"):
            # Vowel signs belong to words; accents are left out of comparisons.
            kind[i] = (VOWEL | (DENSE if 0x0E00 <= i < 0x0E80 else 0)) if 0x0900 <= i < 0x1000 or 0x1000 <= i < 0x10A0 or 0x1780 <= i < 0x17E0 else ACCENT
    for ranges, flag in ((INVISIBLE_RANGES, INVISIBLE), (SPACE_RANGES, SPACE)):
        for a, b in ranges:
            kind[a : b + 1] = flag
    return fold, kind


def slices(texts: list[str | None], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` characters, one row at least, so that long texts don't multiply a batch's memory."""
    low, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield low, i + 1
            low, size = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All code points with BREAK after each text, and where each text begins (one more at the end)."""
    sizes = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    data = np.frombuffer("\U0010ffff".join([t or "" for t in texts] + [""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return data, starts


def folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    fold, kind = per_process("code_points", _tables)
    low = np.minimum(data, 0xFFFF)
    beyond = data > 0xFFFF
    f, k = fold[low], kind[low]
    if beyond.any():
        f = np.where(beyond, data, f)
        k = np.where(beyond & (data >= 0x20000) & (data < 0x32000), LETTER | DENSE, np.where(beyond, 0, k)).astype(np.uint8)
    return f, k
