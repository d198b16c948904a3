"""Repetition inside a single document, as one Spark projection without user functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.text import half_width, letters_and_digits, visible, words

# Frequent function words of the corpus languages, those of scripts without spaces apart.
STOP_WORDS = ["the", "of", "and", "in", "at", "for", "near", "der", "die", "das", "und", "den", "am", "aus", "le", "la", "et", "de", "el", "en", "un", "y", "и", "в", "на", "за", "из", "में", "की", "को", "ने", "और", "في", "من", "على"]
DENSE_STOPS = ["的", "了", "在", "和", "是", "由", "は", "が", "を", "の", "に", "で", "ที่", "และ", "ใน", "กับ"]
# Letters of scripts written without spaces, as a class.
DENSE_LETTERS = r"[\u0e01-\u0e7f\u3041-\u30ff\u3400-\u9fff\uff66-\uff9f]"

#: Names of ratios with what a record must reach or stay under to be kept; compiled into one projection.
THRESHOLDS: list[tuple[str, str, float]] = [
    ("repeated_share", "<", 0.4),
    ("duplicate_line_share", "<", 0.5),
    ("symbol_share", "<", 0.4),
    ("short_line_share", "<", 0.8),
    ("length", ">=", 20),
    ("stop_word_share", ">=", 0.01),
]
#: Letters and digits under which a line is short.
SHORT_LINE = 10
#: Characters that a piece of text adds before the next one begins; only a matter of speed.
PIECE = 96


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _text_grams(text: Column, width: int) -> Column:
    """64-bit hashes of all runs of ``width`` characters, in time that grows with the text.

    One replacement cuts the text into pieces of PIECE characters (U+0001 is neither letter nor digit), as substring() walks a long text anew for each place;
    a piece with the beginning of the next one has all runs that start in it.
    """
    pieces = F.split(F.regexp_replace(text, f"(.{{{PIECE}}})", "$1\u0001"), "\u0001")
    whole = lambda p: F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.concat(a, F.coalesce(F.left(b, F.lit(width - 1)), F.lit(""))))
    runs = lambda p: F.transform(F.sequence(F.lit(1), F.char_length(p) - (width - 1)), lambda i: F.xxhash64(F.substring(p, i, F.lit(width))))
    joined = let(pieces, lambda p: F.flatten(F.transform(F.filter(whole(p), lambda x: F.char_length(x) >= width), runs)))
    return F.when(F.char_length(text) >= width, joined).otherwise(F.array().cast("array<bigint>"))


def _list_grams(tokens: Column, width: int) -> Column:
    n = F.size(tokens)
    return F.when(n >= width, F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(tokens, i, F.lit(width))))).otherwise(F.array().cast("array<bigint>"))


def _covered(grams: Column, width: int) -> Column:
    """How many places lie in a run seen earlier, from the runs' hashes in order."""

    def places(ordered: Column) -> Column:
        later = F.zip_with(F.slice(ordered, F.lit(2), F.greatest(F.size(ordered), F.lit(1))), ordered, lambda b, a: F.when(a["g"] == b["g"], b["i"]))
        return F.array_sort(F.array_compact(later))

    def spread(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return let(ordered, lambda o: let(places(o), spread))


def _share(grams: Column, n: Column, width: int, least: float) -> Column:
    """The exact share of covered places, or the bound ``width x repeated runs / n`` where that is under ``least`` already.

    A repeated run covers at most ``width`` places, so a record under the bound can't reach ``least``;
    most records end there with one hash set.
    """

    def exact(g: Column) -> Column:
        repeats = F.size(g) - F.size(F.array_distinct(g))
        return F.when(repeats == 0, F.lit(0.0)).when(repeats * width < n * least, repeats * width / n).otherwise(_covered(g, width) / n)

    return F.when(n >= width, let(grams, exact)).otherwise(F.lit(0.0))


def text_repetition(text: Column, *, width: int = 20, least: float = 0.4) -> Column:
    """Share of letters and digits in a run of ``width`` seen earlier. NULL and empty texts: 0. Shares under ``least`` may be an upper bound."""
    return let(letters_and_digits(text), lambda t: _share(_text_grams(t, width), F.char_length(t), width, least))


def token_repetition(tokens: Column, *, width: int = 3, least: float = 0.4) -> Column:
    """Share of tokens in a run of ``width`` seen earlier, tokens without a letter or digit left out. NULL and empty lists: 0."""
    kept = F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.coalesce(t.rlike(r"[\p{L}\p{N}]"), F.lit(False)))
    plain = F.transform(kept, lambda t: F.lower(half_width(visible(t))))
    return let(plain, lambda t: _share(_list_grams(t, width), F.size(t), width, least))


def _ratios(text: Column, repeated: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, r"\R"), lambda x: F.trim(x) != "")
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    low = F.lower(t)
    # A word of a script without spaces has about two letters.
    units = F.regexp_count(low, F.lit(r"[\p{L}&&[^\u0e01-\u0e7f\u3041-\u30ff\u3400-\u9fff\uff66-\uff9f]][\p{L}\p{M}&&[^\u0e01-\u0e7f\u3041-\u30ff\u3400-\u9fff\uff66-\uff9f]]*")) + F.regexp_count(low, F.lit(DENSE_LETTERS)) / 2
    stops = F.regexp_count(low, F.lit(r"(?<![\p{L}\p{M}])(" + "|".join(STOP_WORDS) + r")(?![\p{L}\p{M}])")) + F.regexp_count(low, F.lit("|".join(DENSE_STOPS)))
    return {
        "length": F.char_length(t),
        "symbol_share": over(F.char_length(F.regexp_replace(t, r"[\p{L}\p{N}\p{M}\s　]", "")), F.char_length(t)),
        "stop_word_share": over(stops, units),
        "duplicate_line_share": let(lines, lambda x: over(F.size(x) - F.size(F.array_distinct(x)), F.size(x))),
        "short_line_share": let(lines, lambda x: over(F.size(F.filter(x, lambda y: F.char_length(F.regexp_replace(y, r"[^\p{L}\p{N}]", "")) < SHORT_LINE)), F.size(x))),
        "repeated_share": repeated,
    }


def measured(df: DataFrame, *, text: str | None, repeated: Column, thresholds: list[tuple[str, str, float]] = THRESHOLDS) -> DataFrame:
    """``df`` with the ratios and ``failed``: the names of the thresholds that a record doesn't meet.

    One narrow projection of the ratios that the table names; NULL and empty texts have length 0 and every share 0. A column of ``df``
    named like a ratio is replaced.
    """
    ratios = _ratios(df[text], repeated) if text else {"repeated_share": repeated}
    out = df.withColumns({c: ratios[c] for c, _, _ in thresholds})
    test = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
    return out.withColumn("failed", F.array_compact(F.array(*[F.when(~test[op](F.col(c), F.lit(v)), F.lit(c)) for c, op, v in thresholds])))


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """The row of each non-NULL key that is greatest by ``at``; of equal ones the greatest by all columns that can be ordered."""
    ordered = [f.name for f in df.schema if f.name not in (key, at) and f.dataType.typeName() not in ("map", "variant")]
    whole = F.struct(F.col(at), *[F.col(c) for c in ordered])
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(whole).alias("_r")).select(key, "_r.*")
