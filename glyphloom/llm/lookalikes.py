"""Visually identical text with different characters: one form per class of texts that read the same."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.text import SPACES, visible
from glyphloom.plans.materialise import cut

# Letters of other scripts that are drawn like a Latin letter, each with that letter.
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝӏАВСЕНІЈКМОРЅТХУҮԌёїЁЇ", "aeopcyxijshdqwlABCEHIJKMOPSTXYYGëïËÏ"))
GREEK = dict(zip("οΑΒΕΖΗΙΚΜΝΟΡΤΥΧνόϳ", "oABEZHIKMNOPTYXvój"))
# Radicals that have no compatibility mapping, each with the ideograph drawn like it.
RADICALS = dict(zip("⺟⺠⻁⻄⻅⻆⻉⻋⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻨⻩⻫⻬⻮⻯⻰⻲⻳", "母民虎西见角贝车长门青韦页风飞食马骨鬼鱼鸟麦黄斉齐歯竜龙亀龟"))


def _by_rule() -> dict[str, str]:
    """Full-width and half-width forms and Kangxi radicals, each with its one-character compatibility form."""
    out = {}
    for block in (range(0xFF01, 0xFFEF), range(0x2F00, 0x2FD6), range(0x2E80, 0x2F00), range(0xF900, 0xFB00)):
        for c in map(chr, block):
            to = unicodedata.normalize("NFKC", c)
            if len(to) == 1 and to != c:
                out[c] = to
    return out | {"ﾞ": "゙", "ﾟ": "゚"}


MAPPED = _by_rule() | RADICALS | CYRILLIC | GREEK
#: The widths that a reader doesn't see inside a word list, without the letters of other scripts.
COLLATION = "UNICODE"


def look(text: Column) -> Column:
    """``text`` with invisible characters left out, any space as U+0020 and each look-alike as its plain character.

    Accents, case, digits and words stay. Composed and combining accents still differ here; the
    collation makes them equal. NULL stays NULL.
    """
    plain = F.translate(visible(text), "".join(MAPPED), "".join(MAPPED.values()))
    return F.trim(F.regexp_replace(plain, SPACES, " "))


def canonical_texts(texts: DataFrame, column: str) -> DataFrame:
    """``text, canonical`` for every distinct non-NULL text: canonical is the least text of those that read the same.

    Groups the mapped values under an accent- and case-sensitive Unicode collation in SQL, takes the
    least member and joins it back. Grouping works on distinct texts and keeps only a minimum, so a
    text that a third of all rows share is reduced before the shuffle. Empty texts are a class of
    their own; an empty table gives an empty result.
    """
    spark = texts.sparkSession
    distinct = texts.select(F.col(column).alias("text")).where("text IS NOT NULL").distinct().withColumn("look", look(F.col("text")))
    return spark.sql(
        f"""WITH class AS (SELECT collate(look, '{COLLATION}') AS form, min(text) AS canonical FROM {{t}} GROUP BY collate(look, '{COLLATION}'))
        SELECT t.text, class.canonical FROM {{t}} t JOIN class ON collate(t.look, '{COLLATION}') = class.form""",
        t=distinct,
    )


def consistent_form(df: DataFrame, column: str, out: str = "canonical") -> DataFrame:
    """``df`` with ``out``: the canonical text of the class of ``column``; NULL for NULL. Other columns stay as they are."""
    forms = canonical_texts(df, column).select(F.col("text").alias("_text"), F.col("canonical").alias(out))
    return df.join(forms, df[column] == forms["_text"], "left").drop("_text")


def _members(df: DataFrame, key: str, column: str) -> DataFrame:
    """``_id, _text, canonical`` of the rows whose class has different texts.

    A first aggregate under the collation carries two hashes per class (the least and the greatest of its texts') and
    leaves the classes with different texts, which are few; only their rows get a canonical member, joined back by class.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("_id"), F.col(column).alias("_text")).where("_id IS NOT NULL AND _text IS NOT NULL").withColumn("look", look(F.col("_text")))
    several = cut(
        spark.sql(
            f"""SELECT CAST(form AS STRING) AS form FROM (SELECT collate(look, '{COLLATION}') AS form, min(xxhash64(_text)) AS lo, max(xxhash64(_text)) AS hi FROM {{t}} GROUP BY collate(look, '{COLLATION}')) WHERE lo <> hi""",
            t=rows,
        )
    )
    return cut(
        spark.sql(
            f"""WITH own AS (SELECT t._id, t._text, s.form FROM {{t}} t JOIN {{s}} s ON collate(t.look, '{COLLATION}') = collate(s.form, '{COLLATION}')),
            canon AS (SELECT form, min(_text) AS canonical FROM own GROUP BY form)
            SELECT own._id, own._text, canon.canonical FROM own JOIN canon ON own.form = canon.form""",
            t=rows,
            s=several,
        )
    )


def lookalike_pairs(df: DataFrame, *, key: str, column: str) -> DataFrame:
    """``a, b`` (a < b): rows whose texts differ as strings but have the same canonical text.

    Different texts of a class are paired first and then joined to their rows, so rows that hold the
    same text are never paired with one another. Rows with a NULL key or text pair with nothing.
    """
    members = _members(df, key, column)
    texts = members.select("canonical", "_text").distinct()
    x, y = texts.select("canonical", F.col("_text").alias("_x")), texts.select("canonical", F.col("_text").alias("_y"))
    pairs = x.join(y, "canonical").where("_x < _y").select("_x", "_y")
    one, two = members.select(F.col("_id").alias("_i"), F.col("_text").alias("_x")), members.select(F.col("_id").alias("_j"), F.col("_text").alias("_y"))
    return pairs.join(one, "_x").join(two, "_y").select(F.least("_i", "_j").alias("a"), F.greatest("_i", "_j").alias("b"))


def lookalike_classes(df: DataFrame, *, key: str, column: str) -> DataFrame:
    """``key, canonical, others``: one row per row whose text has look-alikes: its class and how many rows of the class hold another string. Nothing is paired."""
    own = _members(df, key, column)
    per = own.groupBy("canonical", "_text").agg(F.count("*").alias("_same"))
    all_ = per.groupBy("canonical").agg(F.sum("_same").alias("_all"))
    return own.join(per, ["canonical", "_text"]).join(all_, "canonical").select(F.col("_id").alias(key), "canonical", (F.col("_all") - F.col("_same")).alias("others"))
