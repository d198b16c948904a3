"""Text files: sentences and annotated lines in several encodings, and fingerprints."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.functions.text import words

# Encodings that are tried, in this order.
ENCODINGS = ["utf-8-sig", "gb18030", "utf-16"]


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, value`` of UTF-8 files, a byte-order mark left out; blank lines stay. Files are split, so order is only within the ids that lines carry."""
    return spark.read.text(paths).select(F.col("_metadata.file_name").alias("file"), "value")


def read_encoded_lines(spark: SparkSession, paths: str | list[str], encoding: str | None = None) -> DataFrame:
    """``file, line_no, value`` of files in any of ENCODINGS (or the one given), each file decoded as a whole in one task. A file that no encoding fits raises an error."""
    own = [encoding] if encoding else ENCODINGS

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for e in own:
                    if e == "utf-16" and content[:2] not in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
                        continue
                    try:
                        lines = content.decode(e).split("\n")
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    raise ValueError(f"none of {own} decodes {path}")
                if lines and lines[-1] == "":
                    lines.pop()
                yield pd.DataFrame({"file": path.rsplit("/", 1)[-1], "line_no": range(1, len(lines) + 1), "value": [x.rstrip("\r") for x in lines]})

    paths = [paths] if isinstance(paths, str) else paths
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(decode, "file string, line_no bigint, value string")


def read_sentences(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``tokens``: a sentence per non-blank line, cut at Unicode white space."""
    return spark.read.text(paths).select(words(F.col("value")).alias("tokens")).where(F.size("tokens") > 0)


def write_sentences(sentences: DataFrame, path: str, *, by_split: bool = False) -> None:
    """One sentence per line; with ``by_split`` a folder per split."""
    lines = sentences.select(F.array_join("tokens", " ").alias("value"), *(["split"] if by_split else []))
    writer = lines.write.mode("overwrite")
    (writer.partitionBy("split") if by_split else writer).text(path)


def file_fingerprints(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, sha256``."""
    paths = [paths] if isinstance(paths, str) else paths
    return spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """``rows, fingerprint`` of a table, the same in any order of its rows; repeated rows count."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, digits: int = 4) -> str:
    """A report table of a small result as Markdown."""
    rows = df.collect()
    shown = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(shown(v) for v in r) + " |" for r in rows])
