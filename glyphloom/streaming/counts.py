"""Counts that follow a stream of sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphloom.operators import ngrams as ng


def running_counts(sentences: DataFrame, order: int) -> DataFrame:
    """``k, hist, w, c`` over everything a stream of ``tokens`` has brought; for the update or complete mode."""
    return ng.counts(sentences, order)


def windowed_counts(sentences: DataFrame, at: str, length: str, late: str) -> DataFrame:
    """``begin, w, c``: words per window of event time; rows later than ``late`` are left out, so finished windows can be appended and forgotten."""
    w = sentences.withWatermark(at, late).select(F.window(at, length).alias("win"), F.explode("tokens").alias("w"))
    return w.groupBy("win", "w").agg(F.count("*").alias("c")).select(F.col("win.start").alias("begin"), "w", "c")


def to_table(counts: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Run a stream into an in-memory table until its source is used up."""
    return counts.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
