"""Corpora and models under names, with what built them, so that a later run can take up where one ended."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.operators.lm import Model


@dataclass
class Registry:
    """Named corpora: each name with the call that reads it."""

    corpora: dict[str, Callable[[SparkSession], DataFrame]] = field(default_factory=dict)

    def add(self, name: str, read: Callable[[SparkSession], DataFrame]) -> None:
        if name in self.corpora:
            raise ValueError(f"the corpus {name} is known already")
        self.corpora[name] = read

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """The corpus; an unknown name raises ValueError and lists the known ones."""
        if name not in self.corpora:
            raise ValueError(f"no corpus {name}; known: {', '.join(sorted(self.corpora)) or 'none'}")
        return self.corpora[name](spark)


def enveloped(result: DataFrame, name: str, **about: object) -> DataFrame:
    """``result`` with a struct ``run``: the run's name, its time in UTC, the Spark version and what else is given, as JSON."""
    spark = result.sparkSession
    cells: list[Column] = [F.lit(name).alias("name"), F.lit(datetime.now(UTC).isoformat(timespec="seconds")).alias("at"), F.lit(spark.version).alias("spark"), F.lit(json.dumps(about, sort_keys=True, default=str)).alias("about")]
    return result.withColumn("run", F.struct(*cells))


def _parts(model) -> dict[str, DataFrame]:
    return {"entries": model.entries, "backoff": model.backoff, "words": model.words}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def save_model(model, folder: str, name: str, *, built_from: str = "", sorted_by_history: bool = True) -> None:
    """The model's tables under ``folder/name``.

    Sorted by history within ranges of it, so that a scan with a filter on a history reads few row groups; else in hash buckets of the
    history, so that look-ups by joins find rows of a history together. The note of what built it is written last: a model without it counts as absent.
    """
    spark = model.entries.sparkSession
    for part, df in _parts(model).items():
        if "hist" in df.columns:
            df = df.repartitionByRange("k", "hist").sortWithinPartitions("k", "hist") if sorted_by_history else df.repartition("k", "hist")
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}/{part}")
    spark.createDataFrame([(name, model.order, built_from)], "name string, model_order int, built_from string").coalesce(1).write.mode("overwrite").json(f"{folder}/{name}/about")


def about(spark: SparkSession, folder: str, name: str) -> dict | None:
    """The note of a whole model; None if there is none."""
    path = f"{folder}/{name}/about"
    if not _exists(spark, f"{path}/_SUCCESS"):
        return None
    return spark.read.schema("name string, model_order int, built_from string").json(path).first().asDict()


def load_model(spark: SparkSession, folder: str, name: str) -> Model:
    """The model stored under a name; ValueError if there is none."""
    note = about(spark, folder, name)
    if note is None:
        raise ValueError(f"no model {name} in {folder}")
    entries, backoff, words = (spark.read.parquet(f"{folder}/{name}/{part}") for part in ("entries", "backoff", "words"))
    return Model(note["model_order"], entries, backoff, words)


def ensured(spark: SparkSession, folder: str, name: str, build: Callable[[], object], *, built_from: str, force: bool = False) -> Model:
    """The stored model if it was built from the same (a fingerprint of corpus and settings), else ``build``'s, which is stored first. With ``force`` it is built in any case."""
    note = about(spark, folder, name)
    if force or note is None or note["built_from"] != built_from:
        save_model(build(), folder, name, built_from=built_from)
    return load_model(spark, folder, name)
