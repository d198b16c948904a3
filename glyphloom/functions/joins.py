"""Joins that don't gather a frequent key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_lookup(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame, salt: Column) -> DataFrame:
    """``rows`` with the other columns of ``table``, NULL where it has no such key; ``table`` has each key once.

    ``hot`` is the part of ``table`` that may be looked up by very many rows; its size has to be bounded by the
    caller, as it is broadcast. Rows that found their key there go to the shuffle under a key
    of their own from ``salt`` (the last of ``keys`` is a string), so no task gets all rows of a frequent key.
    """
    values = [c for c in table.columns if c not in keys]
    near = hot.select(*keys, *[F.col(v).alias(f"_hot_{v}") for v in values], F.lit(True).alias("_hot"))
    found = rows.join(F.broadcast(near), keys, "left")
    moved = found.withColumn("_key", F.when(F.col("_hot"), F.concat(F.lit("\0"), salt.cast("string"))).otherwise(F.col(keys[-1])))
    far = table.withColumnRenamed(keys[-1], "_key")
    out = moved.join(far, [*keys[:-1], "_key"], "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(v), F.col(f"_hot_{v}")).alias(v) for v in values])
