"""Deterministic keys, samples and prefix sums that another engine can reproduce."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: int, *key: Column) -> Column:
    """A number below 2^48 from md5 of the seed and the key; the same in every engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def draw(seed: int, *key: object) -> float:
    """A number from 0 to under 1: what ``seeded`` gives on the driver, as a share."""
    return int(hashlib.md5(":".join(map(str, (seed, *key))).encode()).hexdigest()[:12], 16) / (1 << 48)


def running_before(df: DataFrame, part: list[str], order: list[str], weight: Column, out: str, *, buckets: int = 64, bucket: Column | None = None) -> DataFrame:
    """Adds the sum of ``weight`` over the rows of the same part that come before in a hash order.

    The order is by bucket of the hashed order columns, then by the columns: any fixed order does (or by
    ``bucket``, whose numbers rise with the order columns; then it is their order). No task holds more than one bucket of one part, so a part with a third of all rows is spread; only
    the bucket totals (parts x buckets rows) meet in a window of their own.
    """
    b = df.withColumn("_w", weight).withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)) if bucket is None else bucket)
    keys = [*part, "_b"]
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("_in", F.coalesce(F.sum("_w").over(inner), F.lit(0)))
    totals = b.groupBy(*keys).agg(F.sum("_w").alias("_t"))
    outer = Window.partitionBy(*(part or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_off"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = b.join(totals, on)
    return joined.withColumn(out, F.col("_in") + F.col("_off")).drop("_w", "_b", "_in", "_off", *[f"_k{i}" for i in range(len(keys))])
