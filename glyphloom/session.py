"""Session settings for tests and benches; on a cluster the submitted configuration rules."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, **extra: str) -> SparkSession:
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    conf = {
        "spark.master": f"local[{n}]",
        "spark.driver.memory": "16g",
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    } | extra
    return SparkSession.builder.config(map=conf).getOrCreate()
