"""Problem 5: differences between two systems' copies of the annotated paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.catalog import Query
from glyphloom.operators.versions import compare_versions, counts_by, field_report
from glyphloom.sources.tables import table

FIELDS = ["value", "n_tokens", "page_no", "section", "entity_types", "weight", "printed_at"]


def _compared(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    first, second = table(spark, folder, "raw_first"), table(spark, folder, "raw_second")
    return first, second, compare_versions(first, second, key="para_id", fields=FIELDS, tolerance={"weight": 1e-9}, latest=["loaded_at"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return field_report(_compared(spark, folder)[2], "para_id")


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Corrected counts per file beside those an earlier comparison reported; stale: they differ."""
    first, second, found = _compared(spark, folder)
    true = counts_by(first, second, found, key="para_id", group="file")
    names = ["paragraphs", "identical", "different", "only_first", "only_second"]
    said = table(spark, folder, "compare_versions").select(F.col("file").alias("_f"), *[F.col(c).alias(f"said_{c}") for c in names])
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"said_{c}"))
    return true.join(said, true["file"].eqNullSafe(said["_f"]), "left").select("file", *names, (~same).alias("stale"))


QUERIES: dict[str, Query] = {"p5_found": p5_found, "p5_counts": p5_counts}

_SIDES = """a AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY para_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM raw_first WHERE para_id IS NOT NULL) WHERE rn = 1),
b AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY para_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM raw_second WHERE para_id IS NOT NULL) WHERE rn = 1)"""
_DIFFERS = {c: f"a.{c} IS DISTINCT FROM b.{c}" for c in FIELDS} | {"weight": "(a.weight IS DISTINCT FROM b.weight AND NOT coalesce(abs(a.weight - b.weight) <= 1e-9, false))"}
_CHANGED = " OR ".join(_DIFFERS.values())
SQL = {
    "p5_found": f"""WITH {_SIDES}
SELECT para_id, '*' AS field_name, 'only_first' AS status FROM a WHERE para_id NOT IN (SELECT para_id FROM b)
UNION ALL SELECT para_id, '*', 'only_second' FROM b WHERE para_id NOT IN (SELECT para_id FROM a)
"""
    + "\n".join(f"UNION ALL SELECT a.para_id, '{c}', 'differs' FROM a JOIN b USING (para_id) WHERE {x}" for c, x in _DIFFERS.items()),
    "p5_counts": f"""WITH {_SIDES},
f AS (SELECT para_id, coalesce(min(CASE WHEN s = 0 THEN file END), min(file)) AS file FROM (SELECT para_id, file, 0 AS s FROM raw_first UNION ALL SELECT para_id, file, 1 FROM raw_second) WHERE para_id IS NOT NULL GROUP BY para_id),
t AS (SELECT f.file, CASE WHEN b.para_id IS NULL THEN 'only_first' WHEN a.para_id IS NULL THEN 'only_second' WHEN {_CHANGED} THEN 'different' ELSE 'identical' END AS s
  FROM f LEFT JOIN a ON f.para_id = a.para_id LEFT JOIN b ON f.para_id = b.para_id),
c AS (SELECT file, count(*) AS paragraphs, count(*) FILTER (s = 'identical') AS identical, count(*) FILTER (s = 'different') AS different, count(*) FILTER (s = 'only_first') AS only_first, count(*) FILTER (s = 'only_second') AS only_second FROM t GROUP BY file)
SELECT c.*, NOT (c.paragraphs IS NOT DISTINCT FROM v.paragraphs AND c.identical IS NOT DISTINCT FROM v.identical AND c.different IS NOT DISTINCT FROM v.different AND c.only_first IS NOT DISTINCT FROM v.only_first AND c.only_second IS NOT DISTINCT FROM v.only_second) AS stale
FROM c LEFT JOIN compare_versions v ON c.file IS NOT DISTINCT FROM v.file""",
}
