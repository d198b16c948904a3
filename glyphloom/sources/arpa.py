"""ARPA text files of back-off models: written by section, read back as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.operators import ngrams as ng
from glyphloom.operators.lm import Model


def arpa_lines(model: Model) -> DataFrame:
    """``k, value``: the lines of each section, ``log10 p  TAB  words  TAB  log10 back-off``. ``<s>`` gets the customary -99."""
    e = model.entries.select("k", "hist", "w", F.log10("p").alias("lp"))
    gram = F.when(F.col("hist") == "", F.col("w")).otherwise(F.concat("hist", F.lit(ng.SEP), "w"))
    e = e.withColumn("gram", gram)
    b = model.backoff.where("k > 1").select((F.col("k") - 1).alias("bk"), F.col("hist").alias("bg"), F.log10("gamma").alias("bo"))
    start = e.sparkSession.createDataFrame([(1, "", ng.BOS, -99.0, ng.BOS)], "k int, hist string, w string, lp double, gram string")
    full = e.unionByName(start).join(b, (F.col("k") == F.col("bk")) & (F.col("gram") == F.col("bg")), "left")
    words = F.replace("gram", F.lit(ng.SEP), F.lit(" "))
    number = lambda c: F.format_string("%.9g", c)
    return full.select("k", F.concat_ws("\t", number(F.col("lp")), words, F.when(F.col("bo").isNotNull(), number(F.col("bo")))).alias("value"))


def write_arpa(model: Model, path: str) -> None:
    """A folder with one part per section, header first, so that the files in name order are one ARPA file. Sections are written in parallel parts."""
    lines = arpa_lines(model)
    counts = {r["k"]: r["n"] for r in lines.groupBy("k").agg(F.count("*").alias("n")).collect()}
    spark = lines.sparkSession
    head = ["\\data\\"] + [f"ngram {k}={counts[k]}" for k in sorted(counts)] + [""]
    spark.createDataFrame([(x,) for x in head], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/section=0")
    for k in sorted(counts):
        spark.createDataFrame([(f"\\{k}-grams:",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/section={k}-a")
        lines.where(F.col("k") == k).select("value").write.mode("overwrite").text(f"{path}/section={k}-b")
    spark.createDataFrame([("",), ("\\end\\",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/section=9-end")


def read_arpa(spark: SparkSession, path: str, order: int) -> Model:
    """The model of a written folder or of one ARPA file: an n-gram line is told by its numbers and how many words it has."""
    v = spark.read.option("recursiveFileLookup", True).text(path).where(F.col("value").rlike(r"^-?[0-9.]+(e-?[0-9]+)?\t"))
    part = F.split("value", "\t")
    x = v.select(part[0].cast("double").alias("lp"), F.split(part[1], " ").alias("g"), F.try_element_at(part, F.lit(3)).cast("double").alias("bo"))
    x = x.withColumn("k", F.size("g"))
    join = lambda a: F.array_join(a, ng.SEP)
    entries = x.where(F.col("lp") > -90).select("k", join(F.slice("g", F.lit(1), F.col("k") - 1)).alias("hist"), F.element_at("g", -1).alias("w"), F.pow(F.lit(10.0), "lp").alias("p"))
    backoff = x.where("bo IS NOT NULL").select((F.col("k") + 1).alias("k"), join(F.col("g")).alias("hist"), F.pow(F.lit(10.0), "bo").alias("gamma"))
    words = entries.where((F.col("k") == 1) & (F.col("w") != ng.UNK)).select("w")
    return Model(order, entries, backoff, words)
