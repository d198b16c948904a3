"""Models and corpora under names, and the shared folder."""

import pytest
from pyspark.sql import functions as F

from glyphloom.operators import lm
from glyphloom.plans import materialise
from glyphloom.sources import store

TEXT = ["the cat sat on the mat", "the cat ate the fish", "a dog sat on the log"]


def test_models_by_name(spark, tmp_path):
    train = spark.createDataFrame([(i, t.split()) for i, t in enumerate(TEXT)], "sent_id bigint, tokens array<string>")
    built = []

    def build():
        built.append(1)
        return lm.train(train, 3)

    folder = f"file://{tmp_path}/models"
    with pytest.raises(ValueError, match="no model"):
        store.load_model(spark, folder, "kn3")
    a = store.ensured(spark, folder, "kn3", build, built_from="x")
    b = store.ensured(spark, folder, "kn3", build, built_from="x")
    assert len(built) == 1 and a.order == b.order == 3
    assert store.about(spark, folder, "kn3")["built_from"] == "x"
    own = {(r["sent_id"], r["pos"]): r["p"] for r in lm.scores(lm.train(train, 3), train, ["sent_id"]).collect()}
    got = {(r["sent_id"], r["pos"]): r["p"] for r in lm.scores(b, train, ["sent_id"]).collect()}
    assert got == pytest.approx(own)
    store.ensured(spark, folder, "kn3", build, built_from="y")
    store.ensured(spark, folder, "kn3", build, built_from="y", force=True)
    assert len(built) == 3
    store.save_model(lm.train(train, 2), folder, "hashed", sorted_by_history=False)
    assert store.load_model(spark, folder, "hashed").order == 2


def test_registry_and_envelope(spark):
    r = store.Registry()
    r.add("tiny", lambda s: s.range(3))
    assert r.read(spark, "tiny").count() == 3
    with pytest.raises(ValueError, match="known: tiny"):
        r.read(spark, "other")
    with pytest.raises(ValueError, match="already"):
        r.add("tiny", lambda s: s.range(1))
    e = store.enveloped(spark.range(2), "E2", order=3).select("run.*").distinct().collect()
    assert len(e) == 1 and e[0]["name"] == "E2" and e[0]["about"] == '{"order": 3}'


def test_shared_folder_is_needed_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, other=None: other)

    with pytest.raises(ValueError, match="checkpoint.dir"):
        materialise.shared_dir(Session())


def test_cut_tables_stand_in_the_folder_of_the_application(spark):
    d = materialise.cut(spark.range(5).withColumn("x", F.col("id") * 2))
    assert d.count() == 5 and spark.sparkContext.applicationId in d.inputFiles()[0]
