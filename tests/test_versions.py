from glyphloom.operators.versions import compare_versions, counts_by, field_report

SCHEMA = "id string, file string, value string, tags array<string>, weight double, at int, _key string"


def test_all_kinds_of_difference(spark):
    a = spark.createDataFrame([
        ("1", "f", "x", ["n"], 1.0, 1, "q"), ("1", "f", "x", ["n"], 1.0, 1, "q"),  # delivered twice
        ("2", "f", None, None, 1.0, 1, "q"), ("3", "f", "", ["a"], 1.0 + 1e-12, 1, "q"), ("4", "g", "only", [], None, 1, "q"),
        (None, "f", "blank", None, None, 1, "q"), ("6", "g", "old", None, 2.0, 1, "q"), ("6", "g", "new", None, 2.0, 2, "q"), ("7", "g", "v", ["a", "b"], float("nan"), 1, "q"),
    ], SCHEMA)
    b = spark.createDataFrame([
        ("1", "f", "x", ["n"], 1.0, 1, "q"), ("2", "f", None, None, 1.0, 1, "q"), ("3", "f", None, ["a"], 1.0, 1, "q"), ("5", "h", "y", [], 0.0, 1, "q"), ("6", "g", "new", None, 2.5, 1, "q"), ("7", "g", "v", ["b", "a"], float("nan"), 1, "q"),
    ], SCHEMA)
    found = compare_versions(a, b, key="id", fields=["value", "tags", "weight"], tolerance={"weight": 1e-9}, latest=["at"])
    rows = {tuple(r) for r in field_report(found, "id").collect()}
    assert rows == {("3", "value", "differs"), ("4", "*", "only_first"), ("5", "*", "only_second"), ("6", "weight", "differs"), ("7", "tags", "differs")}
    counts = {r["file"]: tuple(r)[1:] for r in counts_by(a, b, found, key="id", group="file").collect()}
    assert counts == {"f": (3, 2, 1, 0, 0), "g": (3, 0, 2, 1, 0), "h": (1, 0, 0, 0, 1)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([("1", "f", "x", None, None, 1, "q")], SCHEMA)
    assert compare_versions(none, none, key="id", fields=["value"]).count() == 0
    assert [r["side"] for r in compare_versions(none, one, key="id", fields=["value"]).collect()] == ["only_second"]


def test_difference_below_eight_digits(spark):
    a, b = (spark.createDataFrame([("1", w), ("2", 1.0 + d)], "id string, weight double") for w, d in ((0.123456781, 0.0), (0.123456784, 1e-12)))
    found = compare_versions(a, b, key="id", fields=["weight"], tolerance={"weight": 1e-9})
    assert [tuple(r) for r in field_report(found, "id").collect()] == [("1", "weight", "differs")]
