import pytest
from pyspark.sql import functions as F

from framelake.operators.orphans import find_orphans, orphan_report


def test_reasons_by_period(spark):
    refs = spark.createDataFrame([("a", 5), ("a", 15), ("a", 25), ("b", 5), ("c", 5), (None, 5), ("  ", 5), ("a", None), ("b", None)], "id string, at int")
    parent = spark.createDataFrame([("a", 10, 20), ("a", 22, None), ("b", 9, None), ("b", 9, None)], "id string, f int, t int")
    found = find_orphans(refs, parent, ["id"], moment="at", valid_from="f", valid_to="t").collect()
    assert sorted((r.id, r.at, r.reason) for r in found) == [("a", 5, "late"), ("b", 5, "late"), ("c", 5, "missing")]
    gone = find_orphans(spark.createDataFrame([("a", 21)], refs.schema), parent, ["id"], moment="at", valid_from="f", valid_to="t").collect()
    assert [r.reason for r in gone] == ["deleted"]


@pytest.mark.parametrize(
    ("match", "want"),
    [("simple", {(1, 9): "missing"}), ("partial", {(1, 9): "missing", (7, None): "missing", (None, 8): "missing"}), ("full", {(1, 9): "missing", (7, None): "partial_null", (None, 8): "partial_null", (1, None): "partial_null", (None, 2): "partial_null"})],
)
def test_composite_keys_by_null_mask(spark, match, want):
    refs = spark.createDataFrame([(1, 2), (1, 9), (7, None), (1, None), (None, 8), (None, 2), (None, None)], "a int, b int")
    parent = spark.createDataFrame([(1, 2), (3, None)], "a int, b int")
    assert {(r.a, r.b): r.reason for r in find_orphans(refs, parent, ["a", "b"], match=match).collect()} == want


def test_empty_tables_repeats_and_clashing_columns(spark):
    refs = spark.createDataFrame([("x", 1), ("x", 1)], "id string, f int")
    empty = spark.createDataFrame([], "id string, f int, t int")
    assert find_orphans(refs, empty, ["id"]).count() == 2
    assert find_orphans(refs.limit(0), empty, ["id"]).count() == 0
    found = find_orphans(refs, spark.createDataFrame([("y", 1, 2)], empty.schema), ["id"], moment="f", valid_from="f", valid_to="t")
    assert orphan_report(found, ["id"]).collect() == [("x", "missing", 2)]
    assert [r.reason for r in find_orphans(refs.withColumn("reason", F.lit("old")), empty, ["id"]).collect()] == ["missing"] * 2
    with pytest.raises(ValueError):
        find_orphans(refs, empty, ["id"], match="other")


def test_open_bounds(spark):
    refs = spark.createDataFrame([("a", 5)], "id string, at int")
    assert find_orphans(refs, spark.createDataFrame([("a", None, 9)], "id string, f int, t int"), ["id"], moment="at", valid_from="f", valid_to="t").count() == 0
    late = find_orphans(refs, spark.createDataFrame([("a", None, 3)], "id string, f int, t int"), ["id"], moment="at", valid_from="f", valid_to="t")
    assert [r.reason for r in late.select(F.col("reason")).collect()] == ["deleted"]
