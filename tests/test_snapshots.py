from pyspark.sql import functions as F

from framelake.operators.snapshots import snapshot_changes

SHAPE = "s string, f int, at int, p array<struct<id:string,h:float,n:string>>"


def changes(spark, rows, block=8192):
    df = spark.createDataFrame(rows, SHAPE)
    out = snapshot_changes(df, ["s"], "f", "at", "p", F.lower(F.trim(F.col("e.id"))), ["n"], {"h": 0.001}, block)
    return sorted((r.s, r.f, r.key, r.change) for r in out.collect())


def test_added_removed_changed(spark):
    rows = [
        ("r", 0, 1, [("a", 1.0, "x"), (" B", 2.0, None), None, ("a", 1.0, "x")]),
        ("r", 5, 1, [("a", 1.0005, "x"), ("b", 2.0, None)]),
        ("r", 9, 1, [("a", 2.0, "x"), ("b", 2.0, "y"), ("c", None, None), (None, 1.0, "z"), ("  ", 1.0, "z")]),
        ("r", 12, 1, []),
        ("r", 15, 1, None),
        ("r", 20, 1, [("c", float("nan"), None)]),
        ("r", 21, 1, [("c", float("nan"), None)]),
    ]
    want = [("r", 9, "a", "changed"), ("r", 9, "b", "changed"), ("r", 9, "c", "added"), *[("r", 12, k, "removed") for k in "abc"], ("r", 20, "c", "added")]
    assert changes(spark, rows) == want
    assert changes(spark, rows, block=2) == want


def test_latest_delivery_counts(spark):
    rows = [("r", 0, 1, [("a", 1.0, "x")]), ("r", 1, 5, [("a", 9.0, "x")]), ("r", 1, 7, [("a", 1.0, "x")]), ("r", 1, 9, None), (None, 0, 1, [("q", 1.0, "x")]), (None, 3, 1, [])]
    assert [c[1:] for c in changes(spark, rows)] == [(3, "q", "removed")]
    assert changes(spark, []) == []
