import pytest

from latticework.llm import common


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_split_join(spark, monkeypatch, how):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    left = spark.createDataFrame([(k, i) for k, n in ((1, 30), (2, 3), (3, 8), (4, 1), (None, 9)) for i in range(n)], "k long, i long")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (9, "d")], "k long, v string")
    counts = left.groupBy("k").count().withColumnRenamed("count", "n")
    got = common.hot_split_join(left, right, "k", counts, 51, how)
    assert rows(got) == rows(left.join(right, "k", how))
    assert "Union" in got._jdf.queryExecution().optimizedPlan().toString()


def test_summary_join_beyond_the_broadcast_bound(spark, monkeypatch):
    left = spark.createDataFrame([("x" if i % 3 else "y", i) for i in range(300)] + [("z", 1)], "g string, i long")
    right = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "g string, r double")
    want = rows(left.join(right, "g", "left").select("g", "i", "r"))
    assert rows(common.join_small(left, right, ["g"]).select("g", "i", "r")) == want
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    assert rows(common.join_small(left, right, ["g"]).select("g", "i", "r")) == want


def test_shared_tables(spark):
    df = spark.createDataFrame([(1, None)], "a long, b string")
    back = common.write_shared(df, "t")
    assert back.schema.names == ["a", "b"] and rows(back) == rows(df)
    assert common.shared_path(spark, "t") != common.shared_path(spark, "t")
    assert all(common.open_filesystem(x)[1] == "/tmp/x" for x in ("file:///tmp/x", "file:/tmp/x", "/tmp/x"))
    assert common.shared_root(spark).startswith("file:/")  # named in full
    with pytest.raises(ValueError, match="viewfs"):
        common.open_filesystem("viewfs://in/x")


def test_names_that_are_free(spark):
    df = spark.createDataFrame([(1, 2)], "_row long, _ROW_ long")
    assert common.free_name(df, "_row") == "_row__" and common.free_name(df, "k") == "k"
