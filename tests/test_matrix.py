"""Literal fixtures, definitions and invariants of the matrix operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.matrix import SparseMatrix
from latticework.operators import preprocess, stats
from latticework.streaming.chunks import ChunkStats

F1 = (4, 3, [(0, 0, 1.0), (2, 0, 3.0), (2, 1, 4.0), (3, 1, 5.0), (0, 2, 2.0), (3, 2, 6.0)])
F2 = (3, 3, [(0, 0, 1.0), (2, 0, 4.0), (1, 1, 3.0), (0, 2, 2.0), (2, 2, 5.0)])
F5 = (3, 3, [(0, 0, 2.0), (0, 1, 3.0), (1, 1, 4.0), (1, 2, 1.0), (2, 2, 2.0)])


def make(spark, fixture, unique=False):
    m, n, cells = fixture
    entries = spark.createDataFrame(cells or [], "row_id long, col_id long, value double")
    return SparseMatrix.ingest(entries, spark.range(m).withColumnRenamed("id", "row_id"), spark.range(n).withColumnRenamed("id", "col_id"), unique)


def column(df, value=None):
    key = df.columns[0]
    return [tuple(r)[1] if len(r) == 2 else tuple(r)[1:] for r in df.orderBy(key).collect()]


def frame(spark, labels):
    return spark.createDataFrame(list(enumerate(labels)), "axis_id long, batch string")


def dense(fixture):
    m, n, cells = fixture
    x = np.zeros((m, n))
    for i, j, v in cells:
        x[i, j] += v
    return x


def test_counts_and_sums(spark):
    m = make(spark, F1)
    assert column(stats.nonzero(m, "column")) == [2, 2, 2]
    assert column(stats.nonzero(m, "row")) == [2, 0, 2, 2]
    assert column(stats.total(m, "column")) == [4, 9, 8]
    assert column(stats.total(m, "row")) == [3, 0, 7, 11]
    assert column(stats.total_squared(m, "column")) == [10, 41, 40]
    assert column(stats.total_squared(m, "row")) == [5, 0, 25, 61]


def test_variances(spark):
    m = make(spark, F1)
    assert column(stats.variance(m, "column")) == pytest.approx([2, 6.916666666666667, 8])
    assert column(stats.variance(m, "row")) == pytest.approx([1, 0, 4.333333333333333, 10.333333333333334])
    assert column(stats.variance(make(spark, F2), "row")) == pytest.approx([1, 3, 7])
    x = dense(F1)
    assert column(stats.variance(m, "column")) == pytest.approx(list(x.var(axis=0, ddof=1)))
    one = make(spark, (1, 2, [(0, 0, 5.0)]))
    assert column(stats.variance(one, "column")) == [0, 0]


def test_min_max_and_empty(spark):
    m = make(spark, F1)
    assert column(stats.min_max(m, "column")) == [(1, 3), (4, 5), (2, 6)]
    assert column(stats.min_max(m, "row")) == [(1, 2), (None, None), (3, 4), (5, 6)]
    assert column(stats.min_max(m, "row", "sentinel"))[1] == (stats.LARGEST, -stats.LARGEST)
    with pytest.raises(ValueError):
        stats.min_max(m, "row", "zero")
    empty = make(spark, (5, 4, []))
    assert column(stats.nonzero(empty, "column")) == [0] * 4
    assert column(stats.nonzero(empty, "row")) == [0] * 5
    assert column(stats.nonzero(make(spark, (0, 0, [])), "row")) == []


def test_masks(spark):
    m = make(spark, F1)
    rows, cols = [True, True, True, False], [True, False, True]
    assert column(stats.nonzero(m, "column", rows)) == [2, 1, 1]
    assert column(stats.total(m, "column", rows)) == [4, 4, 2]
    assert column(stats.variance_masked(m, "column", rows)) == [1, 0, 0]
    assert column(stats.nonzero(m, "row", cols)) == [2, 0, 1, 1]
    assert column(stats.total(m, "row", cols)) == [3, 0, 3, 6]
    assert column(stats.variance_masked(m, "row", cols)) == [0.25, 0, 0, 0]
    assert column(stats.total(m, "column", [True] * 9)) == column(stats.total(m, "column"))
    assert column(stats.total(m, "column", [False] * 4)) == [0, 0, 0]
    with pytest.raises(ValueError):
        stats.nonzero(m, "column", [True])
    short = spark.createDataFrame([(0, True)], "axis_id long, keep boolean")
    with pytest.raises(ValueError):
        stats.nonzero(m, "row", short)


def test_list_masks_follow_the_ids(spark):
    """By position in the order of ids, wherever these begin and whatever gaps they have."""
    entries = spark.createDataFrame([(1, 10, 1.0), (2, 10, 10.0), (7, 10, 100.0), (2, -5, 3.0)], "row_id long, col_id long, value double")
    m = SparseMatrix.ingest(entries, spark.createDataFrame([(7,), (1,), (2,)], "row_id long"), spark.createDataFrame([(10,), (-5,)], "col_id long"))
    assert column(stats.total(m, "column", [True] * 3)) == [3, 111]
    assert column(stats.total(m, "column", [False, True, True])) == [3, 110]
    assert column(stats.nonzero(m, "row", [True, False])) == [0, 1, 0]
    assert column(stats.total(m, "row", [False, True, True])) == [1, 10, 100]


def test_variance_of_large_values(spark):
    """Offsets much larger than the spread don't drown it."""
    big = 1e9
    m = make(spark, (3, 3, [(i, 0, big + i) for i in range(3)] + [(0, j, big + j) for j in (1, 2)]))
    rows, cols = [True] * 3, [True] * 3
    assert column(stats.variance(m, "column"))[0] == pytest.approx(1) and column(stats.variance(m, "row"))[0] == pytest.approx(1)
    assert column(stats.variance_masked(m, "column", rows))[0] == pytest.approx(2 / 3) and column(stats.variance_masked(m, "row", cols))[0] == pytest.approx(2 / 3)
    x = np.array([big + 1, 0, 0])
    assert column(stats.variance(m, "column"))[1] == pytest.approx(x.var(ddof=1))
    chunks = [m.entries.filter(F.col("row_id") == i) for i in range(3)]
    assert column(ChunkStats(m, "column", chunks).variance())[0] == pytest.approx(2 / 3)
    assert column(ChunkStats(m, "row", [m.entries.filter("col_id < 1"), m.entries.filter("col_id >= 1")]).variance())[0] == pytest.approx(2 / 3)
    labels = frame(spark, "aaa")
    assert stats.var_batch_row(m, labels).filter("col_id = 0").first()["variance"] == pytest.approx(1)
    assert stats.var_batch_col(m, labels).filter("row_id = 0").first()["variance"] == pytest.approx(1)


def test_batches(spark):
    m = make(spark, F1)
    rows, cols = frame(spark, "aabb"), frame(spark, "xxy")

    def by(df):
        out = {}
        for b, _, v in sorted(map(tuple, df.collect())):
            out.setdefault(b, []).append(v)
        return out

    assert by(stats.var_batch_row(m, rows)) == {"a": [0, 0, 0], "b": [0, 0.5, 0]}
    assert by(stats.var_batch_col(m, cols)) == {"x": [0, 0, 0.5, 0], "y": [0, 0, 0, 0]}
    assert by(stats.mean_batch_col(m, rows)) == {"a": [0.5, 0, 1], "b": [1.5, 4.5, 3]}
    assert by(stats.mean_batch_col(m, rows, denominator="stored")) == {"a": [1, 0, 2], "b": [3, 4.5, 6]}
    assert by(stats.mean_batch_row(m, cols)) == {"x": [0.5, 0, 3.5, 2.5], "y": [2, 0, 0, 6]}
    assert by(stats.mean_batch_row(m, cols, denominator="stored")) == {"x": [1, 0, 3.5, 5], "y": [2, 0, 0, 6]}
    assert stats.var_batch_row(m, rows, dense=False).count() == 5
    with pytest.raises(ValueError):
        stats.var_batch_row(m, frame(spark, "aab"))
    with pytest.raises(ValueError):
        stats.var_batch_row(m, frame(spark, "aabb").union(frame(spark, "z")))


def test_top_sums(spark):
    m = make(spark, F1)
    assert column(stats.sum_row_n_top(m, 1)) == [2, 0, 4, 6]
    assert column(stats.sum_row_n_top(m, 5)) == [3, 0, 7, 11]
    assert column(stats.sum_row_n_top(m, 0)) == [0, 0, 0, 0]


def test_band_matrix(spark):
    m = make(spark, (1000, 1000, [(i + k, i, 1.0) for i in range(999) for k in (0, 1)]))
    counts = column(stats.nonzero(m, "column"))
    assert len(counts) == 1000 and counts[500] == 2 and counts[999] == 0


def test_ingest(spark):
    m = make(spark, (2, 2, [(0, 0, 1.0), (0, 0, 2.0), (1, 1, 0.0)]))
    assert column(stats.total(m, "row")) == [3, 0]
    assert column(stats.nonzero(m, "column")) == [1, 1]  # a stored zero counts
    assert column(stats.nonzero(m.drop_zeros(), "column")) == [1, 0]
    assert column(stats.total(m.transpose(), "column")) == [3, 0]
    for bad in (None, float("nan")):
        with pytest.raises(Exception, match="null or NaN"):
            make(spark, (1, 1, [(0, 0, bad)])).entries.collect()
    with pytest.raises(ValueError):
        make(spark, (1, 1, [(0, 3, 1.0)])).check_bounds()
    with pytest.raises(ValueError):
        stats.nonzero(m, "diagonal")


def test_normalize(spark):
    def cells(m):
        return {(r[0], r[1]): r[2] for r in m.entries.collect()}

    m = make(spark, F5)
    got = cells(preprocess.normalize(m, None, 1.0, "column"))
    assert got == pytest.approx({(0, 0): 1, (0, 1): 3 / 7, (1, 1): 4 / 7, (1, 2): 1 / 3, (2, 2): 2 / 3})
    got = cells(preprocess.normalize(m, None, 1.0, "row"))
    assert got == pytest.approx({(0, 0): 0.4, (0, 1): 0.6, (1, 1): 0.8, (1, 2): 0.2, (2, 2): 1.0})
    odd = make(spark, (2, 2, [(0, 0, 2.0), (0, 1, -2.0), (1, 0, 3.0)]))
    assert cells(preprocess.normalize(odd, None, 1.0, "row")) == {(0, 0): 2, (0, 1): -2, (1, 0): 1}
    zeros = make(spark, (2, 2, [(0, 0, 0.0), (1, 1, 0.0)]))
    assert cells(preprocess.log1p_normalize(zeros)) == {(0, 0): 0, (1, 1): 0}
    low = make(spark, (1, 2, [(0, 0, -1.0), (0, 1, -2.0)]))
    with pytest.raises(Exception, match="above -1"):
        preprocess.log1p_normalize(low).entries.collect()
    got = cells(preprocess.log1p_normalize(low, strict=False))
    assert got[0, 0] == float("-inf") and np.isnan(got[0, 1])


def test_normalize_dense(spark):
    v = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "row_id long, features array<double>")
    rows = spark.createDataFrame([(0, 3.0), (1, 7.0)], "row_id long, sum double")
    got = [r[1] for r in preprocess.normalize_dense(v, rows, 1.0, "row").orderBy("row_id").collect()]
    assert got == [pytest.approx([1 / 3, 2 / 3]), pytest.approx([3 / 7, 4 / 7])]
    got = [r[1] for r in preprocess.normalize_dense(v, [4.0, 6.0], 1.0, "column").orderBy("row_id").collect()]
    assert got == [pytest.approx([1 / 4, 2 / 6]), pytest.approx([3 / 4, 4 / 6])]
    with pytest.raises(ValueError):
        preprocess.normalize_dense(v, [1.0], 1.0, "column")
    with pytest.raises(ValueError):
        preprocess.normalize_dense(v, rows.limit(1), 1.0, "row")
    z = spark.createDataFrame([(0, [0.0, 1.0, -1.0])], "row_id long, features array<double>")
    got = preprocess.normalize_dense(z, None, 1.0, "row").first()[1]
    assert np.isnan(got[0]) and got[1] == float("inf") and got[2] == float("-inf")


def test_invariants(spark):
    rng = np.random.default_rng(3)
    cells = [(int(i), int(j), float(v)) for i, j, v in zip(rng.integers(0, 30, 200), rng.integers(0, 17, 200), rng.normal(size=200))]
    m = make(spark, (30, 17, cells))
    assert sum(column(stats.total(m, "row"))) == pytest.approx(sum(column(stats.total(m, "column"))))
    x = dense((30, 17, cells))
    assert column(stats.variance(m, "row")) == pytest.approx(list(x.var(axis=1, ddof=1)))
    positive = make(spark, (30, 17, [(i, j, abs(v)) for i, j, v in cells]))
    sums = column(stats.total(preprocess.normalize(positive, None, 5.0, "row"), "row"))
    assert all(s == pytest.approx(5) or s == 0 for s in sums)
    shuffled = m.with_entries(m.entries.repartition(7, F.rand(1)))
    assert column(stats.total(shuffled, "row")) == pytest.approx(column(stats.total(m, "row")))
