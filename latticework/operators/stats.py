"""Statistics per row or column.

One aggregation gives all moments of an axis (``axis_stats``); each statistic is a projection of it,
so that several of them share one shuffle. Variances come in three definitions:

- over all cells, sample (``variance``): implicit zeros count, divisor N - 1;
- over stored entries, population (masked and chunked);
- over stored entries, sample (by batch).

None is a difference of large sums: a group's squared deviations from its own mean (``m2``) are summed,
and parts with other means (chunks, implicit zeros) are added by the distance of the means.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.matrix import SparseMatrix, axis_key, other_axis

LARGEST = 1.7976931348623157e308


def squared_deviations(value: Column | str = "value") -> Column:
    """Sum of squared deviations from the mean, of a group."""
    return F.var_pop(value) * F.count(value)


def moments() -> list[Column]:
    v = F.col("value")
    return [F.count("*").alias("k"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), squared_deviations().alias("m2"), F.min(v).alias("mn"), F.max(v).alias("mx")]


def merged_moments() -> list[Column]:
    """Moments of moments: what chunks have found, put together. A key has one row for each chunk."""

    def add(acc: Column, x: Column) -> Column:
        k = acc["k"] + x["k"]
        apart = x["s"] / x["k"] - acc["mean"]
        return F.struct(k.alias("k"), (acc["mean"] + apart * x["k"] / k).alias("mean"), (acc["m2"] + x["m2"] + apart * apart * acc["k"] * x["k"] / k).alias("m2"))

    start = F.struct(F.lit(0.0).alias("k"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    m2 = F.aggregate(F.collect_list(F.struct(F.col("k").cast("double").alias("k"), "s", "m2")), start, add, lambda acc: acc["m2"])
    return [F.sum("k").alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"), m2.alias("m2"), F.min("mn").alias("mn"), F.max("mx").alias("mx")]


def as_mask(m: SparseMatrix, axis: str, mask: DataFrame | Sequence[bool]) -> DataFrame:
    """(key) of the kept members of an axis. A mask is a DataFrame (axis_id, keep), or a sequence of
    booleans by position in the order of the axis's ids, for axes that the driver can hold as well as the
    sequence. It has to cover the axis, and what goes beyond it is ignored."""
    key = axis_key(axis)
    if not isinstance(mask, DataFrame):
        values = list(mask)
        if len(values) < m.size(axis):
            raise ValueError(f"the mask has {len(values)} entries; the {axis} axis has {m.size(axis)}")
        ids = m.axis(axis).orderBy(key).toArrow().column(0).to_pylist()  # no more than the mask has entries
        kept = pa.table({key: pa.array([i for i, x in zip(ids, values) if x], pa.int64())})
        return m.entries.sparkSession.createDataFrame(kept)
    if m.axis(axis).join(mask.select(F.col("axis_id").alias(key)), key, "left_anti").limit(1).count():
        raise ValueError(f"the mask doesn't cover the {axis} axis")
    return mask.filter("keep").select(F.col("axis_id").cast("long").alias(key))


def masked_entries(m: SparseMatrix, axis: str, mask: DataFrame | Sequence[bool]) -> DataFrame:
    """Entries whose member of ``axis`` the mask keeps."""
    return m.entries.join(as_mask(m, axis, mask), axis_key(axis), "left_semi")


def axis_stats(m: SparseMatrix, axis: str, mask: DataFrame | Sequence[bool] | None = None) -> DataFrame:
    """(key, k, s, q, m2, mn, mx) for each member of ``axis``: stored entries, sum, sum of squares, squared
    deviations, least and largest. A mask is over the other axis. Members without entries have zeros and null
    extremes."""
    key = axis_key(axis)
    entries = m.entries if mask is None else masked_entries(m, other_axis(axis), mask)
    return densify(m, axis, entries.groupBy(key).agg(*moments()))


def densify(m: SparseMatrix, axis: str, stats: DataFrame) -> DataFrame:
    zero = lambda c, z: F.coalesce(c, F.lit(z)).alias(c)
    return m.axis(axis).join(stats, axis_key(axis), "left").select(axis_key(axis), zero("k", 0), zero("s", 0.0), zero("q", 0.0), zero("m2", 0.0), "mn", "mx")


def nonzero(m: SparseMatrix, axis: str, mask=None) -> DataFrame:
    return axis_stats(m, axis, mask).select(axis_key(axis), F.col("k").alias("nonzero"))


def total(m: SparseMatrix, axis: str, mask=None) -> DataFrame:
    return axis_stats(m, axis, mask).select(axis_key(axis), F.col("s").alias("sum"))


def total_squared(m: SparseMatrix, axis: str) -> DataFrame:
    return axis_stats(m, axis).select(axis_key(axis), F.col("q").alias("sum_squared"))


def all_variance(n: int) -> Column:
    """Sample variance of n cells of which k are stored; 0 for n <= 1. The others are zeros."""
    if n <= 1:
        return F.lit(0.0)
    k = F.col("k").cast("double")
    mean = F.coalesce(F.try_divide(F.col("s"), k), F.lit(0.0))
    return (F.col("m2") + mean * mean * k * ((float(n) - k) / float(n))) / float(n - 1)


def stored_variance(ddof: int = 0) -> Column:
    """Variance of the stored entries with divisor k - ddof; 0 where that isn't positive."""
    k = F.col("k").cast("double")
    return F.when(k > ddof, F.try_divide(F.col("m2"), k - float(ddof))).otherwise(F.lit(0.0))


def variance(m: SparseMatrix, axis: str) -> DataFrame:
    """Over all cells of a row or column, implicit zeros included."""
    return axis_stats(m, axis).select(axis_key(axis), all_variance(m.size(other_axis(axis))).alias("variance"))


def variance_masked(m: SparseMatrix, axis: str, mask) -> DataFrame:
    """Population variance over the stored entries that the mask on the other axis keeps."""
    return axis_stats(m, axis, mask).select(axis_key(axis), stored_variance().alias("variance"))


def extremes(empty: str = "null") -> list[Column]:
    if empty not in ("null", "sentinel"):
        raise ValueError("empty must be 'null' or 'sentinel'")
    low, high = F.col("mn"), F.col("mx")
    if empty == "sentinel":
        low, high = F.coalesce(low, F.lit(LARGEST)), F.coalesce(high, F.lit(-LARGEST))
    return [low.alias("min_value"), high.alias("max_value")]


def min_max(m: SparseMatrix, axis: str, empty: str = "null") -> DataFrame:
    """Over stored entries. Where there is none: nulls, or with ``empty="sentinel"`` the largest and
    the smallest double."""
    return axis_stats(m, axis).select(axis_key(axis), *extremes(empty))


# --- batches --------------------------------------------------------------------------------------


def _labelled(m: SparseMatrix, label_axis: str, labels: DataFrame, check: bool) -> DataFrame:
    key = axis_key(label_axis)
    labels = labels.select(F.col("axis_id").cast("long").alias(key), "batch")
    if check:
        per = m.axis(label_axis).join(labels, key, "left").groupBy(key).agg(F.count("batch").alias("n"))
        if per.filter("n <> 1").limit(1).count():
            raise ValueError(f"each member of the {label_axis} axis needs exactly one label")
    return m.axis(label_axis).join(labels, key)


def _by_batch(m: SparseMatrix, label_axis: str, labels: DataFrame, dense: bool) -> DataFrame:
    """(batch, key of the other axis, k, s, m2)."""
    out = axis_key(other_axis(label_axis))
    stats = m.entries.join(labels, axis_key(label_axis)).groupBy("batch", out).agg(F.count("*").alias("k"), F.sum("value").alias("s"), squared_deviations().alias("m2"))
    if not dense:
        return stats.join(m.axis(other_axis(label_axis)), out, "left_semi")
    grid = labels.select("batch").distinct().crossJoin(m.axis(other_axis(label_axis)))  # the result's own rows
    zero = lambda c, z: F.coalesce(c, F.lit(z)).alias(c)
    return grid.join(stats, ["batch", out], "left").select("batch", out, zero("k", 0), zero("s", 0.0), zero("m2", 0.0))


def batch_variance(m: SparseMatrix, label_axis: str, labels: DataFrame, dense: bool = True, check: bool = True) -> DataFrame:
    """(batch, key, variance): labels (axis_id, batch) are on ``label_axis``, results on the other axis.
    Sample variance over stored entries. ``dense=False`` leaves out pairs without entries."""
    stats = _by_batch(m, label_axis, _labelled(m, label_axis, labels, check), dense)
    return stats.select("batch", axis_key(other_axis(label_axis)), stored_variance(1).alias("variance"))


def batch_mean(m: SparseMatrix, label_axis: str, labels: DataFrame, denominator: str = "all", dense: bool = True, check: bool = True) -> DataFrame:
    """(batch, key, mean): with ``denominator="all"`` over all members of a batch, implicit zeros
    included; with ``"stored"`` over stored entries."""
    labelled = _labelled(m, label_axis, labels, check)
    stats = _by_batch(m, label_axis, labelled, dense)
    key = axis_key(other_axis(label_axis))
    if denominator == "stored":
        return stats.select("batch", key, F.coalesce(F.try_divide("s", F.col("k").cast("double")), F.lit(0.0)).alias("mean"))
    if denominator != "all":
        raise ValueError("denominator must be 'all' or 'stored'")
    sizes = labelled.groupBy("batch").agg(F.count("*").cast("double").alias("members"))
    return stats.join(sizes, "batch").select("batch", key, (F.col("s") / F.col("members")).alias("mean"))


def var_batch_row(m: SparseMatrix, labels: DataFrame, **kw) -> DataFrame:
    """Labels on rows, results over columns."""
    return batch_variance(m, "row", labels, **kw)


def var_batch_col(m: SparseMatrix, labels: DataFrame, **kw) -> DataFrame:
    """Labels on columns, results over rows."""
    return batch_variance(m, "column", labels, **kw)


def mean_batch_row(m: SparseMatrix, labels: DataFrame, **kw) -> DataFrame:
    """Labels on columns, results over rows: means are named after what they are of."""
    return batch_mean(m, "column", labels, **kw)


def mean_batch_col(m: SparseMatrix, labels: DataFrame, **kw) -> DataFrame:
    """Labels on rows, results over columns."""
    return batch_mean(m, "row", labels, **kw)


# --- largest entries ------------------------------------------------------------------------------


def sum_row_n_top(m: SparseMatrix, n: int) -> DataFrame:
    """Sum of each row's n largest stored values; 0 for an empty row or n = 0."""
    if n < 0:
        raise ValueError("n must not be negative")
    rank = F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("value")))
    top = m.entries.withColumn("r", rank).filter(F.col("r") <= n).groupBy("row_id").agg(F.sum("value").alias("s"))
    return m.axis("row").join(top, "row_id", "left").select("row_id", F.coalesce("s", F.lit(0.0)).alias("top_sum"))
