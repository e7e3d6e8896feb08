"""Scaling to target sums and the logarithm of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.matrix import SparseMatrix, axis_key
from latticework.operators.stats import total


def normalize(m: SparseMatrix, sums: DataFrame | None, target: float, axis: str) -> SparseMatrix:
    """Scale each member of ``axis`` by target / sum. ``sums`` is (key, sum); None computes them.
    Members whose factor isn't positive, or that ``sums`` leaves out, stay as they are."""
    key = axis_key(axis)
    sums = (total(m, axis) if sums is None else sums).select(key, F.col("sum").alias("_sum"))
    factor = F.try_divide(F.lit(float(target)), F.col("_sum"))
    value = F.when((F.col("_sum") > 0) & (factor > 0), F.col("value") * factor).otherwise(F.col("value"))
    return m.with_entries(m.entries.join(sums, key, "left").select("row_id", "col_id", value.alias("value")))


def log1p_value(value: Column, strict: bool = True) -> Column:
    """ln(1 + x). At and below -1 it raises, or gives -Infinity and NaN unless ``strict``."""
    low = F.raise_error(F.lit("log1p needs values above -1")).cast("double") if strict else F.when(value == -1, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(value <= -1, low).otherwise(F.log1p(value))


def log1p_normalize(m: SparseMatrix, strict: bool = True) -> SparseMatrix:
    """ln(1 + x) of the stored values; what isn't stored stays zero."""
    return m.with_entries(m.entries.select("row_id", "col_id", log1p_value(F.col("value"), strict).alias("value")))


def _divided(x: Column, s: Column, target: float, on_zero: str) -> Column:
    """x * target / s; at s = 0 the quotient of doubles, or null."""
    if on_zero == "null":
        return F.try_divide(x * target, s)
    if on_zero != "nan_inf":
        raise ValueError("on_zero must be 'nan_inf' or 'null'")
    up = x * target
    at_zero = F.when(up > 0, F.lit(float("inf"))).when(up < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(s == 0, at_zero).otherwise(x * F.try_divide(F.lit(float(target)), s))


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def normalize_dense(vectors: DataFrame, sums: DataFrame | list[float] | None, target: float, axis: str, id_col: str = "row_id", features: str = "features", on_zero: str = "nan_inf") -> DataFrame:
    """Dense rows (id, features) scaled to target sums per row or column. For rows ``sums`` is a
    DataFrame (id, sum), for columns a list as long as the features; None computes them."""
    x = F.col(features)
    if axis_key(axis) == "row_id":
        if sums is None:
            rows = vectors.withColumn("_sum", array_sum(x))
        else:
            rows = vectors.join(sums.select(id_col, F.col("sum").alias("_sum")), id_col, "left")
            if sums.count() != vectors.count():
                raise ValueError("sums and rows differ in length")
        return rows.select(id_col, F.transform(x, lambda v: _divided(v, F.col("_sum"), target, on_zero)).alias(features))
    if sums is None:
        cells = vectors.select(F.posexplode(x).alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("s"))
        sums = [r[0] for r in cells.orderBy("pos").select("s").collect()]  # one number per feature
    elif (width := vectors.select(F.max(F.size(x))).first()[0]) is not None and width != len(sums):
        raise ValueError(f"{len(sums)} sums for {width} columns")
    factors = F.array(*[F.lit(float(s)) for s in sums])
    return vectors.select(id_col, F.zip_with(x, factors, lambda v, s: _divided(v, s, target, on_zero)).alias(features))
