"""The matrix: entries in coordinate form beside the axes that say which rows and columns exist."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = {"row": "row_id", "column": "col_id"}


def axis_key(axis: str) -> str:
    """Key column of an axis named ``"row"`` or ``"column"``."""
    if axis not in AXES:
        raise ValueError(f"axis must be 'row' or 'column', not {axis!r}")
    return AXES[axis]


def other_axis(axis: str) -> str:
    axis_key(axis)
    return "column" if axis == "row" else "row"


class SparseMatrix:
    """An immutable sparse matrix.

    ``entries`` has (row_id, col_id, value): what is stored, each coordinate once; a stored zero
    counts as stored. ``rows`` and ``cols`` have every row_id and col_id, so that rows and columns
    without entries appear in results. Entries outside of the axes take no part in results of that
    axis. Everything is lazy; nothing is collected.
    """

    def __init__(self, entries: DataFrame, rows: DataFrame, cols: DataFrame):
        self.entries, self.rows, self.cols = entries, rows, cols

    @classmethod
    def ingest(cls, triplets: DataFrame, rows: DataFrame, cols: DataFrame, unique: bool = False) -> SparseMatrix:
        """From triplets (row_id, col_id, value). Values at one coordinate are summed, unless the caller
        knows coordinates to be ``unique``, which saves a shuffle. A null or NaN value raises when
        it is read."""
        value = F.col("value").cast("double")
        good = F.when(value.isNull() | F.isnan(value), F.raise_error(F.lit("a matrix value is null or NaN")).cast("double")).otherwise(value)
        entries = triplets.select(F.col("row_id").cast("long"), F.col("col_id").cast("long"), good.alias("value"))
        if not unique:
            entries = entries.groupBy("row_id", "col_id").agg(F.sum("value").alias("value"))
        return cls(entries, rows.withColumn("row_id", F.col("row_id").cast("long")), cols.withColumn("col_id", F.col("col_id").cast("long")))

    @cached_property
    def nrows(self) -> int:
        return self.rows.count()

    @cached_property
    def ncols(self) -> int:
        return self.cols.count()

    def size(self, axis: str) -> int:
        return self.nrows if axis_key(axis) == "row_id" else self.ncols

    def axis(self, axis: str) -> DataFrame:
        """The ids of an axis."""
        key = axis_key(axis)
        return (self.rows if key == "row_id" else self.cols).select(key)

    def with_entries(self, entries: DataFrame) -> SparseMatrix:
        return SparseMatrix(entries, self.rows, self.cols)

    def drop_zeros(self) -> SparseMatrix:
        """Without the zeros that are stored."""
        return self.with_entries(self.entries.filter("value <> 0"))

    def transpose(self) -> SparseMatrix:
        swap = lambda df: df.withColumnsRenamed({"row_id": "_r", "col_id": "row_id"}).withColumnRenamed("_r", "col_id")
        return SparseMatrix(swap(self.entries).select("row_id", "col_id", "value"), self.cols.withColumnRenamed("col_id", "row_id"), self.rows.withColumnRenamed("row_id", "col_id"))

    def check_bounds(self) -> None:
        """Raise ValueError if an entry lies outside of the axes."""
        for axis in AXES:
            if self.entries.join(self.axis(axis), axis_key(axis), "left_anti").limit(1).count():
                raise ValueError(f"an entry lies outside of the {axis} axis")

    def dense_rows(self) -> DataFrame:
        """(row_id, cols, values): each row's entries as arrays in column order; rows without entries
        are absent."""
        cells = F.sort_array(F.collect_list(F.struct("col_id", "value")))
        grouped = self.entries.groupBy("row_id").agg(cells.alias("c"))
        return grouped.select("row_id", F.col("c.col_id").alias("cols"), F.col("c.value").alias("values"))
