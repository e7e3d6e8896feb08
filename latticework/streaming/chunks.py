"""Statistics of a matrix that arrives in chunks.

A chunk's moments are merged with those of other chunks by sums, distances of means and extremes, so any number of
chunks gives what the whole would. Chunks are a list of DataFrames, or a stream: then the same
aggregation runs in Structured Streaming, whose state is one row per member of the axis.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.matrix import SparseMatrix, axis_key
from latticework.operators.stats import densify, extremes, merged_moments, moments, stored_variance
from latticework.session import delete_on_exit, shared_path


def chunk_state(entries: DataFrame, axis: str) -> DataFrame:
    """(key, k, s, q, m2, mn, mx) of one chunk of entries."""
    return entries.groupBy(axis_key(axis)).agg(*moments())


def merge_states(states: Sequence[DataFrame], axis: str) -> DataFrame:
    """One state from several. Merging is associative, so states of merged states may be merged."""
    if not states:
        raise ValueError("no chunk to merge")
    return reduce(DataFrame.unionByName, states).groupBy(axis_key(axis)).agg(*merged_moments())


class ChunkStats:
    """Statistics over the members of ``axis`` of a matrix given by its axes and chunks of entries.
    Members that the matrix doesn't have are left out."""

    def __init__(self, m: SparseMatrix, axis: str, chunks: Sequence[DataFrame]):
        self.key = axis_key(axis)
        self.stats = densify(m, axis, merge_states([chunk_state(c, axis) for c in chunks], axis))

    def nonzero(self) -> DataFrame:
        return self.stats.select(self.key, F.col("k").alias("nonzero"))

    def total(self) -> DataFrame:
        return self.stats.select(self.key, F.col("s").alias("sum"))

    def variance(self) -> DataFrame:
        """Population variance over stored entries."""
        return self.stats.select(self.key, stored_variance().alias("variance"))

    def min_max(self, empty: str = "null") -> DataFrame:
        return self.stats.select(self.key, *extremes(empty))


def stream_stats(entries: DataFrame, axis: str) -> DataFrame:
    """Running (key, k, s, q, m2, mn, mx, variance) of a stream of entries; for ``outputMode`` complete or
    update. The state is bounded by the axis, so no watermark is needed."""
    return chunk_state(entries, axis).withColumn("variance", stored_variance())


def run_stream(stats: DataFrame) -> DataFrame:
    """Run a query of running statistics over all there is to read, and return the table after the last batch. Progress,
    state and result are in shared storage, so a query that is started again goes on where it was."""
    spark = stats.sparkSession
    out, progress = shared_path(spark, "stream"), shared_path(spark, "progress")
    for path in (out, progress):
        delete_on_exit(spark, path)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stats.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    try:
        return spark.read.schema(stats.schema).parquet(out)
    except AnalysisException:  # nothing to read, no batch
        return spark.createDataFrame([], stats.schema)
