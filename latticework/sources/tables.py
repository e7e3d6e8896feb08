"""Adapters from the sample tables to matrices and vectors. Only the columns used are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.matrix import SparseMatrix
from latticework.session import share_package


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_supp(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Quantity by part (rows) and supplier (columns)."""
    items = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("row_id"), F.col("l_suppkey").alias("col_id"), F.col("l_quantity").alias("value"))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"))
    cols = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("col_id"))
    return SparseMatrix.ingest(items, rows, cols)


def order_part(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Quantity by order (rows, some without items) and part (columns)."""
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("col_id"), F.col("l_quantity").alias("value"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    cols = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("col_id"))
    return SparseMatrix.ingest(items, rows, cols)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, features) of the embeddings, as doubles."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))


def embedding_matrix(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    v = vectors(spark, sf_dir)
    cells = v.select(F.col("id").alias("row_id"), F.posexplode("features").alias("col_id", "value"))
    width = v.select(F.max(F.size("features"))).first()[0] or 0
    return SparseMatrix.ingest(cells, v.select(F.col("id").alias("row_id")), spark.range(width).withColumnRenamed("id", "col_id"), unique=True)


def _event_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, col_id): a number for each type, in their order; a handful."""
    types = [r[0] for r in read(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()]
    return spark.createDataFrame([(t, i) for i, t in enumerate(types)], "event_type string, col_id long")


def user_event(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Value by user (rows) and type of event (columns)."""
    cols = _event_columns(spark, sf_dir)
    events = read(spark, sf_dir, "events")
    entries = events.join(F.broadcast(cols), "event_type").select(F.col("user_id").alias("row_id"), "col_id", "value")
    return SparseMatrix.ingest(entries, events.select(F.col("user_id").alias("row_id")).distinct(), cols.select("col_id"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries (row_id, col_id, value) of ``user_event`` as a stream of files, an entry for each event."""
    # a pattern, because a stream takes a single file only by one
    stream = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    return stream.join(F.broadcast(_event_columns(spark, sf_dir)), "event_type").select(F.col("user_id").alias("row_id"), "col_id", "value")


def doc_term(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Counts of words by document (rows) and word (columns): wide and sparse. A word's number is the first 60 bits
    of its MD5, so that no dictionary has to be built."""
    docs = read(spark, sf_dir, "documents")
    words = docs.select(F.col("doc_id").alias("row_id"), F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("term")).filter("term <> ''")
    counts = words.groupBy("row_id", "term").agg(F.count("*").cast("double").alias("value"))
    entries = counts.select("row_id", F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 15), 16, 10).cast("long").alias("col_id"), "value")
    return SparseMatrix.ingest(entries, docs.select(F.col("doc_id").alias("row_id")), entries.select("col_id").distinct(), unique=True)
