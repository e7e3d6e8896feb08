"""The queries ``opN_<name>``: each applies one operator to its whole table, and the SQL that says
the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, quality, warc_zip
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the quality rules for all documents."""
    from .quality import quality_verdicts

    return quality_verdicts(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    from .simhash import simhash_groups

    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document under a model of those whose crc32 of the id isn't 2 modulo 7."""
    from .lm_scoring import train_and_score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return train_and_score(docs.withColumn("held_out", held_out), ~F.col("held_out"), keep=["doc_id", "held_out"])


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to ZIP packages of WARC records and read back."""
    from .warc_zip import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages")).drop("payload")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op7_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings that play the embeddings, fingerprinted, and the groups of those that align: a row for each."""
    from .chroma import group_recordings, recordings

    return group_recordings(recordings(table(spark, sf_dir, "embeddings")), "vec_id").withColumnRenamed("id", "vec_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents. The counts and the digest are the base patterns'; ``spans`` has
    the network's too."""
    from .pii import find_pii

    return find_pii(table(spark, sf_dir, "documents")).drop("masked")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, replicated so that sources take their target weights, shuffled."""
    from .mixing import poisson_mix

    mixed = poisson_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", "source", F.col("_rate").alias("rate"), F.col("_copies").alias("copies"), F.col("_copy").alias("copy"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("_order").alias("shuffle_key"),
    )


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose crc32 of the id isn't a multiple of 5."""
    from .langid import fit, identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = fit(docs.filter(fold != 0), key=F.col("doc_id"))
    found = identify(docs.withColumn("held_out", F.coalesce(fold == 0, F.lit(False))), model, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_quality": op1_quality, "op2_simhash": op2_simhash, "op3_lm": op3_lm, "op4_html": op4_html, "op5_warc": op5_warc, "op6_packing": op6_packing, "op7_chroma": op7_chroma, "op8_pii": op8_pii, "op9_mixing": op9_mixing, "op10_langid": op10_langid}

ORACLE_SQL: dict[str, str] = {"op1_quality": quality.ORACLE_SQL, "op5_warc": warc_zip.ORACLE_SQL, "op9_mixing": mixing.ORACLE_SQL}
