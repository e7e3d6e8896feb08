"""A corpus pipeline: language, near-duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents`` and no others: columns that a table has besides, whatever their
names, don't go on. Every stage takes an empty table and gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import table, write_shared
from latticework.llm.langid import fit, identify
from latticework.llm.mixing import poisson_mix
from latticework.llm.packing import pack_documents
from latticework.llm.pii import find_pii
from latticework.llm.simhash import simhash_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go (null, empty, no letter); the language found becomes the document's.

    A text of several languages stays, under the one that holds most of its letters. A null lang, source,
    doc_id or n_chars changes nothing; repeated rows stay repeated; ties go to the language first in order.
    With no labelled row no language is known and no row stays.
    """
    docs = docs.select(*COLUMNS)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = fit(docs.filter(fold != 0), key=F.col("doc_id"))
    found = identify(docs, model, keep=["doc_id", "text", "source", "n_chars"])
    return found.filter(F.col("lang_pred") != "und").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id, any one of
    several with it, one without an id where none has one. Null and empty texts are one group; texts that
    share an id are told apart."""
    return simhash_dedup(docs.select(*COLUMNS))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in angle brackets; n_chars follows the text. A null text stays
    null, with a null n_chars; an empty one stays empty; repeated rows come out alike."""
    found = find_pii(docs.select(*COLUMNS), keep=["lang", "source"])
    return found.select("doc_id", F.col("masked").alias("text"), "lang", "source", F.char_length("masked").cast("long").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or drop out so that sources take their target weights. A null source is a source;
    a null or empty text counts nothing; rows with equal ids are drawn alike."""
    return poisson_mix(docs.select(*COLUMNS), details=False)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces placed in sequences of 1024 tokens. A null or empty text is its end id alone;
    repeated rows are packed as often as they come; a null doc_id stays null."""
    return pack_documents(docs.select(*COLUMNS))


STAGES = [
    ("language_id", language_stage),
    ("simhash_dedup", dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express these stages; they are tested against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
