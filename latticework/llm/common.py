"""Helpers that the training-data operators share: table reads, joins that stay even when a few keys hold
most rows, and files in shared storage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.session import delete_on_exit, share_package, shared_path, shared_root, write_shared  # noqa: F401

#: A side is broadcast only when it was counted and holds at most this many rows.
BROADCAST_ROWS = 200_000
#: A key is hot when it holds at least one row in this many, so there are never more hot keys.
HOT_SHARE = 1_000
#: ... and at least this many rows.
HOT_ROWS = 256
#: parts that a group of rows is dealt to where a summary is too large to broadcast
SALT = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores behind it: no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(df: DataFrame, name: str = "_row") -> DataFrame:
    """A key for each row, so that repeated ids stay apart. A task that runs again reads the
    same split in the same order and gives the same keys."""
    return df.withColumn(name, F.monotonically_increasing_id())


def hot_split_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right`` (one row per key) when a few keys may hold most of ``left``.

    ``counts`` has (key, n): rows of ``left`` for each key. At most HOT_SHARE keys can each hold
    one row in HOT_SHARE, so the hot keys are few at any size and their rows of ``right`` are
    broadcast; all other keys take a shuffle join, where none is large.
    """
    least = max(HOT_ROWS, total // HOT_SHARE)
    hot = [r[0] for r in counts.filter(F.col("n") >= least).select(key).collect()]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = left.filter(~is_hot).join(right, key, how)
    warm = left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how)
    return cold.unionByName(warm)


def join_small(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", by: str | None = None) -> DataFrame:
    """Join to a summary with one row per group. The summary is counted: up to BROADCAST_ROWS it
    is broadcast; beyond that both sides are salted, so that no group meets in one task. The salt is a
    hash of the column ``by`` (of all columns where none is named), so that a task which runs again
    deals its rows alike."""
    n = right.limit(BROADCAST_ROWS + 1).count()
    if n <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, how)
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    own = F.xxhash64(*([by] if by else [F.col(f"`{c}`") for c in left.columns]))
    return left.withColumn("_salt", F.pmod(own, F.lit(SALT)).cast("int")).join(salted, [*keys, "_salt"], how).drop("_salt")


#: names of schemes that Hadoop and pyarrow call differently
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def open_filesystem(uri: str):
    """pyarrow's file system for a folder that Hadoop names in full, and the path in it. Raises ValueError for
    schemes that pyarrow can't open; callers ask on the driver before tasks do."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else uri).lstrip("/")
    try:
        return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")
    except (pa.ArrowInvalid, NotImplementedError, OSError) as e:
        raise ValueError(f"executors can't open {scheme}: folders ({e})") from e
