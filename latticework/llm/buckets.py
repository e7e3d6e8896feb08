"""Buckets of rows with one key, dealt to tasks so that none grows without bound.

A bucket over ``chunk`` rows is cut into chunks by a hash, and each chunk and each pair of chunks is a
task's work of its own: a chunk is compared with itself once, and across with each other chunk once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small


def crowded_keys(sizes: DataFrame, key: str, chunk: int) -> DataFrame:
    """(key, chunks) of keys with over ``chunk`` rows, from (key, n). There are at most rows / chunk."""
    return sizes.filter(F.col("n") > chunk).select(key, F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))


def deal(rows: DataFrame, key: str, by: str, crowded: DataFrame) -> DataFrame:
    """``rows`` with ``bucket`` and ``side``, repeated for each of its chunk's pairs and sorted by bucket and
    side. Rows of side 0 are compared with each other where a bucket has no side 1, and with the rows of
    side 1 where it has. ``by`` deals a bucket's rows to chunks."""
    rows = join_small(rows, crowded, [key], by=by)
    own = F.pmod(F.xxhash64(by, F.lit(11)), F.col("chunks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda j: F.struct(F.least(own, j).alias("x"), F.greatest(own, j).alias("y"), (own > j).cast("int").alias("side")),
    )
    alone = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side")))
    dealt = rows.withColumn("_p", F.explode(F.coalesce(pairs, alone)))
    dealt = dealt.withColumns({"bucket": F.xxhash64(key, "_p.x", "_p.y"), "side": F.col("_p.side")}).drop("_p", "chunks", key)
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "side")


def whole_buckets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames sorted by bucket, cut anew so that each bucket with two rows or more lies in one frame; rows
    that are alone in theirs are left out."""
    held: list[pd.DataFrame] = []

    def shared(frame: pd.DataFrame) -> pd.DataFrame:
        keys = frame["bucket"].to_numpy()
        same = keys[1:] == keys[:-1]
        return frame[np.append(same, False) | np.append(False, same)] if len(keys) else frame

    for frame in frames:
        if not len(frame):
            continue
        keys = frame["bucket"].to_numpy()
        others = np.flatnonzero(keys != keys[-1])
        if len(others):
            last = int(others[-1]) + 1
            out = shared(pd.concat([*held, frame.iloc[:last]]))
            if len(out):
                yield out
            held = [frame.iloc[last:]]
        else:
            held.append(frame)
    if held and len(out := shared(pd.concat(held))):
        yield out


def bucket_starts(frame: pd.DataFrame) -> np.ndarray:
    """Where each bucket begins in a frame of whole buckets, and its end."""
    keys = frame["bucket"].to_numpy()
    return np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))


def spanning(n: int, rows: Iterator[int], near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Index pairs that connect what is near, fewer than ``n``. ``near(i, group)`` gives the indices near to
    i; ``group`` numbers the groups found so far, and members of i's own needn't be given."""
    group = np.arange(n)
    links: list[tuple[int, int]] = []
    for i in rows:
        found = near(i, group)
        if not len(found):
            continue
        groups, first = np.unique(group[found], return_index=True)
        other = groups != group[i]
        if other.any():
            links += [(i, int(j)) for j in found[first[other]]]
            group[np.isin(group, groups[other])] = group[i]
    return links
